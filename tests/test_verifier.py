"""Inputs that a verifier must not be misled or stopped by."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sealstream.functions import codecs as K
from sealstream.functions import columns as C
from sealstream.operators import admission, evidence, plan, receipts, segments
from sealstream.sources import artifacts


@pytest.mark.parametrize("path, clean", [
    ("./day/x.cbor", "day/x.cbor"), (".//facts/r.ndjson", "facts/r.ndjson"), ("a/b/c/d/e/../../../../../day/x.cbor", "day/x.cbor"),
    ("/a/../../b", "/../b"), ("../x", "../x"), ("a/..", ""), ("", ""), ("a//b/./c/", "a/b/c"), ("../../a/../b", "../../b")])
def test_clean_path(spark, path, clean):
    assert spark.range(1).select(C.clean_path(F.lit(path))).first()[0] == clean


def test_digest_with_a_newline_is_no_digest(spark):
    text = F.lit("ab" * 32 + "\n")
    row = spark.range(1).select(C.is_hex(text, 64), C.normalize_hex64(text), C.portable_path(F.lit("a/..\n"), 1)).first()
    assert tuple(row) == (False, None, True)


def test_anchor_needs_the_attested_message(spark):
    header = next(h for n in range(10_000) if (h := bytes(36) + b"r" * 32 + bytes(4) + bytes.fromhex("ffff7f20") + n.to_bytes(4, "little"))
                  and hashlib.sha256(hashlib.sha256(h).digest()).digest()[::-1] < bytes.fromhex("7fffff" + "00" * 29))
    headers = spark.createDataFrame([(5, bytearray(header))], "height long, header binary")
    rows = [("right", [5], [(b"r" * 32).hex()]), ("wrong", [5], ["00" * 32]), ("half", [5, 6], [(b"r" * 32).hex()] * 2)]
    proofs = spark.createDataFrame([(a, True, [], h, m) for a, h, m in rows],
                                   "anchor_id string, has_proof boolean, pending_uris array<string>, heights array<long>, messages array<string>")
    got = {r.anchor_id: r.state for r in evidence.derive_anchor_state(proofs, headers).collect()}
    assert got == {"right": "bitcoin-header-quorum-verified", "wrong": "bitcoin-attested-structure", "half": "bitcoin-attested-structure"}
    other = headers.withColumn("anchor_id", F.lit("half"))
    got = {r.anchor_id: r.state for r in evidence.derive_anchor_state(proofs, other).collect()}
    assert got["right"] == "bitcoin-attested-structure"


def test_archive_with_a_repeated_height(spark):
    head = b"OTSV\x01" + bytes(11)
    record = lambda h: h.to_bytes(4, "little") + bytes(80)
    files = spark.createDataFrame([("good", bytearray(head + record(1) + record(2))), ("bad", bytearray(head + record(1) * 2)),
                                   ("empty", bytearray(head))], "path string, content binary")
    got = {(r.path, r.height): r.error for r in artifacts.explode_headers(files).collect()}
    assert got == {("good", 1): None, ("good", 2): None, ("bad", None): "repeated height", ("empty", None): None}


def test_exported_tree(spark, tmp_path):
    for name, text in {"blocks/2025-01-02-00.block.json": '{"day":"2025-01-02"}', "day/2025-01-01.json": "{}",
                       "day/2025-01-02.json": '{"date":"2025-01-02"}', "day/2025-01-02.cbor": "c", "day/2025-01-02.verify.json": "{}",
                       "facts/1.cbor": "f"}.items():
        file = tmp_path / "site/s1/day/2025-01-02" / name
        os.makedirs(file.parent, exist_ok=True)
        file.write_text(text)
    row = artifacts.scan_day_bundles(spark, str(tmp_path)).collect()
    assert [(r.bundle, r.day_json, bytes(r.day_cbor)) for r in row] == [("site/s1/day/2025-01-02", '{"date":"2025-01-02"}', b"c")]
    assert [(r.bundle, r.path) for r in artifacts.scan_fact_artifacts(spark, str(tmp_path)).collect()] == [
        ("site/s1/day/2025-01-02", "facts/1.cbor")]


def test_deep_input_is_an_error_not_the_end(spark):
    deep = spark.createDataFrame([(bytearray(b"\x81" * 100_000),), (bytearray(b"\xff"),)], "artifact_cbor binary")
    assert segments.decode_segments(deep).filter("seg.error IS NULL").count() == 0
    assert deep.select(K.fact_error("vector")("artifact_cbor").alias("e")).filter("e IS NULL").count() == 0
    assert deep.select(K.record_meta("artifact_cbor").alias("m")).filter("m.error IS NULL").count() == 0


def test_repeated_device_is_decided_by_order(spark):
    devices = spark.createDataFrame([(1, "Yg==", "Yg=="), (1, "YQ==", "Yw=="), (1, "YQ==", None)], "dev_id int, salt8 string, ck_up string")
    frames = spark.createDataFrame([(1, None)], "dev_id int, reason string")
    for n in (1, 3):
        row = admission.join_devices(frames, devices.repartition(n)).first()
        assert (bytes(row.salt8), bytes(row.ck_up), row.reason) == (b"a", b"c", None)


def test_staged_tables_are_released(spark):
    table = plan.staged(spark.range(3))
    at = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(at)
    plan.release_staged(spark)
    assert not os.path.exists(at)


def test_multisets_are_counted_in_one_pass(spark):
    a = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 5), (3, 1), (None, 4)], "g long, leaf long")
    b = spark.createDataFrame([(1, 7), (1, 8), (1, None), (2, 5), (4, 1), (None, 4)], "g long, leaf long")
    got = evidence.compare_leaf_multisets(a, b, ["g"])
    plan_text = got._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("Exchange hashpartitioning") == 2 and "Join" not in plan_text
    assert {r.g: (r.differing, r.equal) for r in got.collect()} == {
        1: (2, False), 2: (0, True), 3: (1, False), 4: (1, False), None: (0, True)}
    assert {(r.g, r.leaf): (r.left_copies, r.right_copies) for r in evidence.multiset_diff(a, b).collect()} == {
        (1, 7): (2, 1), (1, None): (0, 1), (3, 1): (1, 0), (4, 1): (0, 1)}


def test_receipts_meet_their_files_without_broadcast(spark):
    """Files and headers grow with the receipts, however small Spark takes them to be."""
    docs = spark.createDataFrame([("a", *["{}"] * 6), ("b", *["{}"] * 6)], "anchor_id string, " + ", ".join(f"{d} string" for d in receipts.DOCS))
    files = spark.createDataFrame([("a", "subject.json", "00" * 32)], "anchor_id string, path string, sha256 string")
    headers = spark.createDataFrame([("a", 1, "b", "r", "h")], "anchor_id string, height long, block_hash string, merkle_root string, header_sha256 string")
    got = receipts.check_anchor_receipts(docs, files, headers, "e", "s", "v")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.anchor_id: r.error for r in got.collect()} == {"a": "receipt version", "b": "receipt version"}


def test_small_rows_are_dealt_into_many_tasks(spark):
    rows = plan.dealt(spark.range(1000).repartition(1), ["id"], 20)
    assert rows.rdd.getNumPartitions() == 50 and rows.count() == 1000


def test_intermediates_are_never_broadcast(spark):
    """Each step of a walk joins the table of all intermediates, which grows with the input."""
    inter = spark.createDataFrame([(f"p{k}", f"p{k // 2}", k) for k in range(1, 40)], "subject string, issuer string, serial long")
    signers = spark.createDataFrame([(k, f"p{k}", 1, 500) for k in (3, 30)], "cert_id long, issuer string, serial long, gen_time int")
    anchors = spark.createDataFrame([("p0",)], "subject string")
    walked = evidence.walk_cert_paths(signers, inter, anchors)
    assert "BroadcastHashJoin" not in walked._jdf.queryExecution().toString()
    assert {(r.cert_id, r.state, r.length) for r in walked.collect()} == {(3, "anchored", 3), (30, "anchored", 6)}
    lists = spark.createDataFrame([(k, f"p{k}", 0, 900) for k in range(40)], "list_id long, issuer string, this_update int, next_update int")
    revoked = spark.createDataFrame([(7, 15, 100)], "list_id long, serial long, revoked_at int")
    got = evidence.check_cert_paths(signers, inter, anchors, lists, revoked)
    assert {r.cert_id: (r.state, r.error, r.error_at) for r in got.collect()} == {
        3: ("anchored", None, None), 30: ("anchored", "revoked", 2)}
