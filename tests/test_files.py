"""Artifact files, the commit log, day artifacts and the portable export, read back by content."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sealstream.operators import ledger as L
from sealstream.sources import artifacts as A
from sealstream.sources import commits as KC
from sealstream.sources import files as W
from sealstream.sources import sinks as K2


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


def test_files_are_written_whole_in_order_of_parts(spark, tmp_path):
    want = {f"d{k % 3}/f{k}": b"".join(b"%d," % n for n in range(k * 40)) + b"\xff" for k in range(20)}
    rows = [(path, n, bytearray(raw[at:at + 7])) for path, raw in want.items() for n, at in enumerate(range(0, len(raw), 7))]
    df = spark.createDataFrame(rows[::-1], "path string, part long, bytes binary").repartition(6)
    W.write_artifact_files(df, str(tmp_path / "out"), "part")
    assert tree(tmp_path / "out") == want
    assert os.listdir(tmp_path) == ["out"]  # neither drafts nor staging are left
    with pytest.raises(Exception, match="out"):
        W.write_artifact_files(df, str(tmp_path / "out"), "part")
    assert tree(tmp_path / "out") == want and os.listdir(tmp_path) == ["out"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("ok", bytearray(b"x")), ("../up", bytearray(b"y"))], "path string, bytes binary")
    with pytest.raises(Exception, match="not a path below"):
        W.write_artifact_files(df, f"file://{tmp_path}/out")
    assert os.listdir(tmp_path) == []
    W.write_artifact_files(df.limit(0), f"file://{tmp_path}/none")
    assert tree(tmp_path / "none") == {}


def test_commit_log(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda *n: {"records": spark.createDataFrame([(k,) for k in n], "n long")}
    assert KC.current_revision(spark, path) is None
    with pytest.raises(KC.StaleRevision):
        KC.commit_transition(spark, path, 3, rows(0))
    assert KC.commit_transition(spark, path, None, rows(1, 2)) == 1
    assert KC.commit_transition(spark, path, 1, rows(3) | {"segments": rows(9)["records"]}) == 2
    for stale in (None, 1):
        with pytest.raises(KC.StaleRevision):
            KC.commit_transition(spark, path, stale, rows(66))
    assert sorted(map(tuple, KC.read_committed(spark, path, "records").collect())) == [(1, 1), (2, 1), (3, 2)]
    assert sorted(map(tuple, KC.read_committed(spark, path, "records", upto=1).collect())) == [(1, 1), (2, 1)]
    assert [tuple(r) for r in KC.read_committed(spark, path, "segments").collect()] == [(9, 2)]
    assert [json.loads(open(tmp_path / "ledger/log" / f).read())["previous"] for f in sorted(os.listdir(tmp_path / "ledger/log"))
            if f.endswith(".json")] == [None, 1]


def test_two_writers_of_one_revision(spark, tmp_path, monkeypatch):
    """Both have looked at the log before either has committed: the file system lets one of them through."""
    path, rows = str(tmp_path / "ledger"), {"records": spark.range(1)}
    KC.commit_transition(spark, path, None, rows)
    monkeypatch.setattr(KC, "current_revision", lambda *_: 1)
    assert KC.commit_transition(spark, path, 1, {"records": spark.range(10, 12)}) == 2
    with pytest.raises(KC.StaleRevision):
        KC.commit_transition(spark, path, 1, {"records": spark.range(20, 25)})
    assert sorted(r.id for r in KC.read_committed(spark, path, "records").collect()) == [0, 10, 11]
    assert len(os.listdir(tmp_path / "ledger/data/records")) == 2


def test_day_artifacts(spark, tmp_path):
    leaves = [hashlib.sha256(b"%d" % k).digest() for k in range(9000)]  # more than two blocks of leaves
    rows = [("s/1", "2025-01-01", bytearray(x)) for x in leaves] + [("s/1", "2025-01-02", bytearray(leaves[0]))] * 2
    K2.write_day_artifacts(spark.createDataFrame(rows, "site_id string, day string, leaf binary"), str(tmp_path / "out"))
    got = tree(tmp_path / "out")
    assert len(got) == 8
    prev = "0" * 64
    for day, own in (("2025-01-01", sorted(leaves)), ("2025-01-02", [leaves[0]] * 2)):
        block = json.loads(got[f"s/1/blocks/{day}-00.block.json"])
        assert block["leaf_hashes"] == [x.hex() for x in own] and block["count"] == len(own)
        compact = {"sort_keys": True, "separators": (",", ":")}
        assert got[f"s/1/blocks/{day}-00.block.json"].decode() == json.dumps(block, **compact)
        record = json.loads(got[f"s/1/day/{day}.json"])
        assert record["batches"] == [block] and record["prev_day_root"] == prev and record["day_root"] == block["merkle_root"]
        assert got[f"s/1/day/{day}.json"].decode() == json.dumps(record, **compact)
        from sealstream.functions import codecs as K
        assert got[f"s/1/day/{day}.cbor"] == K.to_cbor(record)
        assert got[f"s/1/day/{day}.cbor.sha256"].decode() == f"{hashlib.sha256(K.to_cbor(record)).hexdigest()}  {day}.cbor\n"
        prev = record["day_root"]


def test_damaged_texts_are_rows_not_the_end(spark, tmp_path):
    for bundle, manifest in (("good", b'{"version":2}'), ("bad", b"\xff{}")):
        os.makedirs(tmp_path / bundle / "blocks")
        os.makedirs(tmp_path / bundle / "day")
        (tmp_path / bundle / "segment.verify.json").write_bytes(manifest)
        (tmp_path / bundle / "blocks/d-00.block.json").write_bytes(b'{"day":"d"}' if bundle == "good" else b"\xfe")
        (tmp_path / bundle / "day/d.verify.json").write_bytes(manifest)
    got = {r.bundle: r.manifest_json for r in A.scan_segment_bundles(spark, str(tmp_path))[0].collect()}
    assert got == {"good": '{"version":2}', "bad": None}
    days = {r.bundle: (r.block_json, r.manifest_json) for r in A.scan_day_bundles(spark, str(tmp_path)).collect()}
    assert days == {"good": ('{"day":"d"}', '{"version":2}'), "bad": (None, None)}
    from sealstream.operators import segments as S
    files = A.scan_segment_bundles(spark, str(tmp_path))[1].unionByName(
        spark.createDataFrame([("bad", "segment.verify.json", bytearray(b"\xff{}"), None)], "bundle string, path string, content binary, sha256 string"))
    assert [(r.bundle, r.failure) for r in S.verify_segment_bundles(files).collect()] == [("bad", "manifest")]
    assert L.build_block_headers(spark.createDataFrame([], "site_id string, day string, leaf binary")).count() == 0


def test_tasks_list_and_read_the_files(spark, tmp_path, monkeypatch):
    """No list of files in the driver: neither Spark's file reader, nor a row per file that comes back."""
    want = {f"s/{d}/{part}/f{k}.cbor{end}": b"%d" % k for d in ("a", "b c") for part in ("facts", "day") for k in range(30) for end in ("", ".gz")}
    want |= {"top.cbor": b"", "s/.hidden/x.cbor": b"h", "s/a/facts/_tmp.cbor": b"h", "s/a/facts/_k=1.cbor": b"k"}
    for path, raw in want.items():
        os.makedirs((tmp_path / path).parent, exist_ok=True)
        (tmp_path / path).write_bytes(raw)

    class Refused:
        def __getattr__(self, name):
            raise AssertionError("the driver lists the files")
    monkeypatch.setattr(type(spark), "read", property(lambda self, read=type(spark).read.fget: _only_parquet(read(self), Refused())))
    shown = {p: raw for p, raw in want.items() if "hidden" not in p and "_tmp" not in p}
    rows = {"/".join(filter(None, (r.bundle, r.path))): (bytes(r.content), r.sha256) for r in A.scan_files(spark, str(tmp_path)).collect()}
    assert rows == {p: (raw, hashlib.sha256(raw).hexdigest()) for p, raw in shown.items()}
    facts = A.scan_fact_artifacts(spark, f"file://{tmp_path}").collect()
    assert sorted((r.bundle, r.path) for r in facts) == sorted(
        (p.split("/facts/")[0], "facts/" + p.split("/facts/")[1]) for p in shown if "/facts/" in p and p.endswith(".cbor"))
    with pytest.raises(Exception):
        A.scan_files(spark, str(tmp_path / "none")).collect()


def _only_parquet(reader, refused):
    form = reader.format
    reader.format = lambda name: refused if name == "binaryFile" else form(name)
    return reader


def test_small_files_are_dealt_to_many_tasks(spark):
    """Adaptive execution would merge rows of a few bytes into one task, and a file takes its time whatever its size."""
    df = spark.range(500).selectExpr("concat('d/', id) AS path", "cast('x' as binary) AS bytes")
    assert W.many_tasks(df, "path").select(F.spark_partition_id()).distinct().count() == 8


def test_facts_are_encoded_once(spark, tmp_path):
    """What follows on the facts of day bundles reads their bytes; no plan of theirs encodes them again."""
    from sealstream.plans import bundles
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, id % 8 AS user_id, 'view' AS event_type, 1.5D AS value, '{}' AS props "
              "FROM range(64)").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    own = bundles.day_bundles(spark, str(tmp_path))[2]
    assert "json" not in own._jdf.queryExecution().optimizedPlan().toString().lower().replace("manifest_json", "")
    assert own.count() == len({r.path for r in own.collect()}) == 48  # one of four sites is a case without facts


def test_files_of_a_scan_lie_on_the_disk_in_parts(spark, monkeypatch):
    """Scans find the same in parts as in one folder; no part holds many more files than allowed, and none is left."""
    from sealstream.plans import bundles as P
    days = [(f"s/2024-01-{d:02}", f"2024-01-{d:02}", 2 if d == 2 else 1, f'{{"m": {d}}}', f'{{"day": "2024-01-{d:02}"}}', f'{{"d": {d}}}', bytes([d]))
            for d in range(1, 9)]
    facts = [(days[n % 5 if n % 2 else 0][0], f"facts/{n}.cbor", bytes([n % 256])) for n in range(100)]
    made = (spark.createDataFrame(days, "bundle string, day string, k int, manifest_json string, block_json string, day_json string, day_cbor binary"),
            None, spark.createDataFrame(facts, "bundle string, path string, content binary"), None)
    roots, written = [], []

    def counted(rows, root):
        keep(rows, root)
        roots.append(root)
        written.append([os.path.join(d, f) for d, _, names in os.walk(root) for f in names])
        assert sum(os.path.exists(r) for r in roots) == 1
    keep = A.write_files
    monkeypatch.setattr(P, "day_bundles", lambda *_: made)
    monkeypatch.setattr(A, "write_files", counted)
    monkeypatch.setattr(P, "FILES", 70)
    want = ({(b, None if k == 2 else m, block, doc, raw) for b, _, k, m, block, doc, raw in days}, {(b, p, raw) for b, p, raw in facts})
    for scan, rows in zip((A.scan_day_bundles, lambda *a: A.scan_fact_artifacts(*a).drop("sha256")), want):
        written.clear()
        got = [tuple(bytes(c) if isinstance(c, bytearray) else c for c in r) for r in P.scanned(spark, None, scan).collect()]
        assert len(got) == len(rows) and set(got) == rows
        files = [f.split("/bundles-")[1].split("/", 1)[1] for part in written for f in part]
        assert len(written) == 2 and max(map(len, written)) < 132 and len(files) == len(set(files)) == 132
        assert not any(os.path.exists(r) for r in roots)


def test_files_are_written_and_removed_below_a_uri(spark, tmp_path):
    df = spark.createDataFrame([(f"{k % 3}/facts/{k}.cbor", bytes([k])) for k in range(20)], "path string, bytes binary")
    A.write_files(df, f"file://{tmp_path}/in")
    assert A.scan_fact_artifacts(spark, f"file://{tmp_path}/in").count() == 20
    A.remove_files(spark, f"file://{tmp_path}/in")
    with pytest.raises((ValueError, OSError)):
        A.write_files(df, "s3://bucket/in")
    assert not (tmp_path / "in").exists() and tmp_path.exists()
