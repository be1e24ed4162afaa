import hashlib

import pytest
from pyspark.sql import functions as F

from sealstream.functions import codecs as K
from sealstream.functions import values as V
from sealstream.operators import ledger as L
from sealstream.operators import segments as S

# Published records, ledger, segment digests and size.
RECORDS = ["87014800000000000000010100f600f6", "87014800000000000000020201f600f6", "87014800000000000000030302f600f6"]
LEDGER, SITE = "b7a1d5e40c6f438e9a75db27c96f31aa", "an-001"
SHA0 = "ce76302d1fcbf713097c0d70070b6a651bcd97e7855213aaf422b0ff9226708c"
SHA1 = "e58ebc264de3681789d6fd7774bf3ab1d396b091e0bb4fff6793566ec00d9a8b"
SHA7 = "5a0aff8ffbb9314bc02d789c1cca00e2a92be741acef586f51784f4bed1ef4f4"


def chain(spark, numbers=(0, 1)):
    rec = spark.createDataFrame([(LEDGER, n, r) for n in numbers for r in RECORDS],
                                "ledger_id string, segment_number long, h string").withColumn("record", F.unhex("h"))
    segs = spark.createDataFrame(
        [(LEDGER, n, SITE, "interval", 86400000, 2, None, None, "suppress") for n in numbers],
        "ledger_id string, segment_number long, site_id string, close_reason string, interval_ms long,"
        "batch_record_limit long, record_limit long, size_limit_bytes long, empty_mode string")
    segs, batches = L.seal(rec, segs, 2)
    parts = L.segment_parts(segs, batches)
    return segs, batches, parts, L.chain_segments(parts)


def test_published_segments(spark):
    _, _, parts, links = chain(spark)
    rows = links.orderBy("segment_number").collect()
    assert [(r.artifact_sha256, r.artifact_size, r.prev_segment_sha256) for r in rows] == [
        (SHA0, 1049, V.ZERO_SHA256), (SHA1, 1049, SHA0)]
    art = L.segment_artifacts(parts, links).orderBy("segment_number").collect()
    assert [hashlib.sha256(r.artifact_cbor).hexdigest() for r in art] == [SHA0, SHA1]


def test_successor_with_zero_predecessor(spark):
    """The published negative segment: number 7 chained to nothing."""
    _, _, parts, links = chain(spark, (7,))
    row = links.first()
    assert (row.artifact_sha256, row.artifact_size) == (SHA7, 1049)
    decoded = S.decode_segments(L.segment_artifacts(parts, links).select("artifact_cbor"))
    segs, batches = S.decoded_tables(decoded)
    assert S.check_segment_invariants(segs, batches).first().code == "successor-predecessor-is-zero"


def test_good_segments_hold_all_invariants(spark):
    _, _, parts, links = chain(spark)
    decoded = S.decode_segments(L.segment_artifacts(parts, links).select("artifact_cbor"))
    segs, batches = S.decoded_tables(decoded)
    assert S.check_segment_invariants(segs, batches).filter("code is not null").count() == 0


@pytest.mark.parametrize("change,error", [
    (lambda s: {**s, "extra": 1}, "unexpected extra"), (lambda s: {k: v for k, v in s.items() if k != "site_id"}, "missing site_id"),
    (lambda s: {**s, "version": 3}, "invalid version"), (lambda s: {**s, "site_id": 5}, "invalid site_id"),
    (lambda s: {**s, "closure_policy": {**s["closure_policy"], "record_limit": 0}}, "invalid closure_policy"),
    (lambda s: {**s, "batches": [{}]}, "missing count"), (lambda s: [s], "segment is not a map")])
def test_strict_decoding(spark, change, error):
    _, _, parts, links = chain(spark, (0,))
    raw = bytes(L.segment_artifacts(parts, links).first().artifact_cbor)
    bad = K.to_cbor(change(K.decode(raw)[0]))
    df = spark.createDataFrame([(bytearray(bad),)], "artifact_cbor binary")
    assert S.decode_segments(df).select("seg.error").first()[0] == error


def test_partition_order_across_batches(spark):
    segs, batches, _, links = chain(spark, (0,))
    segs = segs.join(links, L.SEG)
    emb = batches.withColumns({"position": F.lit(1) - F.col("batch_number"), "batch_number": F.lit(1) - F.col("batch_number"),
                               "batch_ledger_id": F.col("ledger_id"), "batch_site_id": F.lit(SITE), "batch_segment_number": F.col("segment_number")})
    # The short batch comes first now, and its leaf is larger than the next batch's.
    assert S.check_segment_invariants(segs, emb).first().code == "non-final-batch-short"
    wide = segs.withColumn("batch_record_limit", F.lit(2))
    full = emb.withColumns({"leaf_hashes": F.when(F.col("position") == 0, F.array_repeat(F.lit("f" * 64), 2)).otherwise(F.col("leaf_hashes")),
                            "count": F.lit(2)})
    root = hashlib.sha256(b"\x01" + bytes([255]) * 64).hexdigest()
    full = full.withColumn("merkle_root", F.when(F.col("position") == 0, root).otherwise(F.col("merkle_root")))
    assert S.check_segment_invariants(wide, full).first().code == "batch-partitions-unsorted"


def test_empty_segments(spark):
    segs = spark.createDataFrame(
        [(LEDGER, 0, SITE, "interval", 1, 1, None, None, "emit", V.ZERO_SHA256, V.EMPTY_SHA256),
         (LEDGER, 1, SITE, "interval", 1, 1, None, None, "suppress", "a" * 64, V.EMPTY_SHA256)],
        "ledger_id string, segment_number long, site_id string, close_reason string, interval_ms long, batch_record_limit long,"
        "record_limit long, size_limit_bytes long, empty_mode string, prev_segment_sha256 string, segment_root string")
    _, batches, _, _ = chain(spark, (5,))
    emb = batches.withColumns({"position": F.col("batch_number"), "batch_ledger_id": F.col("ledger_id"),
                               "batch_site_id": F.lit(SITE), "batch_segment_number": F.col("segment_number")})
    got = {r.segment_number: r.code for r in S.check_segment_invariants(segs, emb).collect()}
    assert got == {0: None, 1: "empty-segment"}


def test_lists_of_digests_are_read_at_once(spark, monkeypatch):
    """A bundle's artifact has tens of thousands of digests; heads are read one by one for all other items only."""
    _, _, parts, links = chain(spark, (0,))
    seg = K.decode(bytes(L.segment_artifacts(parts, links).first().artifact_cbor))[0]
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    seg["batches"][0]["leaf_hashes"] = digests
    raw, heads, one = K.to_cbor(seg), [], K.read_head
    monkeypatch.setattr(K, "read_head", lambda data, pos: heads.append(pos) or one(data, pos))
    read = S._read_segment(raw)
    assert read["batches"][0]["leaf_hashes"] == digests and read["segment_root"] == seg["segment_root"]
    assert len(heads) < 1000
    # Lists that are no digests throughout are still read item by item.
    for odd in (digests[:5] + ["a" * 63], ["a" * 63] + digests[:5], digests[:3] + ["é" * 32], ["é" * 32] * 3, ["a" * 64, 5, None], [["a" * 64]] * 2):
        both = K.to_cbor({"a": odd, "b": digests[:2]})
        assert K.check_item(both, 0, "record") == len(both) and K.decode(both) == ({"a": odd, "b": digests[:2]}, len(both))
    cut = K.to_cbor(digests[:4])
    for bad in (cut[:-1], cut[:1] + b"\x78\x40" + b"\xff" * 64 + cut[67:]):
        with pytest.raises(K.CborError):
            K.check_item(bad, 0, "record")


def test_predecessors_and_errors_decode(spark):
    _, _, parts, links = chain(spark)
    good = [bytes(r.artifact_cbor) for r in L.segment_artifacts(parts, links).orderBy("segment_number").collect()]
    big = {**K.decode(good[0])[0], "segment_number": 2**63}
    rows = [(0, bytearray(good[0])), (1, bytearray(b"\x80")), (2, bytearray(good[1])), (3, bytearray(K.to_cbor(big)))]
    df = S.decode_segments(spark.createDataFrame(rows, "id int, artifact_cbor binary").coalesce(1))
    got = {r.id: r.seg for r in df.select("id", "seg").collect()}
    assert [got[k].error for k in range(4)] == [None, "segment is not a map", None, "number out of range"]
    assert [got[k].segment_number for k in (0, 2)] == [0, 1] and [len(got[k].batches) for k in (0, 2)] == [2, 2]
    assert got[0].record_limit is None and got[1].batches is None and got[0].batches[0]["count"] == 2


def test_records_are_written_as_they_are_read(spark, tmp_path):
    from sealstream.plans import ledger as G
    rows = [(i, f"2024-01-01 0{i % 9}:00:0{i % 7}.25", i * 7, "view", i / 3) for i in range(40)] + [
        (3, "2024-01-01 03:00:03", 21, "click", None), (41, None, 5, None, 1.0), (42, "2024-01-02 00:00:00", None, "error", 2.5)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    df.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "props": F.lit("{}")}).write.parquet(str(tmp_path / "events.parquet"))
    want, got = (f(spark, str(tmp_path)).orderBy("event_id", "t_ms", "record").collect() for f in (G.records, G.written_records))
    assert len(got) == 43 and got == want
