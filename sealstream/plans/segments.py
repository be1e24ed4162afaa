"""Registered queries: segment invariants, decoding and bundle verification."""

from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.functions import values as V
from sealstream.operators import evidence as E
from sealstream.operators import ledger as L
from sealstream.operators import segments as S
from sealstream.operators.plan import staged
from sealstream.plans import ledger as G
from sealstream.plans.registry import query

N = "segment_number"


def tables(spark, sf):
    """(segments with chain columns, embedded batches)."""
    segs, batches, _, chain = G.chained(spark, sf)
    full = segs.join(chain, L.SEG)
    sites = segs.select(*L.SEG, F.col("site_id").alias("batch_site_id"))
    emb = batches.join(sites, L.SEG).withColumns({
        "position": F.col("batch_number"), "batch_ledger_id": F.col("ledger_id"),
        "batch_segment_number": F.col(N)})
    return full, emb


def pick(m, *cases, col=N, mod=16):
    """CASE over segment numbers: (remainder, value) pairs, else ``m``."""
    out = m
    for r, v in cases:
        out = F.when(F.col(col) % mod == r, v).otherwise(out)
    return out


NB = f"SELECT ledger_id, segment_number, count(*) AS nb FROM (SELECT DISTINCT ledger_id, segment_number, batch_number FROM bl) GROUP BY ALL"


@query("p21_segment_invariants", f"""{G.Q.WITH}, {G.SEGS}, nb AS ({NB}) SELECT ledger_id, segment_number, CASE segment_number % 16
  WHEN 1 THEN 'segment-hex-field' WHEN 2 THEN 'segment-identity-or-closure-policy' WHEN 3 THEN 'segment-identity-or-closure-policy'
  WHEN 4 THEN 'successor-predecessor-is-zero' WHEN 5 THEN 'empty-segment' WHEN 6 THEN 'embedded-batch-identity-or-cardinality'
  WHEN 7 THEN 'batch-leaf-hash' WHEN 9 THEN 'batch-root-mismatch' WHEN 10 THEN 'segment-root-mismatch'
  WHEN 11 THEN 'embedded-batch-identity-or-cardinality' WHEN 12 THEN CASE WHEN nb > 1 THEN 'non-final-batch-short' END END AS code FROM num JOIN nb USING (ledger_id, segment_number)""")
def p21(spark, sf):
    segs, emb = tables(spark, sf)
    segs = segs.withColumns({
        "segment_root": pick(F.col("segment_root"), (1, F.upper("segment_root")), (10, F.sha2("segment_root", 256))),
        "site_id": pick(F.col("site_id"), (2, F.lit(""))),
        "close_reason": pick(F.col("close_reason"), (3, F.lit("bored"))),
        "prev_segment_sha256": pick(F.col("prev_segment_sha256"), (4, F.lit(V.ZERO_SHA256))),
        "batch_record_limit": pick(F.col("batch_record_limit"), (12, F.lit(11)))})
    emb = emb.filter(f"{N} % 16 <> 5").withColumns({
        "count": pick(F.col("count"), (6, F.col("count") + 1)),
        "leaf_hashes": pick(F.col("leaf_hashes"), (7, F.transform("leaf_hashes", F.upper))),
        "merkle_root": pick(F.col("merkle_root"), (9, F.sha2("merkle_root", 256))),
        "batch_site_id": pick(F.col("batch_site_id"), (11, F.lit("elsewhere")))})
    return S.check_segment_invariants(segs, emb).select("ledger_id", N, "code")


@query("c07_batch_flags", f"""{G.Q.WITH}, {G.SEGS}, b AS (SELECT ledger_id, segment_number, batch_number, count(*) AS n FROM bl GROUP BY ALL)
  SELECT ledger_id, segment_number, batch_number, CASE WHEN segment_number % 3 = 0 AND n > 1 THEN 'batch-leaves-unsorted' WHEN segment_number % 3 = 1 THEN 'batch-root-mismatch' END AS code FROM b""")
def c07(spark, sf):
    segs, batches = G.sealed(spark, sf)
    sites = segs.select(*L.SEG, F.col("site_id").alias("batch_site_id"))
    emb = batches.join(sites, L.SEG).withColumns({
        "position": F.col("batch_number"), "batch_ledger_id": F.col("ledger_id"), "batch_segment_number": F.col(N),
        "leaf_hashes": pick(F.col("leaf_hashes"), (0, F.reverse("leaf_hashes")), mod=3),
        "merkle_root": pick(F.col("merkle_root"), (1, F.sha2("merkle_root", 256)), mod=3)})
    return S.batch_flags(emb, segs).select("ledger_id", N, "batch_number", "code")


def artifacts(spark, sf):
    segs, batches, parts, chain = G.chained(spark, sf)
    return L.segment_artifacts(parts, chain)


@query("v18_decode_segments", f"""{G.CW} SELECT ledger_id, segment_number, segment_number % 8 NOT IN (1, 2, 3) AS readable,
  CASE WHEN segment_number % 8 NOT IN (1, 2, 3) THEN root END AS segment_root, CASE WHEN segment_number % 8 NOT IN (1, 2, 3) THEN sha END AS reencoded
  FROM chn JOIN sr USING (ledger_id, segment_number)""")
def v18(spark, sf):
    raw = F.col("artifact_cbor")
    art = artifacts(spark, sf).withColumn("artifact_cbor", pick(
        raw, (1, F.concat(raw, F.lit(b"\x00"))), (2, F.substring("artifact_cbor", 1, 200)),
        (3, F.concat(F.lit(b"\xab"), F.expr("substring(artifact_cbor, 2)"))), mod=8))
    dec = staged(S.decode_segments(art).select(F.col("ledger_id").alias("l"), F.col(N).alias("n"), "seg"))
    segs, batches = S.decoded_tables(dec)
    parts = L.segment_parts(segs, batches.drop("position"))
    again = parts.groupBy(*L.SEG).agg(F.array_sort(F.collect_list(F.struct("part", "bytes"))).alias("p")).join(
        segs.select(*L.SEG, "prev_segment_sha256", "segment_root"), L.SEG)
    again = again.select(F.col("ledger_id").alias("l"), F.col(N).alias("n"), "segment_root", F.sha2(F.concat(
        C.concat_binary(F.transform("p", lambda x: x["bytes"])), L.segment_end("prev_segment_sha256")), 256)
        .alias("reencoded"))
    return dec.select("l", "n", F.col("seg.error").isNull().alias("readable")).join(again, ["l", "n"], "left").select(
        F.col("l").alias("ledger_id"), F.col("n").alias("segment_number"), "readable", "segment_root", "reencoded")


BUN = "ledger_id || '/' || segment_number"


def bundles(spark, sf):
    segs, emb = tables(spark, sf)
    segs = staged(segs)
    key = F.concat("ledger_id", F.lit("/"), N).alias("bundle")
    cls = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col(N) % 3 + 1).cast("int"))
    return segs.select(key, "*", cls.alias("disclosure_class")), emb.select(key, "*")


@query("p15_manifest_v2", f"""{G.Q.WITH}, {G.SEGS} SELECT {BUN} AS bundle, CASE segment_number % 9 WHEN 1 THEN 'identity' WHEN 2 THEN 'identity' WHEN 3 THEN 'identity'
  WHEN 4 THEN 'path' WHEN 5 THEN 'digest' WHEN 6 THEN 'claim' END AS error FROM num""")
def p15(spark, sf):
    segs, _, _, chain = G.chained(spark, sf)
    s = segs.join(chain, L.SEG)
    k = dict(mod=9)
    num = F.col(N).cast("string")
    m = s.select(
        F.concat("ledger_id", F.lit("/"), N).alias("bundle"), pick(F.lit(2), (1, F.lit(1)), **k).alias("version"),
        F.lit(V.PROFILE_V2).alias("commitment_profile_id"), "ledger_id",
        "site_id", pick(num, (2, F.concat(F.lit("0"), num)), **k).alias("number"), N,
        pick(F.lit("B"), (3, F.lit("D")), **k).alias("disclosure_class"),
        F.array(F.struct(pick(F.lit("segments/s.cbor"), (4, F.lit("segments/../s.cbor")), **k).alias("path"),
                         pick(F.col("artifact_sha256"), (5, F.upper("artifact_sha256")), **k).alias("sha256"))).alias("refs"),
        pick(F.lit("pending"), (6, F.lit("sure")), **k).alias("tsa"), F.lit(None).cast("string").alias("ots"),
        F.lit("complete").alias("peer"))
    # The digest case needs a letter to change; digests without one cannot be upper-cased.
    return S.check_manifest_v2(m.drop(N).withColumnRenamed("number", N)).select("bundle", "error")


@query("v11_segment_identity", f"{G.Q.WITH}, {G.SEGS} SELECT {BUN} AS bundle, CASE WHEN segment_number % 5 = 2 THEN 'identity' END AS error FROM num")
def v11(spark, sf):
    segs, _ = G.sealed(spark, sf)
    s = segs.select(F.concat("ledger_id", F.lit("/"), N).alias("bundle"), "ledger_id", "site_id", N)
    m = s.withColumn(N, pick(F.col(N).cast("string"), (2, F.lit("77777")), mod=5))
    return S.check_segment_identity(m, s).select("bundle", "error")


@query("v12_disclosure_precondition", f"{G.Q.WITH}, {G.SEGS} SELECT {BUN} AS bundle, CASE WHEN segment_number % 4 IN (0, 2) THEN 'timestamp_proof_required' END AS error FROM num")
def v12(spark, sf):
    segs, _ = G.sealed(spark, sf)
    n = F.col(N) % 4
    m = segs.select(F.concat("ledger_id", F.lit("/"), N).alias("bundle"), (n == 1).alias("has_tsa"),
                    (n >= 2).alias("has_ots"), (n == 3).alias("has_ots_meta"))
    return S.check_disclosure_precondition(m, True).select("bundle", "error")


@query("v13_chain", f"""{G.Q.WITH}, {G.SEGS} SELECT {BUN} AS bundle, CASE WHEN segment_number % 6 = 2 THEN 'predecessor_linkage' END AS error,
  CASE WHEN segment_number > 0 AND segment_number % 6 = 3 THEN 'predecessor-not-disclosed' ELSE 'executed' END AS chain FROM num""")
def v13(spark, sf):
    b, _ = bundles(spark, sf)
    pred = b.select("ledger_id", (F.col(N) + 1).alias(N), F.struct(
        "ledger_id", "site_id", N, pick(F.col("artifact_sha256"), (1, F.sha2("artifact_sha256", 256)), mod=6)
        .alias("sha256")).alias("pred"))
    joined = b.join(pred.filter(f"{N} % 6 <> 3"), L.SEG, "left")
    return S.check_chain(joined).select("bundle", "error", "chain")


@query("v14_class_a", f"""{G.Q.RWITH}, {G.SEGS}, {G.SROOT} SELECT {BUN} AS bundle, CASE WHEN segment_number % 5 = 1 THEN 'records_required' WHEN segment_number % 5 = 2 THEN 'record_not_canonical'
  WHEN segment_number % 5 = 3 THEN 'leaves_mismatch' WHEN segment_number % 5 = 4 THEN 'root_mismatch' END AS error FROM sr WHERE segment_number % 3 = 0""")
def v14(spark, sf):
    b, emb = bundles(spark, sf)
    rec = G.records(spark, sf)
    from sealstream.operators import producer as P
    numbers = P.number_segments_suppress(rec, G.INTERVAL, G.ORIGIN)
    rec = P.close_intervals(rec, G.INTERVAL, G.ORIGIN).join(numbers.drop("records", "close_reason"), ["ledger_id", "interval_no"])
    raw = pick(F.col("record"), (2, F.concat("record", F.lit(b"\x00"))), mod=5)
    # A foreign reading replaces each record of segments 3 mod 5.
    raw = pick(raw, (3, F.concat(F.substring("record", 1, 3), F.lit(b"\xff" * 8), F.expr("substring(record, 12)"))), mod=5)
    rec = rec.filter(f"{N} % 5 <> 1").select(F.concat("ledger_id", F.lit("/"), N).alias("bundle"), raw.alias("record"))
    b = b.withColumn("segment_root", pick(F.col("segment_root"), (4, F.sha2("segment_root", 256)), mod=5))
    return S.recompute_class_a(b, rec, emb).select("bundle", "error")


@query("v15_class_bc", f"""{G.Q.WITH}, {G.SEGS} SELECT {BUN} AS bundle, CASE segment_number % 3 WHEN 1 THEN 'partial_verification' ELSE 'anchor_only' END AS verification_scope,
  CASE WHEN segment_number % 3 = 2 THEN 'out_of_scope' WHEN segment_number % 4 = 0 THEN 'not_disclosed' ELSE 'executed' END AS batch_check,
  CASE WHEN segment_number % 3 = 1 AND segment_number % 4 = 1 THEN 'batch_projection_mismatch' END AS error FROM num WHERE segment_number % 3 > 0""")
def v15(spark, sf):
    b, emb = bundles(spark, sf)
    emb = emb.withColumn("site_id", F.col("batch_site_id"))
    shown = emb.filter(f"{N} % 4 <> 0").withColumn("merkle_root", pick(
        F.col("merkle_root"), (1, F.sha2("merkle_root", 256)), mod=4))
    match = E.match_batch_projections(shown, emb.filter(f"{N} % 4 <> 0")).withColumn(
        "bundle", F.concat("ledger_id", F.lit("/"), N))
    return S.check_class_bc(b, match).select("bundle", "verification_scope", "batch_check", "error")


@query("v16_timestamp_channels", f"""{G.Q.WITH}, {G.SEGS} SELECT {BUN} AS bundle, CASE segment_number % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'failed' WHEN 2 THEN 'missing' END AS tsa_channel,
  CASE WHEN segment_number % 3 = 0 THEN 'pending' WHEN segment_number % 3 = 1 THEN 'missing' END AS ots_channel,
  CASE WHEN segment_number % 4 = 1 THEN 'tsa_failed' END AS error FROM num""")
def v16(spark, sf):
    segs, _ = G.sealed(spark, sf)
    n, o = F.col(N) % 4, F.col(N) % 3
    b = segs.select(F.concat("ledger_id", F.lit("/"), N).alias("bundle"), (n < 2).alias("has_tsa"),
                    F.when(n == 1, "imprint").alias("tsa_error"), F.when(n == 2, "pending").alias("tsa"),
                    (o == 1).alias("has_ots"), F.when(o == 0, "pending").alias("ots"), F.lit(False).alias("has_peer"),
                    F.lit(None).cast("string").alias("peer"))
    return S.timestamp_channels(b, False).select("bundle", "tsa_channel", "ots_channel", "error")


def bundle_files(spark, sf):
    """Files of one bundle per segment: classes A, B and C in turn, most with their predecessor, some damaged."""
    rec = G.written_records(spark, sf)
    segs, batches, parts, _ = G.chained(spark, sf, rec)
    # Artifacts are whole rows here: all before the predecessor digest is joined once, for the chain and for the files.
    body = parts.groupBy(*L.SEG).agg(F.sort_array(F.collect_list(F.struct("part", "bytes"))).alias("p"))
    whole = F.when(F.forall("p", lambda x: x["bytes"].isNotNull()), C.concat_binary(F.transform("p", lambda x: x["bytes"])))
    parts = staged(body.select(*L.SEG, F.lit(0).cast("bigint").alias("part"), whole.alias("bytes"), F.lit(True).alias("last")))
    chain = L.chain_segments(parts)
    key = F.concat("ledger_id", F.lit("/"), N)
    cls = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col(N) % 3 + 1).cast("int"))
    art = staged(L.segment_artifacts(parts, chain).select(*L.SEG, F.col("artifact_cbor").alias("content")))
    own = art.select(*L.SEG, F.lit("segment_cbor").alias("role"), F.lit(0).alias("place"), F.lit("segments/s.cbor").alias("path"), "content")
    before = art.withColumn(N, F.col(N) + 1).join(art.select(*L.SEG, F.when(F.col(N) % 11 == 8, F.col("content")).alias("_own")), L.SEG)
    before = before.filter(f"{N} % 4 <> 3").select(
        *L.SEG, F.lit("predecessor_segment_cbor").alias("role"), F.lit(0).alias("place"), F.lit("segments/p.cbor").alias("path"),
        F.when(F.col(N) % 11 == 8, F.col("_own")).otherwise(F.col("content")).alias("content"))
    from sealstream.operators import producer as P
    numbers = P.number_segments_suppress(rec, G.INTERVAL, G.ORIGIN).select("ledger_id", "interval_no", N)
    rec = P.close_intervals(rec, G.INTERVAL, G.ORIGIN).join(numbers, ["ledger_id", "interval_no"]).filter(f"{N} % 3 = 0")
    rec = rec.select(*L.SEG, F.lit("records").alias("role"), F.col("seq").cast("int").alias("place"),
                     F.concat(F.lit("records/"), "seq", F.lit(".cbor")).alias("path"),
                     F.when(F.col(N) % 11 == 7, F.concat("record", F.lit(b"\x00"))).otherwise(F.col("record")).alias("content"))
    sites = segs.select(*L.SEG, "site_id")
    text = F.to_json(F.struct(F.lit(2).alias("version"), "ledger_id", "site_id", F.col(N).cast("string").alias(N),
                              F.col("batch_number").cast("string").alias("batch_number"), "merkle_root",
                              F.col("count").cast("string").alias("count"), "leaf_hashes"))
    shown = batches.join(sites, L.SEG).filter(f"{N} % 3 = 1 AND {N} % 4 <> 0").select(
        *L.SEG, F.lit("batches").alias("role"), F.col("batch_number").cast("int").alias("place"),
        F.concat(F.lit("batches/"), "batch_number", F.lit(".json")).alias("path"), C.text_bytes(text).alias("content"))
    tsr = segs.filter(f"{N} % 2 = 1").select(*L.SEG, F.lit("tsa_tsr").alias("role"), F.lit(0).alias("place"),
                                             F.lit("tsa/s.tsr").alias("path"), C.text_bytes("site_id").alias("content"))
    files = own.unionByName(before).unionByName(rec).unionByName(shown).unionByName(tsr)
    files = staged(files.withColumn("sha256", F.sha2("content", 256)))
    said = F.when((F.col(N) % 11 == 5) & (F.col("role") == "segment_cbor"), F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    refs = files.groupBy(*L.SEG).agg(F.sort_array(F.collect_list(F.struct("role", "place", "path", said.alias("sha256")))).alias("r"))
    one = lambda role: F.get(F.filter("r", lambda x: x["role"] == role), F.lit(0))
    bare = lambda x: F.struct(x["path"].alias("path"), x["sha256"].alias("sha256"))
    many = lambda role: F.transform(F.filter("r", lambda x: x["role"] == role), bare)
    singles = [F.when(one(r).isNotNull(), bare(one(r))).alias(r) for r in ("segment_cbor", "predecessor_segment_cbor", "tsa_tsr")]
    lists = [F.when(F.size(many(r)) > 0, many(r)).alias(r) for r in S.LISTED]
    number = F.when(F.col(N) % 11 == 6, F.lit("77777")).otherwise(F.col(N).cast("string"))
    manifest = F.to_json(F.struct(
        F.lit(2).alias("version"), "ledger_id", "site_id", number.alias(N), F.lit(V.PROFILE_V2).alias("commitment_profile_id"),
        cls.alias("disclosure_class"), F.struct(*singles, *lists).alias("artifacts"),
        F.struct(F.struct(F.lit("pending").alias("status")).alias("ots")).alias("anchoring")))
    content = F.when(F.col(N) % 17 == 9, F.lit(b"{\xff}")).otherwise(C.text_bytes(manifest))
    manifests = refs.join(sites, L.SEG).select(key.alias("bundle"), F.lit("segment.verify.json").alias("path"), content.alias("content"))
    manifests = staged(manifests.withColumn("sha256", F.sha2("content", 256)))
    return files.select(key.alias("bundle"), "path", "content", "sha256").unionByName(manifests), segs


FAILS = """CASE WHEN n % 17 = 9 THEN 'manifest' WHEN n % 11 = 5 THEN 'artifact-sha256' WHEN n % 11 = 6 THEN 'identity' WHEN n % 11 = 8 AND n > 0 AND n % 4 <> 3 THEN 'predecessor_linkage'
  WHEN n % 11 = 7 AND n % 3 = 0 THEN 'record_not_canonical' WHEN n % 2 = 1 AND n % 13 = 4 THEN 'tsa_failed' END"""


@query("v23_segment_bundles", f"""{G.CW}, b AS (SELECT c.ledger_id, c.segment_number AS n, c.sha, s.root FROM chn c JOIN sr s USING (ledger_id, segment_number)),
  f AS (SELECT *, {FAILS} AS failure, n = 0 OR n % 4 <> 3 AS linked FROM b)
  SELECT ledger_id || '/' || n AS bundle, CASE WHEN n % 17 <> 9 THEN CASE n % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END END AS disclosure_class,
  CASE WHEN n % 17 <> 9 THEN sha END AS artifact_sha256, failure,
  CASE WHEN failure IS NULL THEN CASE n % 3 WHEN 0 THEN 'public_recompute' WHEN 1 THEN 'partial_verification' ELSE 'anchor_only' END END AS verification_scope,
  CASE WHEN failure IS NULL AND n % 3 = 0 THEN root END AS record_multiset_root,
  CASE WHEN failure IS NULL THEN 'bundle_disclosure_validation,verification_manifest_validation,segment_artifact_validation' ||
   CASE WHEN linked THEN ',segment_chain_validation' ELSE '' END || CASE WHEN n % 3 = 0 THEN ',record_level_recompute' ELSE '' END ||
   CASE WHEN n % 3 = 0 OR n % 3 = 1 AND n % 4 <> 0 THEN ',batch_metadata_validation' ELSE '' END || ',segment_digest_binding' ||
   CASE WHEN n % 2 = 1 THEN ',tsa_verification' ELSE '' END END AS executed,
  CASE WHEN failure IS NULL THEN concat_ws(',', CASE WHEN NOT linked THEN 'segment_chain_validation:predecessor-not-disclosed' END,
   CASE n % 3 WHEN 1 THEN 'record_level_recompute:disclosure-class-b' WHEN 2 THEN 'record_level_recompute:disclosure-class-c' END,
   CASE WHEN n % 3 = 2 THEN 'batch_metadata_validation:out_of_scope' WHEN n % 3 = 1 AND n % 4 = 0 THEN 'batch_metadata_validation:not_disclosed' END) END AS skipped,
  CASE WHEN n % 2 = 1 AND n % 17 <> 9 THEN CASE WHEN n % 13 = 4 THEN 'failed' ELSE 'verified' END END AS tsa_channel,
  CASE WHEN n % 17 <> 9 THEN 'pending' END AS ots_channel FROM f""")
def v23(spark, sf):
    files, segs = bundle_files(spark, sf)
    wrong = segs.filter(f"{N} % 13 = 4").select(F.concat("ledger_id", F.lit("/"), N).alias("bundle"), F.lit("imprint").alias("tsa_error"))
    out = S.verify_segment_bundles(files, wrong)
    return out.select("bundle", "disclosure_class", "artifact_sha256", "failure", "verification_scope", "record_multiset_root",
                      F.array_join("checks_executed", ",").alias("executed"), F.array_join("checks_skipped", ",").alias("skipped"),
                      "tsa_channel", "ots_channel")
