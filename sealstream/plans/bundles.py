"""Registered queries: day bundles, proofs, artifact scans, sinks and export."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.functions import codecs as K
from sealstream.functions import columns as C
from sealstream.functions import proofs as P
from sealstream.functions import values as V
from sealstream.operators import bundles as B
from sealstream.operators import merkle as M
from sealstream.operators.plan import dealt, merged, own_folder, staged
from sealstream.plans import admission as Q
from sealstream.plans import ledger as G
from sealstream.plans import telemetry as T
from sealstream.plans.registry import query
from sealstream.plans.scalars import FACT_JSON
from sealstream.sources import artifacts as A
from sealstream.sources import commits as KC
from sealstream.sources import sinks as K2
from sealstream.sources import tables as ST

# One kind of damage per bundle: number of the day times four plus site, mod 16.
CASE = "(cast(substring(day, 9, 2) as int) * 4 + cast(substring(site_id, 6) as int)) % 16"
DCASE = "(CAST(substr(day, 9, 2) AS INT) * 4 + CAST(substr(site_id, 6) AS INT)) % 16"
BK = f"bk AS (SELECT DISTINCT site_id || '/' || day AS bundle, site_id, day, {DCASE} AS k FROM ev)"
W = f"WITH {T.EV}, {BK}"


def facts(spark, sf):
    """Facts of all events as CBOR, encoded once: the events are dealt to tasks by number, as their file may be one split."""
    ev = T.from_events(dealt(T.table(spark, sf, "events"), ["event_id"], 65536))
    rows = ev.select("site_id", "day", "event_id", F.concat("site_id", F.lit("/"), "day").alias("bundle"),
                     F.expr(CASE).alias("k"), K.json_to_cbor(F.expr(FACT_JSON)).alias("content"))
    return staged(rows).withColumn("path", F.concat(F.lit("facts/"), "event_id", F.lit(".cbor")))


def day_bundles(spark, sf):
    """Tables of verify_day_bundles: bundles, files, facts, audits, sidecars, proofs."""
    own = facts(spark, sf)
    roots = M.merkle_root_v1(own.select("bundle", "site_id", "day", "k", M.leaf_hash_v1("content").alias("leaf")),
                             ["bundle", "site_id", "day", "k"])
    b = roots.select("bundle", "site_id", "day", "k", "leaf_count", C.hex_lower("root").alias("root"))
    batch = "named_struct('batch_id', concat(site_id, '-', day, '-00'), 'count', leaf_count, 'merkle_root', root)"
    b = b.selectExpr(
        "*", "to_json(named_struct('version', 1, 'site_id', site_id, 'day', day, 'batch_id', concat(site_id, '-', day, '-00'), "
        "'merkle_root', root, 'count', leaf_count)) AS block_json",
        "to_json(named_struct('version', 1, 'site_id', site_id, 'date', day, 'prev_day_root', repeat('0', 64), "
        f"'batches', CASE WHEN k = 9 THEN array({batch}, {batch}) WHEN k = 10 THEN filter(array({batch}), x -> false) "
        f"ELSE array({batch}) END, 'day_root', if(k = 13, sha2(root, 256), root))) AS day_json")
    b = staged(b.withColumn("day_cbor", K.json_to_cbor("day_json")))
    b = b.selectExpr(
        "*", "sha2(day_cbor, 256) AS day_sha", "concat('day/', day, '.cbor') AS day_path",
        "concat('blocks/', day, '-00.block.json') AS block_path", "concat('day/', day, '.ots.meta.json') AS meta_path",
        "if(k = 8, './/facts/rejections.ndjson', concat('audit/rejections-', day, '.ndjson')) AS audit_path",
        "CASE k WHEN 6 THEN 'B' WHEN 7 THEN 'C' ELSE 'A' END AS disclosure_class")
    ref = "named_struct('path', {p}, 'sha256', {s})".format
    manifest = f"""to_json(named_struct('version', 1, 'date', day, 'site', site_id, 'device_id', 'pod-1', 'frame_count', leaf_count,
      'facts_dir', if(k = 1, null, 'facts'), 'artifacts', map('block', {ref(p='block_path', s='sha2(block_json, 256)')},
       'day_cbor', {ref(p="CASE k WHEN 2 THEN '../day.cbor' WHEN 0 THEN concat('./', day_path) ELSE day_path END", s="if(k = 3, sha2(day_sha, 256), day_sha)")},
       'rejection_audit', {ref(p='audit_path', s="sha2(bundle, 256)")}, 'day_ots_meta', {ref(p='meta_path', s="sha2('', 256)")}),
      'anchoring', named_struct('policy', named_struct('mode', 'warn'), 'channels', map('ots', named_struct('enabled', true, 'status', 'pending', 'reason', ''))),
      'verification_bundle', named_struct('disclosure_class', disclosure_class, 'commitment_profile_id', if(k = 4, 'other', '{V.PROFILE_V1}'),
       'checks_executed', array('x'), 'checks_skipped', array(named_struct('check', 'x', 'reason', 'y')))))"""
    bundles = b.selectExpr("bundle", "site_id", "day", "k", "disclosure_class", f"'{V.PROFILE_V1}' AS commitment_profile_id",
                           f"{manifest} AS manifest_json", "block_json", "day_json",
                           "if(k = 12, concat(day_cbor, X'00'), day_cbor) AS day_cbor")
    meta = """if(k = 5, to_json(named_struct('day', day)), to_json(named_struct('artifact', concat(if(k = 0, 'a/b/c/d/e/../../../../../', './'), day_path), 'day', if(k = 14, '1999-01-01', day),
      'artifact_sha256', day_sha, 'ots_proof', concat('day/x/../', day, '.cbor.ots'))))"""
    sidecars = b.selectExpr("bundle", f"{meta} AS meta_json", "day_path AS artifact_path", "concat(day_path, '.ots') AS ots_path")
    files = b.selectExpr("bundle", "explode(map(block_path, sha2(block_json, 256), day_path, day_sha, replace(audit_path, './/'), sha2(bundle, 256), "
                         "concat(day_path, '.ots'), sha2('p', 256))) AS (path, sha256)")
    proofs = b.selectExpr("bundle", f"cast(concat('{P.STATIONARY.decode()}', if(k = 15, sha2(day_sha, 256), day_sha), '\\n') as binary) AS proof",
                          "day_sha AS expected_sha256")
    own = own.filter("k <> 5").withColumn("content", F.when(F.col("k") == 11, F.lit(b"\x18\x01")).otherwise(F.col("content")))
    audits = own.filter("event_id % 50 = 0").select("bundle", F.lit(None).cast("string").alias("error"))
    return bundles, files, own.select("bundle", "path", "content"), audits, sidecars, proofs


ERR = """CASE k WHEN 1 THEN 'missing field facts_dir' WHEN 4 THEN 'manifest commitment_profile_id mismatch' WHEN 2 THEN 'manifest artifact path escapes root'
  WHEN 3 THEN 'manifest artifact sha256 mismatch' WHEN 8 THEN 'rejection audit must not be commitment material'
  WHEN 12 THEN 'day artifact is not canonical commitment bytes' WHEN 13 THEN 'day projection does not match block header'
  WHEN 9 THEN 'day projection must contain exactly one batch' WHEN 10 THEN 'day projection must contain exactly one batch'
  WHEN 14 THEN 'OTS metadata validation failed: meta-day-mismatch' WHEN 5 THEN 'OTS metadata validation failed: meta-missing-fields'
  WHEN 11 THEN 'fact artifact is not canonical CBOR: not shortest form' END"""


@query("v10_day_verdicts", f"""{W}, v AS (SELECT *, {ERR} AS error FROM bk) SELECT bundle, error, CASE WHEN k IN (0, 6, 7) THEN 'success' ELSE 'failed' END AS overall,
  k IN (0, 15) AS publicly_recomputable, coalesce(error, CASE WHEN k = 15 THEN 'overall-failed' END) AS export_refusal,
  CASE WHEN error IS NULL THEN 'day_artifact_validation,verification_manifest_validation,batch_metadata_validation,rejection_audit_validation' ||
   CASE WHEN k IN (6, 7) THEN '' ELSE ',fact_level_recompute' END || ',ots_verification' END AS executed,
  CASE WHEN error IS NULL THEN CASE k WHEN 6 THEN 'fact_level_recompute:disclosure-class-b' WHEN 7 THEN 'fact_level_recompute:disclosure-class-c' ELSE '' END END AS skipped,
  CASE WHEN k = 15 THEN 'true:failed:stationary-stub-hash-mismatch' ELSE 'true:pending:stationary-stub-accepted' END AS ots,
  'false:skipped:disabled' AS tsa FROM v""")
def v10(spark, sf):
    def channel(name):
        c = F.col(f"channels.{name}")
        return F.concat_ws(":", c["enabled"].cast("string"), c["status"], c["reason"]).alias(name)
    skipped = F.array_join(F.transform("checks_skipped", lambda c: F.concat(c["check"], F.lit(":"), c["reason"])), ",")
    return B.verify_day_bundles(*day_bundles(spark, sf)).select(
        "bundle", "error", "overall", "publicly_recomputable", "export_refusal", F.array_join("checks_executed", ",").alias("executed"),
        skipped.alias("skipped"), channel("ots"), channel("tsa"))


@query("v01_manifest_identity", f"{W} SELECT bundle, CASE k WHEN 1 THEN 'missing field facts_dir' WHEN 4 THEN 'manifest commitment_profile_id mismatch' END AS identity_error FROM bk")
def v01(spark, sf):
    return B.check_manifest_identity(B.parse_bundles(day_bundles(spark, sf)[0])).select("bundle", "identity_error")


@query("v02_audit_placement", f"""{W}, n AS (SELECT site_id || '/' || day AS bundle, count(*) AS c FROM ev WHERE event_id % 50 = 0 AND {DCASE} <> 5 GROUP BY 1)
  SELECT bundle, coalesce(c, 0) AS rejection_records, CASE WHEN k = 8 THEN 'rejection audit must not be commitment material' END AS audit_error FROM bk LEFT JOIN n USING (bundle)""")
def v02(spark, sf):
    d = day_bundles(spark, sf)
    return B.check_audit_placement(B.parse_bundles(d[0]), d[3]).select("bundle", "rejection_records", "audit_error")


@query("v03_day_bytes", f"{W} SELECT bundle, CASE WHEN k = 12 THEN 'day artifact is not canonical commitment bytes' END AS bytes_error FROM bk")
def v03(spark, sf):
    return B.check_day_bytes(day_bundles(spark, sf)[0]).select("bundle", "bytes_error")


@query("v04_day_projection", f"""{W} SELECT bundle, CASE WHEN k = 13 THEN 'day projection does not match block header'
  WHEN k IN (9, 10) THEN 'day projection must contain exactly one batch' END AS projection_error FROM bk""")
def v04(spark, sf):
    return B.check_day_projection(B.parse_bundles(day_bundles(spark, sf)[0])).select("bundle", "projection_error")


@query("v05_class_a_recompute", f"""{W} SELECT bundle, CASE WHEN k = 5 THEN 'CBOR facts are required for Class A verification'
  WHEN k = 11 THEN 'fact artifact is not canonical CBOR: not shortest form' END AS facts_error, CASE WHEN k NOT IN (5, 6, 7, 11) THEN true END AS root_match FROM bk""")
def v05(spark, sf):
    d = day_bundles(spark, sf)
    return B.recompute_class_a_v1(B.parse_bundles(d[0]), d[2]).select("bundle", "facts_error", "root_match")


@query("v06_skipped_checks", f"""{W} SELECT bundle, 'day_artifact_validation,verification_manifest_validation,batch_metadata_validation,rejection_audit_validation' ||
  CASE WHEN k IN (6, 7) THEN '' ELSE ',fact_level_recompute' END || ',ots_verification' AS executed, CASE k WHEN 6 THEN 'disclosure-class-b' WHEN 7 THEN 'disclosure-class-c' END AS skip_reason FROM bk""")
def v06(spark, sf):
    d = day_bundles(spark, sf)
    b = d[0].withColumns({"has_audit": F.lit(True), "ots_enabled": F.lit(True)})
    return B.skipped_checks_v1(b).select("bundle", F.array_join("checks_executed", ",").alias("executed"), "skip_reason")


@query("v07_sidecars", f"""{W} SELECT bundle, CASE WHEN k IN (5, 14) THEN 'failed' ELSE 'verified' END AS status,
  CASE k WHEN 5 THEN 'meta-missing-fields' WHEN 14 THEN 'meta-day-mismatch' ELSE 'meta-valid' END AS reason FROM bk""")
def v07(spark, sf):
    d = day_bundles(spark, sf)
    return B.check_sidecars(d[4], d[1]).select("bundle", "status", "reason")


# Proof bytes per reading: stub, placeholder, pending proof, height proof, damaged, absent.
_MAGIC = P.MAGIC.hex()
PROOF = """CASE event_id % 9 WHEN 0 THEN {stub} WHEN 1 THEN {hex}('  OTS_PROOF_PLACEHOLDER ') WHEN 2 THEN '{m}' || '0108' || {d} || 'f00411223344' || '08' || '0083dfe30d2ef90c8e' || '06' || '05' || {hex}('a.b/c')
  WHEN 3 THEN '{m}' || '0108' || {d} || '08' || '000588960d73d71901' || '03' || 'f7ef15' WHEN 4 THEN '{m}' || '0208' || {d} WHEN 5 THEN NULL
  WHEN 6 THEN '{m}' || '0108' || {d2} || '08' WHEN 7 THEN '{m}' || '0108' || {d} || '07' ELSE '{m}' || '0108' || {d} || 'ff0083dfe30d2ef90c8e020141' || '08000588960d73d719010105' || '00' END"""
SPROOF = PROOF.format(m=_MAGIC, d="d", d2="sha2(d, 256)", hex="hex", stub="hex(concat('STATIONARY-OTS:', d))")
DPROOF = PROOF.format(m=_MAGIC, d="d", d2="sha256(d)", hex="hex", stub="hex('STATIONARY-OTS:' || d)")


def proofs(spark, sf):
    ev = T.events(spark, sf).selectExpr("event_id", "sha2(cast(event_id as string), 256) AS d")
    return ev.selectExpr("event_id", f"unhex({SPROOF}) AS proof", "d AS expected_sha256")


@query("v09_parse_proofs", f"""SELECT event_id, CASE event_id % 9 WHEN 4 THEN 'ots-unsupported-version' WHEN 6 THEN 'ots-proof-artifact-hash-mismatch' WHEN 8 THEN 'ots-proof-trailing-garbage' END AS error,
  event_id % 9 IN (2, 3, 4, 6, 8) AS supported, CASE event_id % 9 WHEN 2 THEN 'append 11223344|sha256|verify PendingAttestation(a.b/c)'
  WHEN 3 THEN 'sha256|verify BitcoinBlockHeaderAttestation(358391)' ELSE '' END AS steps FROM events""")
def v09(spark, sf):
    return B.parse_proofs(proofs(spark, sf)).select(
        "event_id", "parsed.error", "parsed.supported", F.array_join("parsed.steps", "|").alias("steps"))


@query("v08_triage_proofs", f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending' WHEN 2 THEN 'pending' WHEN 5 THEN 'missing' ELSE 'failed' END AS status,
  CASE event_id % 9 WHEN 0 THEN 'stationary-stub-accepted' WHEN 1 THEN 'placeholder-accepted' WHEN 2 THEN 'ots-pending-attestation' WHEN 4 THEN 'ots-unsupported-version'
  WHEN 5 THEN 'ots-proof-not-found' WHEN 6 THEN 'ots-proof-artifact-hash-mismatch' WHEN 8 THEN 'ots-proof-trailing-garbage' ELSE 'ots-binary-not-found' END AS reason,
  CASE event_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending' WHEN 2 THEN 'pending' WHEN 3 THEN 'attested-unverified' WHEN 5 THEN 'missing' ELSE 'failed' END AS own_status FROM events""")
def v08(spark, sf):
    return B.triage_proofs(B.parse_proofs(proofs(spark, sf)), True).select("event_id", "status", "reason", "own_status")


@query("u04_describe_proof", f"""SELECT event_id, CAST(0 AS BIGINT) AS step_no, CASE event_id % 9 WHEN 2 THEN 'append 11223344' ELSE 'sha256' END AS step FROM events WHERE event_id % 9 IN (2, 3)
  UNION ALL SELECT event_id, 1, CASE event_id % 9 WHEN 2 THEN 'sha256' ELSE 'verify BitcoinBlockHeaderAttestation(358391)' END FROM events WHERE event_id % 9 IN (2, 3)
  UNION ALL SELECT event_id, 2, 'verify PendingAttestation(a.b/c)' FROM events WHERE event_id % 9 = 2""")
def u04(spark, sf):
    P.register_describe(spark)
    return T.big(spark.sql("SELECT event_id, step_no, step FROM {rows}, LATERAL describe_proof(proof)", rows=proofs(spark, sf)))


# --- files written by Spark and scanned again ---

folder = own_folder


FILES = 1 << 20  # files of a scan that lie on the disk at a time


def scanned(spark, sf, scan):
    """Day bundles as files (manifest, block, day JSON and CBOR, and every fact), and what ``scan`` finds in their folder. A file takes a
    block of the disk and a node of its tables however small it is, so of many files a part is written, scanned and removed after the other.
    The documents of a bundle lie in one part, its facts in all of them; a path written twice lies in one."""
    bundles, _, own, *_ = day_bundles(spark, sf)
    name = F.concat("bundle", F.lit("/"))
    docs = bundles.select("bundle", F.explode(F.map_from_arrays(
        F.array(F.concat(name, F.lit("day/"), "day", F.lit(".verify.json")), F.concat(name, F.lit("blocks/"), "day", F.lit("-00.block.json")),
                F.concat(name, F.lit("day/"), "day", F.lit(".json")), F.concat(name, F.lit("day/"), "day", F.lit(".cbor"))),
        F.array(F.when(F.col("k") == 2, F.lit(b"{\xff}")).otherwise(C.text_bytes("manifest_json")), C.text_bytes("block_json"), C.text_bytes("day_json"), F.col("day_cbor")))).alias("path", "bytes"))
    facts_ = own.select(F.concat(name, "path").alias("path"), F.col("content").alias("bytes"))
    parts, found = max(1, -(-(own.count() + 4 * bundles.count()) // FILES)), []
    docs = staged(docs) if parts > 1 else docs
    for k in range(parts):
        of = lambda key: F.pmod(F.xxhash64(key), F.lit(parts)) == k  # noqa: B023, E731
        root = folder(spark, "bundles")
        A.write_files(docs.filter(of("bundle")).select("path", "bytes").unionByName(facts_.filter(of("path"))), root)
        found.append(scan(spark, root))
        if parts > 1:
            found[-1] = staged(found[-1])
            A.remove_files(spark, root)
    return reduce(DataFrame.unionByName, found)


# One manifest is not UTF-8 text.
@query("s05_day_bundle_scan", f"""{W} SELECT bundle, CASE WHEN k <> 2 THEN site_id END AS site, day, CASE WHEN k <> 2 THEN CAST(1 AS BIGINT) END AS version,
  k <> 12 AS canonical FROM bk""")
def s05(spark, sf):
    rows = B.check_day_bytes(B.parse_bundles(scanned(spark, sf, A.scan_day_bundles)))
    return T.big(rows.select("bundle", F.col("manifest.site").alias("site"), F.col("block.day").alias("day"),
                             F.col("manifest.version").alias("version"), F.col("bytes_error").isNull().alias("canonical")))


@query("s04_fact_scan", f"""{W} SELECT site_id || '/' || day AS bundle, 'facts/' || event_id || '.cbor' AS path FROM ev WHERE {DCASE} <> 5""")
def s04(spark, sf):
    return scanned(spark, sf, lambda s, root: A.scan_fact_artifacts(s, root).select("bundle", "path"))


@query("s06_segment_bundle_scan", f"""{G.CW} SELECT ledger_id || '/' || segment_number AS bundle,
  CASE WHEN segment_number % 17 <> 9 THEN CAST(2 AS BIGINT) END AS version, sha AS sha256 FROM chn""")
def s06(spark, sf):
    from sealstream.plans.segments import bundle_files
    files = bundle_files(spark, sf)[0].filter("path IN ('segment.verify.json', 'segments/s.cbor')")
    root = folder(spark, "segments")
    A.write_files(files.select(F.concat("bundle", F.lit("/"), "path").alias("path"), F.col("content").alias("bytes")), root)
    manifests, found = A.scan_segment_bundles(spark, root)
    return T.big(manifests.select("bundle", F.get_json_object("manifest_json", "$.version").cast("int").alias("version"))
                 .join(found.filter("path = 'segments/s.cbor'").select("bundle", "sha256"), "bundle"))


@query("s08_rejection_sink", f"""{Q.ADMW}, rej AS (SELECT reason, e.day FROM adm a JOIN ev e USING (event_id) WHERE reason IS NOT NULL) SELECT day, reason, count(*) AS n FROM rej GROUP BY ALL""")
def s08(spark, sf):
    from sealstream.operators import admission as D
    _, bad = D.split_admission(Q.admitted(spark, sf))
    root = folder(spark, "audit")
    K2.write_rejections(bad.select(
        F.col("dev_id").cast("string").alias("device_id"), "fc", "reason", C.format_rfc3339("ingest_time").alias("observed_at_utc"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("frame_sha256"), "source", C.utc_day("ingest_time").alias("day")), root)
    back = spark.read.schema(ST.REJECTION + ", day string").json(f"{root}/rejections")
    return back.groupBy("day", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("s10_sealed_sink", f"""WITH {T.EV}, {T.REC} SELECT ledger_id, event_id AS seq, sha256(unhex(record_hex)) AS sha256, event_id % 2 + 1 AS revision,
  CAST(2 AS BIGINT) AS refused FROM rec""")
def s10(spark, sf):
    """Two transitions, and two writers that expect a revision which is gone: their rows do not show."""
    root = folder(spark, "sealed")
    rec = G.records(spark, sf)
    refused = 0
    for part, expected in ((0, None), (0, None), (1, 1), (0, 1)):
        half = rec.filter(F.col("seq") % 2 == part)
        try:
            KC.commit_transition(spark, root, expected, {"segments": half.select("ledger_id").distinct(), "outcomes": half.select("ledger_id", "seq"),
                                                         "records": half.select("ledger_id", "seq", "record")})
        except KC.StaleRevision:
            refused += 1
    return KC.read_committed(spark, root, "records").select(
        "ledger_id", "seq", C.sha256_hex("record").alias("sha256"), "revision", F.lit(refused).cast("bigint").alias("refused"))


@query("s11_fact_export", f"""{Q.ADMW} SELECT e.day, e.site_id, h.sample_type, count(*) AS n, CAST(sum(h.cents) AS BIGINT) AS cents FROM adm h JOIN ev e USING (event_id)
  WHERE reason IS NULL GROUP BY ALL""")
def s11(spark, sf):
    from sealstream.operators import admission as D
    ok, _ = D.split_admission(Q.admitted(spark, sf))
    shaped = D.shape_facts(ok, "ingest_time").join(T.events(spark, sf).select("arrival_seq", "day", "site_id"), "arrival_seq")
    root = folder(spark, "facts")
    K2.export_facts_parquet(shaped, root)
    back = spark.read.parquet(root)
    code = F.create_map(*[F.lit(x) for c, n, _ in V.SAMPLE_TYPES[:5] for x in (n, c)])
    return T.big(back.groupBy(F.col("day").cast("string").alias("day"), "site_id", code[F.col("sample_type")].alias("sample_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("value").cast("double") * 4).cast("bigint")).alias("cents")))


@query("s12_verified_export", f"""{W}, g AS (SELECT *, 'site/' || site_id || '/day/' || day || '/' AS root FROM bk WHERE k IN (0, 6, 7)),
  f AS (SELECT root || 'facts/' || event_id || '.cbor' AS path FROM ev JOIN g USING (site_id, day)
   UNION ALL SELECT root || unnest(['blocks/' || day || '-00.block.json', 'day/' || day || '.cbor', 'audit/rejections-' || day || '.ndjson',
     'day/' || day || '.verify.json', 'day/' || day || '.ots.meta.json']) FROM g UNION ALL SELECT 'index.json')
  SELECT path, true AS as_expected FROM f""")
def s12(spark, sf):
    """Every file of the export, read back: copies against their sources, rewritten texts by their fields, the index by its entries."""
    bundles, _, own, audits, sidecars, proofs = d = day_bundles(spark, sf)
    verdicts = staged(B.verify_day_bundles(*d))
    name, text = (lambda *p: F.concat(*[F.lit(x) if "/" in x or "." in x else F.col(x) for x in p])), C.text_bytes
    files = staged(bundles.select("bundle", F.explode(F.map_from_arrays(
        F.array(name("blocks/", "day", "-00.block.json"), name("day/", "day", ".cbor"), name("audit/rejections-", "day", ".ndjson")),
        F.array(text("block_json"), F.col("day_cbor"), text("bundle")))).alias("path", "content")))
    root = folder(spark, "export")
    index = K2.export_bundles(verdicts, files, own.select("bundle", "path", "content"), sidecars.select("bundle", "meta_json"), root)
    back = A.scan_files(spark, root).select(F.concat_ws("/", F.when(F.col("bundle") != "", F.col("bundle")), "path").alias("path"), "content", "sha256")
    back = staged(back)
    place = F.concat(F.lit("site/"), F.regexp_replace("bundle", "/", "/day/"), F.lit("/"), "path")
    sources = files.unionByName(own.select("bundle", "path", "content")).select(
        place.alias("path"), F.sha2("content", 256).alias("_source"))
    side = back.filter("path LIKE '%.ots.meta.json'").select(
        F.replace("path", F.lit(".ots.meta.json"), F.lit(".verify.json")).alias("path"), F.col("sha256").alias("_side"))
    j = lambda p: F.get_json_object(C.utf8("content"), p)
    day = F.regexp_extract("path", "day/([0-9-]+)/", 1)
    kind = back.join(merged(sources), "path", "left").join(side, "path", "left")
    manifest = (j("$.frames_file").isNull() & (j("$.artifacts.day_ots_meta.sha256") == F.col("_side")) & (j("$.verifier.overall") == "success")
                & (j("$.verification_bundle.checks_executed[0]") == "day_artifact_validation") & j("$.anchoring").isNotNull())
    meta = (j("$.artifact") == F.concat(F.lit("day/"), day, F.lit(".cbor"))) & j("$.milestone").isNull() & (j("$.day") == day)
    entries = F.size(F.from_json(j("$.exports"), "array<struct<site:string>>")) == index.count()
    return kind.select("path", F.when(F.col("path").endswith(".verify.json"), manifest).when(F.col("path").endswith(".ots.meta.json"), meta)
                       .when(F.col("path") == "index.json", entries).otherwise(F.col("sha256") == F.col("_source")).alias("as_expected"))


@query("s14_header_sidecars", """WITH h AS (SELECT o_custkey AS archive, o_orderkey AS height, sha256('' || o_orderkey) || sha256('x' || o_orderkey) || '00112233445566778899aabbccddee00' AS header FROM orders)
  SELECT height, sha256(unhex(header)) AS header_sha256, CAST(NULL AS VARCHAR) AS error FROM h WHERE archive % 10 NOT IN (3, 4)
  UNION ALL SELECT NULL, NULL, CASE archive % 10 WHEN 3 THEN 'truncated' ELSE 'repeated height' END FROM (SELECT DISTINCT archive FROM h WHERE archive % 10 IN (3, 4))""")
def s14(spark, sf):
    o = T.table(spark, sf, "orders").selectExpr(
        "o_custkey AS archive", "o_orderkey AS height", "concat(sha2(cast(o_orderkey as string), 256), "
        "sha2(concat('x', o_orderkey), 256), '00112233445566778899aabbccddee00') AS header")
    le = C.hex_lower(C.reverse_bytes(C.uint_be("height", 4)))
    # One archive per customer, its orders as records: bounded by the orders of one customer.
    packed = o.groupBy("archive").agg(F.array_sort(F.collect_list(F.concat(le, "header"))).alias("r"))
    head = "4f545356" + "01000000" + "00" * 8
    files = packed.select(F.col("archive").cast("string").alias("path"), F.unhex(F.concat(
        F.lit(head), F.array_join("r", ""), F.when(F.col("archive") % 10 == 4, F.get("r", F.lit(0))).otherwise(""), F.when(F.col("archive") % 10 == 3, "00").otherwise(""))).alias("content"))
    return A.explode_headers(files).select("height", F.when(F.col("error").isNull(), F.col("header_sha256")).alias("header_sha256"), "error")


@query("s03_provisioning", """SELECT lpad(lower(to_hex(c_custkey)), 16, '0') AS pod_id, 'site-' || n_name AS site_id, c_name AS identity_pubkey,
  CASE WHEN c_custkey % 2 = 0 THEN 'dep-' || c_mktsegment ELSE 'site-dep' END AS sensor FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def s03(spark, sf):
    c = T.table(spark, sf, "customer").join(T.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # One bundle per 16 customers of a nation, as devices are provisioned in small lots.
    rec = F.struct(C.pod_id_hex("c_custkey").alias("pod_id"), F.col("c_name").alias("identity_pubkey"), F.when(
        F.col("c_custkey") % 2 == 0, F.struct(F.concat(F.lit("dep-"), "c_mktsegment").alias("deployment_sensor_key"))).alias("deployment"))
    docs = c.groupBy("n_name", F.expr("c_custkey div 16")).agg(F.collect_list(rec).alias("records")).select(F.to_json(F.struct(
        F.concat(F.lit("site-"), "n_name").alias("site_id"),
        F.struct(F.lit("site-dep").alias("deployment_sensor_key")).alias("deployment"), "records")).alias("value"))
    return ST.explode_provisioning(docs).select("pod_id", "site_id", "identity_pubkey",
                                                F.col("deployment.deployment_sensor_key").alias("sensor"))
