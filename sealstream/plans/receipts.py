"""Registered queries: anchor receipts and the registered codec functions."""

from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.functions.register import register_codecs
from sealstream.operators import observe as O
from sealstream.operators import receipts as R
from sealstream.operators.plan import dealt, pinned
from sealstream.plans import analytics as N
from sealstream.plans import frames as P
from sealstream.plans import telemetry as T
from sealstream.plans.registry import query
from sealstream.plans.scalars import FACT_CBOR, FACT_JSON

SHA = "sha2(concat('{}', o_orderkey), 256)".format
K = "o_orderkey % 20"

SUBJECT = f"""to_json(named_struct('schema', if({K} = 3, 'other', 'subject-v1'), 'version', 1, 'repository', 'r', 'git_commit', concat('c', o_orderkey),
 'bundle_verifier', named_struct('path', 'verify.py', 'sha256', if({K} = 4, {SHA('x')}, {SHA('v')})),
 'conformance_archive', named_struct('manifest_sha256', {SHA('m')}), 'independent_verification', named_struct('sha256', {SHA('i')}),
 'ots_verifier_sanity', named_struct('sha256', {SHA('s')}, 'json_client_commit', 'jc', 'headers_client_commit', 'hc')))"""
STATE = f"CASE WHEN {K} = 7 THEN 'stationary' WHEN {K} IN (8, 9, 10, 11, 12, 13) THEN 'bitcoin-header-quorum-verified' WHEN {K} = 14 THEN 'unheard' ELSE 'calendar-pending' END"
HEAD = f"named_struct('height', o_orderkey, 'block_hash', 'b', 'merkle_root', {SHA('r')}, 'header_sha256', 'h')"
RECEIPT = f"""to_json(named_struct('schema', if({K} = 1, 'other', 'evidence-v1'), 'version', 1, 'subject', named_struct('path', 'subject.json', 'sha256', {SHA('u')}),
 'bundle_verifier', named_struct('path', 'verify.py', 'sha256', {SHA('v')}), 'provenance', named_struct('path', 'provenance.json', 'sha256', {SHA('p')}, 'source_ci_run_id', 'run'),
 'conformance', named_struct('manifest', named_struct('path', 'manifest.json', 'sha256', {SHA('m')}), 'independent_verification', named_struct('path', if({K} = 2, '../i.json', 'i.json'), 'sha256', {SHA('i')})),
 'proof', named_struct('state', {STATE}, 'path', if({K} = 7, null, 'subject.ots'), 'sha256', if({K} = 7, null, {SHA('o')}), 'file_digest', if({K} = 7, null, if({K} = 15, {SHA('z')}, {SHA('u')})),
  'pending_calendars', if({K} = 16, filter(array('c'), x -> false), array('https://c')), 'bitcoin_heights', CASE WHEN {K} BETWEEN 8 AND 12 THEN array(o_orderkey) WHEN {K} = 13 THEN array(o_orderkey, o_orderkey + 1) ELSE filter(array(o_orderkey), x -> false) END),
 'verification', named_struct('subject_binding', {K} <> 7, 'method', CASE WHEN {K} = 9 THEN 'guess' WHEN {K} BETWEEN 8 AND 13 THEN 'public-header-source-quorum' ELSE 'none' END, 'full_bitcoin_consensus_validated', {K} = 17,
  'configured_header_sources', if({K} = 18, array('https://a', 'https://a'), array('https://a', 'https://b')), 'required_header_quorum', 2,
  'bitcoin_headers', CASE WHEN {K} = 10 THEN filter(array({HEAD}), x -> false) WHEN {K} BETWEEN 8 AND 13 THEN array({HEAD}) ELSE filter(array({HEAD}), x -> false) END,
  'header_sidecar', if({K} BETWEEN 8 AND 13 AND {K} <> 11, named_struct('path', 'headers.bin', 'sha256', {SHA('d')}), null), 'sanity', named_struct('path', 'sanity.json', 'sha256', {SHA('s')})),
 'upstream', named_struct('stable_client', if({K} = 19, 'client', 'opentimestamps-client==0.7.2'), 'json_client', named_struct('commit', 'jc'))), map('ignoreNullFields', 'false'))"""


@query("v19_anchor_receipts", """SELECT o_orderkey AS anchor_id, CASE o_orderkey % 20 WHEN 1 THEN 'receipt version' WHEN 2 THEN 'independent_verification reference' WHEN 3 THEN 'subject version'
  WHEN 4 THEN 'bundle verifier' WHEN 5 THEN 'provenance' WHEN 6 THEN 'sanity' WHEN 9 THEN 'header method' WHEN 10 THEN 'header records' WHEN 11 THEN 'quorum claim without sidecar'
  WHEN 13 THEN 'header coverage' WHEN 14 THEN 'unknown proof state' WHEN 15 THEN 'proof binding' WHEN 16 THEN 'pending without calendar' WHEN 17 THEN 'consensus overclaim'
  WHEN 18 THEN 'header quorum' WHEN 19 THEN 'upstream client' END AS error FROM orders""")
def v19(spark, sf):
    # Dealt by key while a row is a number: a file of few row groups would make and parse all documents in few tasks.
    o = dealt(T.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 16384)
    r = pinned(o, {"receipt": F.expr(RECEIPT), "subject": F.expr(SUBJECT)}).selectExpr(
        "o_orderkey AS anchor_id", "receipt", "subject",
        f"to_json(named_struct('repository', 'r', 'git_commit', if({K} = 5, 'x', concat('c', o_orderkey)), 'source_ci_run_id', 'run')) AS provenance",
        "to_json(named_struct('repository', 'r', 'subject', named_struct('git_commit', concat('c', o_orderkey)))) AS manifest",
        "to_json(named_struct('ok', true, 'subject', named_struct('git_commit', concat('c', o_orderkey)))) AS independent",
        f"to_json(named_struct('schema', 'sanity-v1', 'ok', {K} <> 6, 'clients', named_struct('json', named_struct('commit', 'jc'), 'headers', named_struct('commit', 'hc')))) AS sanity")
    names = {"subject.json": "u", "verify.py": "v", "provenance.json": "p", "manifest.json": "m", "i.json": "i",
             "subject.ots": "o", "headers.bin": "d", "sanity.json": "s"}
    pairs = ", ".join(f"'{n}', {SHA(c)}" for n, c in names.items())
    files = o.selectExpr("o_orderkey AS anchor_id", f"explode(map({pairs})) AS (path, sha256)")
    headers = o.filter(f"{K} BETWEEN 8 AND 13").selectExpr("o_orderkey AS anchor_id", f"inline(array({HEAD}))")
    return R.check_anchor_receipts(r, files, headers, "evidence-v1", "subject-v1", "sanity-v1").select("anchor_id", "error")


@query("u01_registered_codecs", f"""WITH {T.EV} SELECT event_id, sha256(unhex({FACT_CBOR})) AS cbor_sha256 FROM ev""")
def u01(spark, sf):
    register_codecs(spark)
    text = T.events(spark, sf).select("event_id", F.expr(FACT_JSON).alias("fact_json"))
    return spark.sql("SELECT event_id, sha2(json_to_cbor(fact_json), 256) AS cbor_sha256 FROM {rows}", rows=text)


@query("u03_fixture_frames", f"""WITH {T.EV} SELECT event_id, substr(sha256('salt' || dev_id), 1, 16) || lower(lpad(to_hex(fc), 16, '0') || lpad(to_hex(dev_id), 4, '0') || lpad(to_hex(fc), 12, '0')) AS nonce,
  true AS sealed FROM ev""")
def u03(spark, sf):
    f = P.make_fixture_frames(P.fixture_readings(spark, sf))
    return f.select("event_id", C.hex_lower("nonce").alias("nonce"),
                    ((F.octet_length("tag") == 16) & F.octet_length("ct").between(1, 256)).alias("sealed"))


@query("u05_projection", f"""WITH {T.EV}, {N.ENTS} SELECT stream_key, count(*) AS n, count(DISTINCT datastream_id) AS streams FROM prj GROUP BY 1""")
def u05(spark, sf):
    df = O.project_observations(N.inputs(spark, sf).filter("reason is null"))
    one = df.groupBy("stream_key", "datastream_id").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("stream_key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("streams"))
