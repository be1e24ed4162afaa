"""Registered queries: scalar functions and single-row predicates."""

from pyspark.sql import functions as F

from sealstream.functions import codecs as K
from sealstream.functions import columns as C
from sealstream.functions import values as V
from sealstream.operators.plan import pinned
from sealstream.plans import telemetry as T
from sealstream.plans.registry import query

W = f"WITH {T.EV}"


@query("f01_sha256_hex", """SELECT doc_id, sha256(text) AS digest, lower(hex(encode(lang))) AS lang_hex FROM documents""")
def f01(spark, sf):
    return T.table(spark, sf, "documents").select(
        "doc_id", C.sha256_hex("text").alias("digest"), C.hex_lower(C.text_bytes("lang")).alias("lang_hex"))


FACT_JSON = "'{\"pod_id\": \"' || pod_id || '\", \"payload\": {\"k\": ' || cents || ', \"b\": [true, null]}, \"fc\": ' || fc || ', \"kind\": \"env.sample\"}'"


@query("f02_canonical_json", f"""{W} SELECT event_id, '{{"fc":' || fc || ',"kind":"env.sample","payload":{{"b":[true,null],"k":'
  || cents || '}},"pod_id":"' || pod_id || '"}}' AS canonical FROM ev""")
def f02(spark, sf):
    return T.events(spark, sf).select("event_id", K.canonical_json(F.expr(FACT_JSON)).alias("canonical"))


FACT_CBOR = (f"'A4' || '626663' || {T.duck_head(0, 'fc')} || '646B696E64' || {T.duck_text(chr(39) + 'env.sample' + chr(39))}"
             f" || '66706F645F6964' || {T.duck_text('pod_id')} || '677061796C6F6164' || 'A2' || '6162' || '82F5F6' || '616B' || {T.duck_head(0, 'cents')}")


@query("f03_json_to_cbor", f"{W} SELECT event_id, lower({FACT_CBOR}) AS cbor FROM ev")
def f03(spark, sf):
    return T.events(spark, sf).select("event_id", C.hex_lower(K.json_to_cbor(F.expr(FACT_JSON))).alias("cbor"))


# IEEE 754 single precision, by arithmetic on powers of two, of a value that is rounded to it already.
F32 = """CASE WHEN v = 0 THEN '00000000' ELSE lpad(to_hex(CAST(CASE WHEN v < 0 THEN 2147483648 ELSE 0 END + (floor(log2(abs(v))) + 127) * 8388608
  + (abs(v) / pow(2, floor(log2(abs(v)))) - 1) * 8388608 AS BIGINT)), 8, '0') END"""


@query("f04_positional_cbor", f"""{W}, r AS (SELECT *, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM ev) SELECT event_id, lower('8701' || '48' || pod_id || {T.duck_head(0, 'fc')} ||
  {T.duck_head(0, 'ingest_time')} || 'f6' || '01' || '82' || '00' || '8b' || '01' || {T.duck_head(0, 'sample_type')} || {T.duck_head(0, 'ingest_time')} ||
  {T.duck_head(0, 'ingest_time')} || 'fa' || {F32} || 'f6f6f6' || '01' || 'f6f6') AS cbor FROM r""")
def f04(spark, sf):
    from sealstream.operators.ledger import positional_cbor
    ev = T.events(spark, sf).select(
        "event_id", F.unhex("pod_id").alias("pod_id"), "fc", "ingest_time",
        F.lit(None).cast("bigint").alias("pod_time"), F.lit(1).alias("kind"), "sample_type",
        F.col("ingest_time").alias("start"), F.col("ingest_time").alias("end"),
        F.col("value").cast("float").alias("value"), *[F.lit(None).cast("float").alias(n)
                                                       for n in ("min", "max", "mean", "quality")],
        F.lit(1).alias("count"), F.lit(None).cast("int").alias("sensor_channel"))
    return ev.select("event_id", C.hex_lower(positional_cbor()).alias("cbor"))


@query("f05_cbor_head", f"""{W} SELECT event_id, lower({T.duck_head(0, 'event_id')}) AS a, lower({T.duck_head(3, 'ingest_time')}) AS b,
  lower({T.duck_head(4, '(t_ms * 1000)')}) AS c FROM ev""")
def f05(spark, sf):
    return T.events(spark, sf).select(
        "event_id", C.hex_lower(C.cbor_head(0, "event_id")).alias("a"),
        C.hex_lower(C.cbor_head(3, "ingest_time")).alias("b"),
        C.hex_lower(C.cbor_head(4, "(t_ms * 1000)")).alias("c"))


_BASE = "strftime(to_timestamp(ingest_time), '%Y-%m-%dT%H:%M:%S')"


def _texts(base: str) -> str:
    return f"""CASE event_id % 9 WHEN 0 THEN {base} || 'Z' WHEN 1 THEN {base} || '+01:30' WHEN 2 THEN {base} || '.125Z'
  WHEN 3 THEN substr({base}, 1, 5) || '13' || substr({base}, 8) || 'Z' WHEN 4 THEN substr({base}, 1, 17) || '60Z'
  WHEN 5 THEN {base} || 'z' WHEN 6 THEN {base} || '-00:45' WHEN 7 THEN substr({base}, 1, 8) || '31' || substr({base}, 11) || 'Z'
  ELSE {base} || '.Z' END"""


@query("f06_parse_rfc3339", f"""{W} SELECT event_id, text, CASE event_id % 9 WHEN 0 THEN ingest_time WHEN 1 THEN ingest_time - 5400
  WHEN 2 THEN ingest_time WHEN 6 THEN ingest_time + 2700
  WHEN 7 THEN CAST(epoch(try_strptime(substr(text, 1, 19), '%Y-%m-%dT%H:%M:%S')) AS BIGINT) END AS seconds
  FROM (SELECT *, {_texts(_BASE)} AS text FROM ev)""")
def f06(spark, sf):
    ev = T.events(spark, sf).withColumn("b", F.substring(C.format_rfc3339("ingest_time"), 1, 19))
    return ev.select("event_id", F.expr(_texts("b")).alias("text")).withColumn(
        "seconds", C.parse_rfc3339("text"))


@query("f07_format_rfc3339", f"{W} SELECT event_id, {_BASE} || 'Z' AS text FROM ev")
def f07(spark, sf):
    return T.events(spark, sf).select("event_id", C.format_rfc3339("ingest_time").alias("text"))


@query("f08_entity_id", f"""{W} SELECT event_id, 'vt:thing:' || sha256('thing' || chr(31) || pod_id) AS thing,
  'vt:datastream:' || sha256('datastream' || chr(31) || pod_id || chr(31) || site_id || chr(31) || 'raw') AS stream FROM ev""")
def f08(spark, sf):
    return T.events(spark, sf).select(
        "event_id", C.entity_id("thing", "pod_id").alias("thing"),
        C.entity_id("datastream", "pod_id", "site_id", F.lit("raw")).alias("stream"))


@query("f09_sensor_key", f"""{W} SELECT event_id, 'prov-' || substr(sha256(pod_id), 1, 16) || '-' ||
  CASE WHEN event_id % 2 = 0 THEN 'ch' || (event_id % 256) ELSE replace('temperature_air', '_', '-') END AS sensor_key FROM ev""")
def f09(spark, sf):
    return T.events(spark, sf).select("event_id", C.derived_sensor_key(
        "pod_id", F.lit("temperature_air"), F.expr("CASE WHEN event_id % 2 = 0 THEN event_id % 256 END")).alias("sensor_key"))


@query("f10_pod_id", """SELECT o_custkey, lpad(lower(to_hex(o_custkey)), 16, '0') AS pod_id, o_custkey % 65536 AS dev_id
  FROM (SELECT DISTINCT o_custkey FROM orders)""")
def f10(spark, sf):
    df = T.table(spark, sf, "orders").select("o_custkey").distinct().withColumn("pod_id", C.pod_id_hex("o_custkey"))
    return T.big(df.withColumn("dev_id", C.dev_id_of("pod_id")))


B64S = """CASE event_id % 5 WHEN 0 THEN {b} WHEN 1 THEN substr({b}, 1, 7) WHEN 2 THEN replace({b}, '=', '')
  WHEN 3 THEN '*' || {b} ELSE substr({b}, 1, 2) || '==' END"""


@query("f11_base64", f"""{W} SELECT event_id, CASE WHEN regexp_full_match(t, '([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?')
  AND to_base64(from_base64(t)) = t THEN lower(hex(from_base64(t))) END AS bytes
  FROM (SELECT event_id, {B64S.format(b="to_base64(encode(pod_id || event_id))")} AS t FROM ev)""")
def f11(spark, sf):
    df = T.events(spark, sf).withColumn("b", F.base64(C.text_bytes(F.concat("pod_id", "event_id"))))
    return df.select("event_id", C.hex_lower(C.b64_or_null(F.expr(B64S.format(b="b")))).alias("bytes"))


# An 80-byte header per reading: two digests, 8 bytes, compact target bits, 4 bytes.
HEADER = ("{sha_a} || {sha_b} || '0011223344556677' || CASE event_id % 4 WHEN 0 THEN 'ffff7f20' WHEN 1 THEN 'ffff0f20'"
          " WHEN 2 THEN '00ff0021' ELSE '0000801f' END || 'aabbccdd'")
DREV = "array_to_string(list_reverse(regexp_extract_all({x}, '..')), '')"


def headers(spark, sf):
    text = HEADER.format(sha_a="sha2('a' || event_id, 256)", sha_b="sha2('b' || event_id, 256)")
    ev = T.events(spark, sf)
    return pinned(ev, {"header": F.expr(f"unhex({text})")}).select(
        "event_id", "header", F.col("event_id").alias("height"))


HDR = f"""hdr AS (SELECT event_id, {HEADER.format(sha_a="sha256('a' || event_id)", sha_b="sha256('b' || event_id)")} AS header FROM ev),
 hsh AS (SELECT event_id, header, {DREV.format(x="sha256(unhex(sha256(unhex(header))))")} AS block_hash,
  CASE event_id % 4 WHEN 0 THEN '7fffff' || repeat('0', 58) WHEN 1 THEN '0fffff' || repeat('0', 58)
   WHEN 2 THEN 'ff' || repeat('0', 62) ELSE NULL END AS target FROM hdr)"""


@query("f12_block_hash", f"""{W}, {HDR} SELECT event_id, block_hash, target, block_hash <= target AS pow_ok FROM hsh""")
def f12(spark, sf):
    bits = F.conv(F.hex(C.reverse_bytes(F.substring("header", 73, 4))), 16, 10).cast("bigint")
    return headers(spark, sf).select(
        "event_id", C.block_hash("header").alias("block_hash"), C.compact_target(bits).alias("target"),
        C.pow_ok("header").alias("pow_ok"))


@query("f13_disclosure_label", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'public-recompute' WHEN 'O' THEN 'partner-audit'
  ELSE 'anchor-only-evidence' END AS label FROM orders""")
def f13(spark, sf):
    cls = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").otherwise("C")
    return T.table(spark, sf, "orders").select("o_orderkey", C.disclosure_label(cls).alias("label"))


@query("f14_nonce", f"""{W} SELECT event_id, substr(sha256('salt' || dev_id), 1, 16) || lower(lpad(to_hex(fc), 16, '0') ||
  lpad(to_hex(event_id), 16, '0')) AS nonce FROM ev""")
def f14(spark, sf):
    salt = F.unhex(F.substring(F.sha2(F.concat(F.lit("salt"), "dev_id"), 256), 1, 16))
    return T.events(spark, sf).select("event_id", C.hex_lower(
        C.framed_nonce(salt, "fc", C.uint_be("event_id", 8))).alias("nonce"))


# Damaged records: head, version, id length, trailing byte, wide integer, float payloads.
BROKEN = """CASE event_id % 10 WHEN 1 THEN '86' || substr({r}, 3) WHEN 2 THEN substr({r}, 1, 2) || '02' || substr({r}, 5)
  WHEN 3 THEN {r} || '00' WHEN 4 THEN substr({r}, 1, length({r}) - 2) || '1817' WHEN 5 THEN substr({r}, 1, 4) || '47' || substr({r}, 7)
  WHEN 6 THEN {r} || 'f6' WHEN 7 THEN substr({r}, 1, 20) ELSE {r} END"""


def broken(spark, sf):
    rec = T.records(T.events(spark, sf)).withColumn("r", C.hex_lower("record"))
    return rec.select("event_id", "fc", "ingest_time", F.unhex(F.expr(BROKEN.format(r="r"))).alias("record"))


@query("p19_decode_records", f"""{W} SELECT event_id, ok, CASE WHEN ok THEN pod_id END AS device_id, CASE WHEN ok THEN fc END AS fc,
  CASE WHEN ok THEN ingest_time END AS ingest_time, CASE WHEN ok THEN CAST(1 AS BIGINT) END AS kind
  FROM (SELECT *, event_id % 10 NOT IN (1, 2, 3, 4, 5, 6, 7) AS ok FROM ev)""")
def p19(spark, sf):
    df = broken(spark, sf).withColumn("m", K.record_meta("record"))
    ok = F.col("m.error").isNull()
    return T.big(df.select("event_id", ok.alias("ok"), F.col("m.device_id").alias("device_id"), F.col("m.fc").alias("fc"),
                           F.col("m.ingest_time").alias("ingest_time"), F.col("m.kind").alias("kind")))


@query("f15_record_meta", f"{W} SELECT event_id, pod_id AS device_id, fc, ingest_time FROM ev")
def f15(spark, sf):
    df = T.records(T.events(spark, sf)).select("event_id", K.record_meta("record").alias("m"))
    return T.big(df.select("event_id", "m.device_id", "m.fc", "m.ingest_time"))


# Facts as v1 CBOR: good, long integer form, tag, float payload, unordered keys, trailing byte.
V1FACT = """CASE event_id % 8 WHEN 1 THEN 'a1' || '626663' || '1801' WHEN 2 THEN 'c0' || {f} WHEN 3 THEN 'a1' || '6176' || 'f93e00'
  WHEN 4 THEN 'a2' || '626663' || '01' || '6161' || '02' WHEN 5 THEN {f} || '00' WHEN 6 THEN 'a1' || '6176' || 'fa3fc00000' ELSE {f} END"""


@query("p20_fact_canonical", f"""{W} SELECT event_id, event_id % 8 IN (0, 7) AS bundle_ok, event_id % 8 IN (0, 3, 7) AS vector_ok FROM ev""")
def p20(spark, sf):
    df = T.events(spark, sf).withColumn("f", C.hex_lower(K.json_to_cbor(F.expr(FACT_JSON))))
    df = df.select("event_id", F.unhex(F.expr(V1FACT.format(f="f"))).alias("cbor"))
    return df.select("event_id", K.fact_error("bundle")("cbor").isNull().alias("bundle_ok"),
                     K.fact_error("vector")("cbor").isNull().alias("vector_ok"))


@query("f16_json_guards", """SELECT event_id, CASE WHEN json_type(p, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(p->>'$.k' AS BIGINT) END AS k,
  json_type(p, '$.missing') IS NULL AS absent, json_type(p, '$.t') = 'BOOLEAN' AS is_flag FROM (SELECT event_id,
  CAST(replace(props, '}', ', "t": true}') AS JSON) AS p FROM events)""")
def f16(spark, sf):
    v = F.try_parse_json(F.replace("props", F.lit("}"), F.lit(', "t": true}')))
    df = T.table(spark, sf, "events").select("event_id", v.alias("v"))
    return df.select("event_id", C.json_uint("v", "$.k", 2**62).alias("k"),
                     C.json_type("v", "$.missing").isNull().alias("absent"),
                     (C.json_type("v", "$.t") == "BOOLEAN").alias("is_flag"))


HEXES = """CASE event_id % 4 WHEN 0 THEN {u} WHEN 1 THEN substr({u}, 1, 63) WHEN 2 THEN substr({u}, 1, 40) || 'g' || substr({u}, 42) ELSE {l} END"""


@query("p13_normalize_hex", f"""{W} SELECT event_id, CASE WHEN regexp_full_match(x, '[0-9a-fA-F]{{64}}') THEN lower(x) END AS hex64,
  CASE event_id % 4 WHEN 1 THEN 'length:63' WHEN 2 THEN 'character:40' END AS error
  FROM (SELECT event_id, {HEXES.format(u="upper(sha256(pod_id))", l="sha256(pod_id)")} AS x FROM ev)""")
def p13(spark, sf):
    x = F.expr(HEXES.format(u="upper(sha2(pod_id, 256))", l="sha2(pod_id, 256)"))
    return T.events(spark, sf).select("event_id", x.alias("x")).select(
        "event_id", C.normalize_hex64("x").alias("hex64"), C.hex64_error("x").alias("error"))


PATHS = """CASE {n} % 9 WHEN 0 THEN {p} WHEN 1 THEN '/' || {p} WHEN 2 THEN 'a/../' || {p} WHEN 3 THEN './' || {p} WHEN 4 THEN 'a\\b' || {p}
  WHEN 5 THEN 'c:' || {p} WHEN 6 THEN '..' || {p} WHEN 7 THEN '' ELSE {p} || '/..' END"""


@query("p14_portable_path", f"""SELECT page_id, page_id % 9 NOT IN (1, 2, 8) AS v1_ok, page_id % 9 IN (0, 6) AS v2_ok FROM pages""")
def p14(spark, sf):
    q = PATHS.format(n="page_id", p="concat('day/', page_id, '.cbor')").replace("\\", "\\\\")
    return T.table(spark, sf, "pages").select("page_id", F.expr(q).alias("path")).select(
        "page_id", C.portable_path("path", 1).alias("v1_ok"), C.portable_path("path", 2).alias("v2_ok"))


@query("p16_closure_policy", """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'interval_ms' WHEN p_partkey % 50 = 0 THEN 'batch_record_limit'
  WHEN p_size = 2 THEN 'record_limit' WHEN p_partkey % 33 = 0 THEN 'size_limit_bytes' END AS error FROM part""")
def p16(spark, sf):
    from sealstream.operators.ledger import check_policy
    p = T.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") - 1).alias("interval_ms"), (F.col("p_partkey") % 50).alias("batch_record_limit"),
        F.when(F.col("p_size") == 2, 0).alias("record_limit"), (F.col("p_partkey") % 33).alias("size_limit_bytes"))
    return check_policy(p).select("p_partkey", "error")


@query("p17_idempotency_key", """SELECT item_id, octet_length(encode(text)) BETWEEN 1 AND 255 AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]') AS plain_ok,
  false AS control_ok FROM benchmark""")
def p17(spark, sf):
    return T.table(spark, sf, "benchmark").select(
        "item_id", C.idempotency_key_ok("text").alias("plain_ok"),
        C.idempotency_key_ok(F.concat("text", F.lit("\t"))).alias("control_ok"))
