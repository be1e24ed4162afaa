"""Frame lines and device material derived from the readings, in both engines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.functions import codecs as K
from sealstream.functions import columns as C
from sealstream.operators.admission import with_aad
from sealstream.operators.plan import pinned
from sealstream.plans import telemetry as T


class Spark:
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    b64 = staticmethod(lambda x: f"translate(base64(unhex({x})), char(13) || char(10), '')")
    hex = staticmethod(lambda n, w: f"lower(lpad(hex({n}), {w}, '0'))")


class Duck:
    sha = staticmethod(lambda x: f"sha256({x})")
    b64 = staticmethod(lambda x: f"to_base64(unhex({x}))")
    hex = staticmethod(lambda n, w: f"lower(lpad(to_hex({n}), {w}, '0'))")


def salt_hex(d):
    return f"substr({d.sha(chr(39) + 'salt' + chr(39) + ' || dev_id')}, 1, 16)"


def key_hex(d):
    return d.sha("'key' || dev_id")


def device_columns(d) -> str:
    """Base64 material of a device, damaged for some device numbers."""
    salt, key = salt_hex(d), key_hex(d)
    return f"""CASE WHEN dev_id % 29 = 1 THEN NULL WHEN dev_id % 37 = 3 THEN '@@@='
  WHEN dev_id % 41 = 4 THEN {d.b64(f'substr({salt}, 1, 14)')} ELSE {d.b64(salt)} END AS salt8,
  CASE WHEN dev_id % 31 = 2 THEN NULL WHEN dev_id % 47 = 6 THEN 'AB=='
  WHEN dev_id % 43 = 5 THEN {d.b64(f'substr({key}, 1, 62)')} ELSE {d.b64(key)} END AS ck_up"""


def frame_columns(d) -> str:
    """``raw`` frame line of a reading with one kind of damage per event number mod 31."""
    m = "event_id % 31"
    ct = d.sha("'ct' || event_id")
    tag = f"substr({d.sha(chr(39) + 'tag' + chr(39) + ' || event_id')}, 1, 32)"
    nonce = f"({salt_hex(d)} || {d.hex('fc', 16)} || {d.hex('dev_id', 4)} || {d.hex('fc', 12)})"
    other = f"({salt_hex(d)} || {d.hex('fc + 1', 16)} || {d.hex('fc', 16)})"
    return f"""CASE {m} WHEN 12 THEN '{{"hdr": ' WHEN 13 THEN '[1,2]' WHEN 23 THEN 'null' ELSE
  '{{' || (CASE {m} WHEN 0 THEN '"hdr":null,' WHEN 1 THEN '' WHEN 2 THEN '"hdr":"x",' ELSE
   '"hdr":{{"dev_id":' || (CASE {m} WHEN 3 THEN 'true' WHEN 4 THEN '70000' ELSE '' || dev_id END)
   || ',"msg_type":' || (CASE {m} WHEN 6 THEN '300' ELSE '1' END)
   || ',"fc":' || (CASE {m} WHEN 5 THEN '"12"' WHEN 14 THEN '1.5' ELSE '' || fc END)
   || (CASE {m} WHEN 7 THEN '' WHEN 18 THEN ',"flags":1' ELSE ',"flags":0' END) || '}},' END)
  || '"nonce":' || (CASE {m} WHEN 8 THEN '17' WHEN 9 THEN '"!!"'
     WHEN 19 THEN '"' || {d.b64(f'substr({nonce}, 1, 40)')} || '"'
     WHEN 20 THEN '"' || {d.b64(f"('ffff' || substr({nonce}, 5, 44))")} || '"'
     WHEN 21 THEN '"' || {d.b64(other)} || '"' ELSE '"' || {d.b64(nonce)} || '"' END)
  || (CASE {m} WHEN 10 THEN '' WHEN 16 THEN ',"ct":""'
     WHEN 17 THEN ',"ct":"' || {d.b64(f'repeat({ct}, 10)')} || '"'
     ELSE ',"ct":"' || {d.b64(ct)} || '"' END)
  || ',"tag":' || (CASE {m} WHEN 11 THEN 'null'
     WHEN 15 THEN '"' || {d.b64(f'substr({tag}, 1, 30)')} || '"' ELSE '"' || {d.b64(tag)} || '"' END)
  || '}}' END AS raw, CASE WHEN event_id % 67 = 0 THEN 'cbor-v9' WHEN event_id % 3 = 0 THEN NULL
  ELSE 'rust-postcard-v1' END AS ingest_profile"""


def frames(spark, sf):
    ev = T.events(spark, sf)
    raw, profile = (F.expr(x.rsplit(" AS ", 1)[0]) for x in _split(frame_columns(Spark)))
    return pinned(ev, {"raw": raw, "ingest_profile": profile}).select(
        "event_id", "arrival_seq", "ingest_time", "raw", "ingest_profile")


def devices(spark, sf):
    ids = T.events(spark, sf).filter("dev_id % 23 <> 0").select("dev_id").distinct()
    return ids.selectExpr("dev_id", *_split(device_columns(Spark)))


def _split(text: str) -> list[str]:
    """Split ``a AS x, b AS y`` at the top-level alias commas."""
    out, rest = [], text
    for name in ("raw", "ingest_profile", "salt8", "ck_up"):
        cut = f" AS {name}"
        if cut in rest:
            head, rest = rest.split(cut, 1)
            out.append(head.lstrip(", \n") + cut)
            rest = rest.lstrip(", \n")
    return out


FRM = f"frm AS (SELECT event_id, arrival_seq, ingest_time, {frame_columns(Duck)} FROM ev)"
DEV = f"""dev AS (SELECT dev_id, {device_columns(Duck)} FROM
  (SELECT DISTINCT dev_id FROM ev WHERE dev_id % 23 <> 0))"""

_B64 = "'([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?'"


def duck_b64(x: str) -> str:
    """Hex of strict base64 text or NULL."""
    return (f"(CASE WHEN regexp_full_match({x}, {_B64}) AND to_base64(from_base64({x})) = {x} "
            f"THEN lower(hex(from_base64({x}))) END)")


def _uint(name: str, top: int) -> str:
    return (f"CASE WHEN json_type(j, '$.hdr.{name}') IN ('UBIGINT', 'BIGINT') AND "
            f"CAST(j->>'$.hdr.{name}' AS HUGEINT) BETWEEN 0 AND {top} "
            f"THEN CAST(j->>'$.hdr.{name}' AS BIGINT) END AS {name}")


def _blob(name: str) -> str:
    text = f"CASE WHEN json_type(j, '$.{name}') = 'VARCHAR' THEN j->>'$.{name}' END"
    return f"json_type(j, '$.{name}') AS {name}_t, {text} AS {name}_s"


PARSED = f"""prs AS (SELECT *, CASE WHEN j IS NULL THEN 'invalid_json'
  WHEN json_type(j) <> 'OBJECT' OR hdr_t IS NULL THEN 'missing_frame_fields'
  WHEN hdr_t <> 'OBJECT' THEN 'invalid_hdr'
  WHEN p_dev_id IS NULL OR msg_type IS NULL OR fc IS NULL OR flags IS NULL THEN 'invalid_hdr_types'
  WHEN nonce_t IS NULL THEN 'missing_frame_fields' WHEN nonce_t <> 'VARCHAR' THEN 'invalid_frame_types'
  WHEN nonce IS NULL THEN 'invalid_base64'
  WHEN ct_t IS NULL THEN 'missing_frame_fields' WHEN ct_t <> 'VARCHAR' THEN 'invalid_frame_types'
  WHEN ct IS NULL THEN 'invalid_base64'
  WHEN tag_t IS NULL THEN 'missing_frame_fields' WHEN tag_t <> 'VARCHAR' THEN 'invalid_frame_types'
  WHEN tag IS NULL THEN 'invalid_base64' END AS reason
 FROM (SELECT *, dev_id AS p_dev_id, {duck_b64('nonce_s')} AS nonce, {duck_b64('ct_s')} AS ct,
   {duck_b64('tag_s')} AS tag FROM
  (SELECT event_id, arrival_seq, ingest_time, raw, ingest_profile, j, json_type(j, '$.hdr') AS hdr_t,
   {_uint('dev_id', 65535)}, {_uint('msg_type', 255)}, {_uint('fc', 4294967295)}, {_uint('flags', 255)},
   {_blob('nonce')}, {_blob('ct')}, {_blob('tag')}
   FROM (SELECT *, TRY_CAST(raw AS JSON) AS j FROM frm))))"""

LOOKED = f"""lkd AS (SELECT p.* EXCLUDE (reason), s8, ck, coalesce(p.reason, CASE
  WHEN d.dev_id IS NULL THEN 'unknown_device' WHEN d.salt8 IS NULL THEN 'missing_salt8'
  WHEN s8 IS NULL THEN 'invalid_base64' WHEN d.ck_up IS NULL THEN 'unknown_device'
  WHEN ck IS NULL THEN 'invalid_base64' END) AS reason
 FROM prs p LEFT JOIN (SELECT *, {duck_b64('salt8')} AS s8, {duck_b64('ck_up')} AS ck FROM dev) d
 ON p.p_dev_id = d.dev_id)"""

CHECKED = """chk AS (SELECT * EXCLUDE (reason), coalesce(reason, CASE
  WHEN length(tag) <> 32 THEN 'tag_length' WHEN length(ck) <> 64 THEN 'ck_up_length'
  WHEN length(ct) = 0 THEN 'empty_ciphertext' WHEN length(ct) > 512 THEN 'ciphertext_too_large'
  WHEN flags <> 0 THEN 'unsupported_flags' END) AS reason FROM lkd)"""

NONCED = """non AS (SELECT * EXCLUDE (reason), coalesce(reason, CASE
  WHEN length(nonce) <> 48 THEN 'nonce_length' WHEN length(s8) <> 16 THEN 'salt8_length'
  WHEN substr(nonce, 1, 16) <> s8 THEN 'nonce_salt_mismatch'
  WHEN substr(nonce, 17, 16) <> lower(lpad(to_hex(fc), 16, '0')) THEN 'nonce_fc_mismatch'
  END) AS reason FROM chk)"""

CHAIN = f"{T.EV}, {FRM}, {DEV}, {PARSED}, {LOOKED}, {CHECKED}, {NONCED}"


def fixture_readings(spark, sf):
    """Readings with decoded key material, ready to be sealed as frames."""
    ev = T.events(spark, sf)
    return ev.select(
        "event_id", "arrival_seq", "dev_id", "fc", "ingest_time", F.lit(1).alias("msg_type"),
        F.col("ingest_time").alias("pod_time"), "sample_type",
        (F.col("cents") / 4).cast("float").alias("value"),
        F.expr(f"unhex({salt_hex(Spark)})").alias("salt8"),
        F.expr(f"unhex({key_hex(Spark)})").alias("ck_up"))


def make_fixture_frames(readings: DataFrame) -> DataFrame:
    """Deterministic sealed frames for readings (dev_id, fc, msg_type, pod_time, sample_type,
    value, salt8, ck_up as bytes): a test-data job, encrypted per Arrow batch."""
    @F.pandas_udf("struct<ct:binary,tag:binary>")
    def seal(cols: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for c in cols:
            keys, nonces, aads = ([bytes(x) for x in c[i]] for i in range(3))
            plains = [K.instant_plaintext(int(d).to_bytes(8, "big"), int(f), int(t), int(s), float(v))
                      for d, f, t, s, v in zip(*c[3:])]
            yield pd.DataFrame(K.seal(keys, nonces, aads, plains), columns=["ct", "tag"])

    tail = F.unhex(F.concat(F.lpad(F.hex("dev_id"), 4, "0"), F.lpad(F.hex("fc"), 12, "0")))
    df = (readings.withColumn("flags", F.lit(0)).withColumn("nonce", C.framed_nonce("salt8", "fc", tail)))
    df = with_aad(df)
    sealed = df.withColumn("_s", seal("ck_up", "nonce", "aad", "dev_id", "fc", "pod_time",
                                      "sample_type", "value"))
    return sealed.select("*", "_s.ct", "_s.tag").drop("_s", "aad")
