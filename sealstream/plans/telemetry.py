"""The driver tables read as device telemetry, in Spark and as DuckDB CTEs.

Each event is one reading of device ``user_id``. Its frame counter is the hour of
the reading, so repeats and gaps occur by themselves; every 17th event is sent
back three counters and every 53rd jumps ahead by 500 (late and hostile frames).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.operators.plan import pinned

FIRST_HOUR = 473352  # 2024-01-01T00:00Z in hours since 1970


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def from_events(table_or_stream: DataFrame) -> DataFrame:
    # From the parts of the zone-free timestamp: no session zone takes part.
    raw = table_or_stream.selectExpr(
        "event_id", "user_id", "event_type", "value",
        "datediff(cast(ts as date), date'1970-01-01') * 86400000000L + hour(ts) * 3600000000L "
        "+ minute(ts) * 60000000L + cast(extract(SECOND FROM ts) * 1000000 as bigint) AS us")
    mid = raw.selectExpr(
        "*", f"us div 3600000000 - {FIRST_HOUR} + 1 AS hour",
        "coalesce(concat('site-', pmod(user_id, 4)), '') AS site_id")
    return mid.selectExpr(
        "event_id", "event_id AS arrival_seq", "cast(pmod(user_id, 65536) as int) AS dev_id",
        "lower(lpad(hex(user_id), 16, '0')) AS pod_id", "hour",
        "CASE WHEN event_id % 17 = 0 THEN greatest(hour - 3, 1) "
        "WHEN event_id % 53 = 0 THEN hour + 500 ELSE hour END AS fc",
        "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 "
        "WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 250 END AS sample_type",
        "cast(round(value * 100) as bigint) AS cents", "value", "us div 1000000 AS ingest_time",
        "us div 1000 AS t_ms", "site_id", "coalesce(md5(cast(site_id as binary)), '') AS ledger_id",
        "coalesce(substring(cast(timestampadd(SECOND, us div 1000000, "
        "timestamp_ntz'1970-01-01 00:00:00') as string), 1, 10), '') AS day")


EV = f"""ev AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN greatest(hour - 3, 1)
  WHEN event_id % 53 = 0 THEN hour + 500 ELSE hour END AS fc FROM (
  SELECT event_id, event_id AS arrival_seq, user_id % 65536 AS dev_id,
   lpad(lower(to_hex(user_id)), 16, '0') AS pod_id,
   epoch_us(ts) // 3600000000 - {FIRST_HOUR} + 1 AS hour,
   CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
     WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 250 END AS BIGINT) AS sample_type,
   CAST(round(value * 100) AS BIGINT) AS cents, value,
   epoch_us(ts) // 1000000 AS ingest_time, epoch_us(ts) // 1000 AS t_ms,
   'site-' || (user_id % 4) AS site_id, md5('site-' || (user_id % 4)) AS ledger_id,
   strftime(ts, '%Y-%m-%d') AS day FROM events))"""


def duck_head(major: int, n: str) -> str:
    """DuckDB text: hex of a CBOR head."""
    b = major << 5
    return (f"(CASE WHEN {n} < 24 THEN lpad(to_hex({b} + {n}), 2, '0') "
            f"WHEN {n} < 256 THEN '{b + 24:02X}' || lpad(to_hex({n}), 2, '0') "
            f"WHEN {n} < 65536 THEN '{b + 25:02X}' || lpad(to_hex({n}), 4, '0') "
            f"WHEN {n} < 4294967296 THEN '{b + 26:02X}' || lpad(to_hex({n}), 8, '0') "
            f"ELSE '{b + 27:02X}' || lpad(to_hex({n}), 16, '0') END)")


def duck_text(s: str) -> str:
    """DuckDB text: hex of a CBOR text item."""
    return f"({duck_head(3, f'octet_length(encode({s}))')} || hex(encode({s})))"


def records(ev: DataFrame) -> DataFrame:
    """Canonical v2 record bytes of each reading. A number's head names it many times, so its value is computed before."""
    ev = pinned(ev, {c: F.col(c) for c in ("pod_id", "fc", "ingest_time", "cents")})
    return ev.withColumn("record", C.record_v2(
        "unhex(pod_id)", "fc", "ingest_time", None, "1", C.cbor_uint("cents")))


REC = f"""rec AS (SELECT *, lower('870148' || pod_id || {duck_head(0, 'fc')} ||
  {duck_head(0, 'ingest_time')} || 'f601' || {duck_head(0, 'cents')}) AS record_hex FROM ev)"""


def duck_roots(name: str, source: str, group: str, version: int, leaf: str = "leaf",
               extra: str = "") -> str:
    """CTEs ``<name>`` with columns group, leaf_count, root: level by level reduction."""
    pre = "unhex('01') || " if version == 2 else ""
    lone = (f"a[2 * i + 1]" if version == 2
            else "sha256(unhex(a[2 * i + 1]) || unhex(a[2 * i + 1]))")
    return f"""{name}_lv AS (
  SELECT {group}, count(*) AS leaf_count, list({leaf} ORDER BY {leaf}) AS a FROM {source} GROUP BY ALL
  UNION ALL
  SELECT {group}, leaf_count, list_transform(range((len(a) + 1) // 2), lambda i:
    CASE WHEN 2 * i + 2 <= len(a) THEN sha256({pre}unhex(a[2 * i + 1]) || unhex(a[2 * i + 2])) ELSE {lone} END)
  FROM {name}_lv WHERE len(a) > 1),
{name} AS (SELECT {group}, leaf_count, a[1] AS root FROM {name}_lv WHERE len(a) = 1)"""


def big(df: DataFrame) -> DataFrame:
    """Widen every integer column to BIGINT so results compare across engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(c.cast("bigint").alias(f.name)
                    if f.dataType.typeName() in ("byte", "short", "integer", "decimal") else c)
    return df.select(*cols)
