"""Registered queries: analytical aggregations and observation entities."""

from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.operators import admission as D
from sealstream.operators import analytics as A
from sealstream.operators import observe as O
from sealstream.operators import replay as R
from sealstream.operators.plan import previous_row
from sealstream.plans import admission as Q
from sealstream.plans import telemetry as T
from sealstream.plans.registry import query

W = f"WITH {T.EV}"
CH = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 END"


def facts(spark, sf):
    return T.events(spark, sf).select(
        "event_id", "pod_id", "sample_type", F.expr(CH).alias("sensor_channel"), "cents", "day",
        F.col("ingest_time").alias("start"), "site_id", "fc", "ingest_time")


def series(df):
    return T.big(df.withColumn("sensor_channel", F.coalesce("sensor_channel", F.lit(-1))))


FCT = f"fct AS (SELECT event_id, pod_id, sample_type, coalesce({CH}, -1) AS sensor_channel, cents, day, ingest_time FROM ev)"
SUM1 = f"""{W}, {FCT}, hr AS (SELECT pod_id, sample_type, sensor_channel, ingest_time - ingest_time % @ AS window_start, min(cents) AS "min",
  max(cents) AS "max", avg(cents) AS mean, count(*) AS count FROM fct GROUP BY ALL)"""


@query("a01_window_summary", f"{SUM1.replace(chr(64), str(86400))} SELECT *, window_start + 86399 AS window_end FROM hr")
def a01(spark, sf):
    return series(A.window_summary(facts(spark, sf), value="cents"))


@query("a02_merge_summaries", f"""{SUM1.replace(chr(64), str(3600))} SELECT pod_id, sample_type, sensor_channel, window_start - window_start % 86400 AS window_start, min("min") AS "min",
  max("max") AS "max", round(sum(mean * count) / sum(count), 6) AS mean, CAST(sum(count) AS BIGINT) AS count FROM hr GROUP BY ALL""")
def a02(spark, sf):
    hourly = A.window_summary(facts(spark, sf), 3600, "cents").drop("window_end")
    return series(A.merge_summaries(hourly)).withColumn("mean", F.round("mean", 6))


# Every seventh reading is a summary, without a value of its own.
@query("a03_daily_metrics", f"""{W}, {FCT.replace("cents,", "CASE WHEN event_id % 7 > 0 THEN cents END AS cents,")}, b AS (SELECT pod_id, sample_type, sensor_channel, day, avg(cents) AS mean, stddev_samp(cents) AS sd, count(cents) AS count,
  quantile_cont(cents, 0.25) AS q1, median(cents) AS median, quantile_cont(cents, 0.75) AS q3 FROM fct GROUP BY ALL),
 o AS (SELECT b.pod_id, b.sample_type, b.sensor_channel, b.day, count(*) FILTER (cents < q1 - 1.5 * (q3 - q1) OR cents > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM b JOIN fct f ON f.pod_id = b.pod_id AND f.sample_type = b.sample_type AND f.sensor_channel = b.sensor_channel AND f.day = b.day GROUP BY ALL)
 SELECT b.pod_id, b.sample_type, b.sensor_channel, b.day, round(mean, 4) AS mean, round(sd, 4) AS stddev, count, q1, median, q3, outliers,
  round(mean - lag(mean) OVER (PARTITION BY b.pod_id, b.sample_type, b.sensor_channel ORDER BY b.day), 4) AS delta, round(sd / abs(mean), 4) AS stability, count >= 2.0 AS sufficient
 FROM b JOIN o USING (pod_id, sample_type, sensor_channel, day)""")
def a03(spark, sf):
    f = facts(spark, sf).withColumn("sensor_channel", F.coalesce("sensor_channel", F.lit(-1)))
    f = f.withColumn("cents", F.when(F.col("event_id") % 7 > 0, F.col("cents")))
    m = A.derived_daily_metrics(f, expected=4, value="cents")
    return T.big(m.withColumns({c: F.round(c, 4) for c in ("mean", "delta", "stability")})
                 .withColumn("stddev", F.round("stddev", 4)))


@query("a04_frame_counts", f"{W} SELECT site_id, day, count(*) AS frame_count FROM ev GROUP BY ALL")
def a04(spark, sf):
    return A.frame_counts(facts(spark, sf))


CHN = """chn AS (SELECT o_orderkey AS bundle, c.channel, (o_orderkey + c.k) % 4 > 0 AS enabled,
  CASE (o_orderkey // 3 + c.k) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'missing' WHEN 2 THEN 'pending' ELSE 'verified' END AS status
  FROM orders, (VALUES ('ots', 0), ('tsa', 1), ('peers', 2)) c(channel, k))"""


def channels(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("bundle"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(k).alias("k")) for k, c in enumerate(A.CHANNELS)])).alias("c"))
    s = F.expr("(bundle div 3 + c.k) % 5")
    return o.select("bundle", "c.channel", ((F.col("bundle") + F.col("c.k")) % 4 > 0).alias("enabled"),
                    F.when(s == 0, "failed").when(s == 1, "missing").when(s == 2, "pending")
                    .otherwise("verified").alias("status"))


@query("a09_overall_strict", f"WITH {CHN} SELECT bundle, CASE WHEN bool_or(enabled AND status <> 'verified') THEN 'failed' ELSE 'success' END AS overall FROM chn GROUP BY 1")
def a09(spark, sf):
    return A.reduce_channels(channels(spark, sf), ["bundle"], "strict")


@query("a09_overall_warn", f"""WITH {CHN} SELECT bundle, CASE WHEN bool_or(enabled AND channel = 'ots' AND status IN ('failed', 'missing'))
  THEN 'failed' ELSE 'success' END AS overall FROM chn GROUP BY 1""")
def a09w(spark, sf):
    return A.reduce_channels(channels(spark, sf), ["bundle"], "warn")


@query("a11_anchoring_matrix", f"""WITH {CHN} SELECT 'site-' || (bundle % 4) AS site_id, '' || bundle AS day, max(status) FILTER (channel = 'ots') AS ots,
  max(status) FILTER (channel = 'tsa') AS tsa, max(status) FILTER (channel = 'peers') AS peers, bool_or(channel = 'ots' AND status = 'verified') AS ots_verified,
  bool_or(channel = 'tsa' AND status = 'verified') AS tsa_verified FROM chn GROUP BY bundle""")
def a11(spark, sf):
    return A.anchoring_matrix(channels(spark, sf).select(
        F.concat(F.lit("site-"), F.col("bundle") % 4).alias("site_id"), F.col("bundle").cast("string").alias("day"),
        "channel", "status"))


@query("a12_peer_quorum", f"""{W}, p AS (SELECT site_id, day, sha256(day || (event_id % 2)) AS day_root, 'peer-' || dev_id % 9 AS peer_id FROM ev)
  SELECT site_id, day, day_root, count(DISTINCT peer_id) AS peers, count(DISTINCT peer_id) >= 8 AS quorum FROM p GROUP BY ALL""")
def a12(spark, sf):
    p = T.events(spark, sf).select(
        "site_id", "day", F.sha2(F.concat("day", F.col("event_id") % 2), 256).alias("day_root"),
        F.concat(F.lit("peer-"), F.col("dev_id") % 9).alias("peer_id"))
    return A.peer_quorum(p, 8)


@query("a13_anchor_index", """SELECT count(*) AS anchors, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS changed,
  CAST(sum(o_orderkey % 4) AS BIGINT) AS warnings FROM orders""")
def a13(spark, sf):
    o = T.table(spark, sf, "orders").select(
        (F.col("o_orderstatus") == "F").alias("changed"),
        F.array_repeat(F.lit("header-quorum-verification-unavailable"), (F.col("o_orderkey") % 4).cast("int")).alias("warnings"))
    return A.anchor_index(o)


# Counters that were admitted, once per device and counter.
ACC = f"acc AS (SELECT dev_id, pod_id, fc, ingest_time FROM (SELECT e.dev_id, e.pod_id, e.fc, e.ingest_time, r.reason FROM ev e JOIN rpl r USING (arrival_seq)) WHERE reason IS NULL)"


def decided(spark, sf):
    ev = T.events(spark, sf)
    return ev.select("arrival_seq", "dev_id", "pod_id", "fc", "ingest_time").join(
        R.admit_replay(ev).select("arrival_seq", "reason"), "arrival_seq")


@query("a10_gaps", f"""{Q.RW}, {ACC}, g AS (SELECT pod_id, fc, lag(fc) OVER w AS p, ingest_time - lag(ingest_time) OVER w AS silent_s FROM acc
  WINDOW w AS (PARTITION BY pod_id ORDER BY fc)) SELECT pod_id, p + 1 AS first_missing, fc - 1 AS last_missing, fc - p - 1 AS missed_frames, silent_s,
  CASE WHEN fc - p > 1 THEN 'missed_frames' ELSE 'silence' END AS kind FROM g WHERE fc - p > 1 OR silent_s > 5400""")
def a10(spark, sf):
    return A.detect_gaps(decided(spark, sf).filter("reason is null"), 5400)


@query("j10_absences", f"""{Q.RW}, {ACC}, g AS (SELECT dev_id, fc, lag(fc) OVER (PARTITION BY dev_id ORDER BY fc) AS p FROM acc),
  h AS (SELECT dev_id, unnest(range(p + 1, fc)) AS fc FROM g WHERE fc - p > 1), rf AS (SELECT dev_id, fc, min(reason) AS reason FROM rpl WHERE reason IS NOT NULL GROUP BY ALL)
  SELECT h.dev_id, h.fc, reason, CASE WHEN reason IS NULL THEN 'not_observed' ELSE 'observed_rejected' END AS status FROM h LEFT JOIN rf USING (dev_id, fc)""")
def j10(spark, sf):
    d = decided(spark, sf)
    return T.big(A.classify_absences(d.filter("reason is null"), d.filter("reason is not null")))


@query("w05_previous_row", f"{W} SELECT event_id, lag(cents) OVER (PARTITION BY site_id ORDER BY event_id) AS prev_cents FROM ev")
def w05(spark, sf):
    return previous_row(T.events(spark, sf).select("event_id", "site_id", "cents"), ["site_id"],
                        "event_id", ["cents"]).select("event_id", "prev_cents")


# Environmental facts: every fourth is a summary; customers hold the pods' provisioning.
def env_facts(spark, sf):
    e = F.col("event_id")
    x = (F.col("cents") / 4).cast("float")
    summary = e % 4 == 0
    return T.events(spark, sf).select(
        "event_id", "pod_id", F.when(e % 10 == 9, 250).otherwise(1).alias("kind"), "sample_type", "ingest_time",
        (F.col("ingest_time") - F.when(summary, 600).otherwise(0)).alias("start"), F.col("ingest_time").alias("end"),
        F.when(~summary, x).alias("value"), F.when(summary, x).alias("min"), F.when(summary, x + 1).alias("max"),
        F.when(summary, x + F.lit(0.5)).cast("float").alias("mean"), F.when(summary, 4).otherwise(1).alias("count"),
        F.lit(None).cast("float").alias("quality"), F.expr(CH).cast("int").alias("sensor_channel"))


def provisioning(spark, sf):
    c = T.table(spark, sf, "customer")
    n = F.col("c_nationkey")
    return c.select(
        C.pod_id_hex("c_custkey").alias("pod_id"), F.concat(F.lit("site-"), F.col("c_custkey") % 4).alias("site_id"),
        F.when(n == 3, "override-3").alias("sensor_key_override"),
        F.when(n % 5 == 0, F.concat(F.lit("dep-"), n)).alias("deployment_sensor_key"),
        F.when(n % 5 == 1, F.concat(F.lit("key-"), n)).alias("provisioning_sensor_key"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("provisioning_identity"))


PROP = """CASE sample_type WHEN 1 THEN 'temperature_air' WHEN 2 THEN 'relative_humidity' WHEN 3 THEN 'temperature_interface'
  WHEN 4 THEN 'coverage_capacitance' WHEN 5 THEN 'bioimpedance_magnitude' ELSE 'custom' END"""
ENTS = f"""pro AS (SELECT lpad(lower(to_hex(c_custkey)), 16, '0') AS pod_id, 'site-' || c_custkey % 4 AS site_id, c_nationkey AS n,
  CASE WHEN c_acctbal >= 0 THEN c_name END AS ident FROM customer),
 inp AS (SELECT event_id, pod_id, p.site_id, CASE WHEN n = 3 THEN 'override-3' WHEN n % 5 = 0 THEN 'dep-' || n WHEN n % 5 = 1 THEN 'key-' || n
   ELSE 'prov-' || substr(sha256(ident), 1, 16) || '-' || coalesce('ch' || ({CH}), replace(prop, '_', '-')) END AS sensor_key, prop AS observed_property_key,
  CASE WHEN event_id % 4 = 0 THEN 'summary' ELSE 'raw' END AS stream_key,
  strftime(to_timestamp(ingest_time - CASE WHEN event_id % 4 = 0 THEN 600 ELSE 0 END), '%Y-%m-%dT%H:%M:%SZ') AS phenomenon_time_start,
  strftime(to_timestamp(ingest_time), '%Y-%m-%dT%H:%M:%SZ') AS phenomenon_time_end, strftime(to_timestamp(ingest_time), '%Y-%m-%dT%H:%M:%SZ') AS result_time,
  CASE WHEN event_id % 4 > 0 THEN cents / 4.0 END AS result_scalar,
  CASE WHEN event_id % 4 = 0 THEN '{{"count":4,"max":' || (cents / 4.0 + 1) || ',"mean":' || (cents / 4.0 + 0.5) || ',"min":' || (cents / 4.0) || ',"quality":null,"sensor_channel":'
   || coalesce('' || ({CH}), 'null') || '}}' END AS result_structured
  FROM (SELECT *, {PROP} AS prop FROM ev WHERE event_id % 10 <> 9) LEFT JOIN (SELECT * FROM pro) p USING (pod_id)),
 prj AS (SELECT *, 'vt:thing:' || sha256('thing' || chr(31) || pod_id) AS thing_id, 'vt:sensor:' || sha256('sensor' || chr(31) || pod_id || chr(31) || sensor_key) AS sensor_id,
  'vt:observed-property:' || sha256('observed-property' || chr(31) || observed_property_key) AS observed_property_id,
  'vt:datastream:' || sha256('datastream' || chr(31) || pod_id || chr(31) || sensor_key || chr(31) || observed_property_key || chr(31) || stream_key) AS datastream_id
  FROM inp WHERE sensor_key IS NOT NULL)"""


def inputs(spark, sf):
    return O.to_observation_input(env_facts(spark, sf), provisioning(spark, sf))


@query("j02_sensor_identity", f"{W}, {ENTS} SELECT event_id, sensor_key, CASE WHEN sensor_key IS NULL THEN 'missing_sensor_identity' END AS reason FROM inp")
def j02(spark, sf):
    return inputs(spark, sf).select("event_id", "sensor_key", "reason")


@query("j03_observed_property", f"{W} SELECT event_id, {PROP} AS observed_property_key FROM ev")
def j03(spark, sf):
    return O.join_observed_property(T.events(spark, sf)).select("event_id", "observed_property_key")


@query("o01_observation_input", f"{W}, {ENTS} SELECT event_id, site_id, stream_key, phenomenon_time_start, result_time, result_scalar, result_structured FROM inp")
def o01(spark, sf):
    return inputs(spark, sf).select("event_id", "site_id", "stream_key", "phenomenon_time_start", "result_time",
                                    "result_scalar", "result_structured")


def projected(spark, sf):
    return O.project_observations(inputs(spark, sf).filter("reason is null"))


@query("o02_entities", f"""{W}, {ENTS} SELECT event_id, thing_id, sensor_id, observed_property_id, datastream_id, 'vt:observation:' ||
  sha256('observation' || chr(31) || datastream_id || chr(31) || phenomenon_time_start || chr(31) || phenomenon_time_end || chr(31) || result_time) AS observation_id FROM prj""")
def o02(spark, sf):
    return projected(spark, sf).select("event_id", "thing_id", "sensor_id", "observed_property_id", "datastream_id", "observation_id")


@query("a14_datastreams", f"""{W}, {ENTS} SELECT DISTINCT datastream_id AS id, thing_id, sensor_id, observed_property_id, stream_key FROM prj""")
def a14(spark, sf):
    return O.dedup_entities(projected(spark, sf))["datastreams"]


@query("o03_projection", f"""{W}, {ENTS} SELECT 'things' AS section, count(DISTINCT thing_id) AS n FROM prj UNION ALL SELECT 'sensors', count(DISTINCT sensor_id) FROM prj
  UNION ALL SELECT 'observed_properties', count(DISTINCT observed_property_id) FROM prj UNION ALL SELECT 'datastreams', count(DISTINCT datastream_id) FROM prj
  UNION ALL SELECT 'observations', count(*) FROM prj""")
def o03(spark, sf):
    return O.assemble_projection(projected(spark, sf)).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


TIMEBAD = """CASE event_id % 6 WHEN 1 THEN '  ' WHEN 2 THEN substr({t}, 1, 19) || '+00:00' WHEN 3 THEN '2023-01-01T00:00:00Z' ELSE {t} END"""


@query("p18_observation_input", f"""{W}, {ENTS} SELECT event_id, CASE WHEN sensor_key IS NULL THEN 'missing:sensor_key' WHEN event_id % 6 = 1 THEN 'missing:phenomenon_time_end'
  WHEN event_id % 6 = 2 THEN 'time:phenomenon_time_end' WHEN event_id % 6 = 3 THEN 'time_range' END AS error FROM inp""")
def p18(spark, sf):
    df = inputs(spark, sf).withColumn("phenomenon_time_end", F.expr(TIMEBAD.format(t="phenomenon_time_end")))
    return O.check_observation_input(df).select("event_id", "error")
