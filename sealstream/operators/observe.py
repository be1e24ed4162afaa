"""Projection of environmental facts to observation entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.operators.admission import sample_types
from sealstream.operators.plan import pinned, salted_join

TIMES = ["phenomenon_time_start", "phenomenon_time_end", "result_time"]


def join_observed_property(facts: DataFrame) -> DataFrame:
    """Observed property key per sample type; the dimension has 51 rows."""
    return facts.join(F.broadcast(sample_types(facts.sparkSession)), "sample_type").withColumnRenamed(
        "property_key", "observed_property_key")


def resolve_sensor_identity(facts: DataFrame, provisioning: DataFrame) -> DataFrame:
    """Sensor key: override, deployment, provisioning key, else derived from the identity.

    ``provisioning``: pod_id, site_id, sensor_key_override, deployment_sensor_key,
    provisioning_sensor_key, provisioning_identity. Unresolved rows get ``reason``.
    """
    context = provisioning.select(
        "pod_id", F.col("site_id").alias("_site"), "sensor_key_override", "deployment_sensor_key",
        "provisioning_sensor_key", "provisioning_identity")
    # A pod may hold a large share of all facts.
    joined = salted_join(facts, context, ["pod_id"], ["ingest_time"])
    sensor = F.coalesce(
        "sensor_key_override", "deployment_sensor_key", "provisioning_sensor_key",
        C.derived_sensor_key("provisioning_identity", "observed_property_key", "sensor_channel"))
    return joined.withColumns({
        "sensor_key": sensor,
        "reason": F.when(sensor.isNull(), "missing_sensor_identity"),
    }).drop(*context.columns[2:]).withColumnRenamed("_site", "context_site_id")


def to_observation_input(facts: DataFrame, provisioning: DataFrame) -> DataFrame:
    """Facts (kind 1 with environmental payload) to projection inputs."""
    env = resolve_sensor_identity(join_observed_property(facts.filter("kind = 1")), provisioning)
    summary = F.to_json(F.struct(*[F.col(c) for c in (
        "count", "max", "mean", "min", "quality", "sensor_channel")]), {"ignoreNullFields": "false"})
    return env.select(
        *[c for c in ("event_id",) if c in env.columns], "pod_id", F.col("context_site_id").alias("site_id"),
        "sensor_key", "observed_property_key",
        F.when(F.col("value").isNotNull(), "raw").otherwise("summary").alias("stream_key"),
        C.format_rfc3339("start").alias(TIMES[0]), C.format_rfc3339("end").alias(TIMES[1]),
        C.format_rfc3339("ingest_time").alias(TIMES[2]),
        F.col("value").cast("double").alias("result_scalar"),
        F.when(F.col("value").isNull(), summary).alias("result_structured"), "reason")


def check_observation_input(inputs: DataFrame) -> DataFrame:
    """``error``: first blank field, first time that is not canonical UTC, or a reversed range."""
    required = ["pod_id", "sensor_key", "observed_property_key", "stream_key", *TIMES]
    checks = [(f"missing:{c}", F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")) == "", F.lit(True)))
              for c in required]
    df = pinned(inputs, {f"_s_{c}": C.parse_rfc3339(c) for c in TIMES})
    checks += [(f"time:{c}", F.coalesce(C.format_rfc3339(f"_s_{c}") != F.col(c), F.lit(True)))
               for c in TIMES]
    checks.append(("time_range", F.col(f"_s_{TIMES[1]}") < F.col(f"_s_{TIMES[0]}")))
    return df.withColumn("error", C.first_failure(checks)).drop(*[f"_s_{c}" for c in TIMES])


def project_observations(inputs: DataFrame, prefix: str = "vt") -> DataFrame:
    """Entity ids per observation input."""
    def eid(kind, *cols):
        return C.entity_id(kind, *cols, prefix=prefix)
    df = inputs.withColumns({
        "thing_id": eid("thing", "pod_id"),
        "sensor_id": eid("sensor", "pod_id", "sensor_key"),
        "observed_property_id": eid("observed-property", "observed_property_key"),
        "datastream_id": eid("datastream", "pod_id", "sensor_key", "observed_property_key", "stream_key")})
    return df.withColumn("observation_id", eid("observation", "datastream_id", *TIMES))


def dedup_entities(projected: DataFrame) -> dict[str, DataFrame]:
    """Distinct things, sensors, observed properties and datastreams; all observations.

    Grouping by every column of an entity merges its copies before the shuffle.
    """
    def entity(name, *cols):
        return projected.select(F.col(name).alias("id"), *cols).distinct()
    return {
        "things": entity("thing_id", "pod_id", "site_id"),
        "sensors": entity("sensor_id"),
        "observed_properties": entity("observed_property_id", "observed_property_key"),
        "datastreams": entity("datastream_id", "thing_id", "sensor_id", "observed_property_id", "stream_key"),
        "observations": projected.select(F.col("observation_id").alias("id"), "datastream_id", *TIMES,
                                         "result_scalar", "result_structured"),
    }


def assemble_projection(projected: DataFrame) -> DataFrame:
    """All entities as rows (section, id, body JSON), from one pass over the projected rows.

    Each row yields its entities; copies of things, sensors, properties and datastreams merge before the shuffle, observations
    are told apart by a row mark and all stay.
    """
    def entity(section, name, *cols, own=None):
        body = F.to_json(F.struct(F.col(name).alias("id"), *cols), {"ignoreNullFields": "false"})
        return F.struct(F.lit(section).alias("section"), F.col(name).alias("id"), body.alias("body"),
                        (F.lit(-1).cast("bigint") if own is None else own).alias("_row"))
    rows = projected.withColumn("_mark", F.monotonically_increasing_id())
    each = rows.select(F.inline(F.array(
        entity("things", "thing_id", "pod_id", "site_id"), entity("sensors", "sensor_id"),
        entity("observed_properties", "observed_property_id", "observed_property_key"),
        entity("datastreams", "datastream_id", "thing_id", "sensor_id", "observed_property_id", "stream_key"),
        entity("observations", "observation_id", "datastream_id", *TIMES, "result_scalar", "result_structured", own=F.col("_mark")))))
    return each.distinct().drop("_row")
