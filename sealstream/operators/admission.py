"""Frame admission: parse, device lookup, cheap checks, decryption, binding, shaping.

Every step keeps one row per frame and a nullable ``reason``; the first failing check
sets it. Only frames that pass all SQL checks reach the Python decryption.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealstream.functions import codecs as K
from sealstream.functions import columns as C
from sealstream.functions import values as V
from sealstream.operators.plan import pinned, staged


def reject(df: DataFrame, case: Column) -> DataFrame:
    """Set ``reason`` from ``case`` where no earlier check failed."""
    return df.withColumn("reason", F.coalesce("reason", case))


def classify_frames(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse frame lines; ``reason`` names the first failing field check."""
    limits = [("dev_id", 65535), ("msg_type", 255), ("fc", 2**32 - 1), ("flags", 255)]
    blobs = ["nonce", "ct", "tag"]
    # One step per attribute, so every item is taken out of the document once.
    df = lines.withColumn("_v", F.try_parse_json(raw))
    df = df.withColumns({"_hdr": C.json_item("_v", "$.hdr"), **{f"_{n}": C.json_item("_v", f"$.{n}") for n in blobs}})
    df = df.withColumns({"_hdr_t": F.schema_of_variant("_hdr"), **{f"_{n}_t": F.schema_of_variant(f"_{n}") for n in blobs}})
    df = df.withColumns({
        **{n: C.json_uint("_hdr", f"$.{n}", m) for n, m in limits},
        **{f"_{n}_s": F.when(F.col(f"_{n}_t") == "STRING", F.try_variant_get(f"_{n}", "$", "string")) for n in blobs}})
    df = df.withColumns({f"_{n}_b": F.try_to_binary(f"_{n}_s", F.lit("base64")) for n in blobs})
    df = df.withColumns({n: F.when(F.translate(F.base64(f"_{n}_b"), "\r\n", "") == F.col(f"_{n}_s"), F.col(f"_{n}_b"))
                         for n in blobs})
    checks = [("invalid_json", F.col("_v").isNull()), ("missing_frame_fields", F.col("_hdr").isNull()),
              ("invalid_hdr", ~F.col("_hdr_t").startswith("OBJECT"))]
    checks += [("invalid_hdr_types", F.col(n).isNull()) for n, _ in limits]
    for n in blobs:
        checks += [("missing_frame_fields", F.col(f"_{n}_t").isNull()),
                   ("invalid_frame_types", F.col(f"_{n}_t") != "STRING"),
                   ("invalid_base64", F.col(n).isNull())]
    fields = [*(n for n, _ in limits), *blobs]
    return pinned(df.select(*lines.columns, *fields, C.first_failure(checks).alias("reason")),
                  {n: F.col(n) for n in [*fields, "reason"]})


def check_profile(frames: DataFrame, col: str = "ingest_profile") -> DataFrame:
    """Unsupported ingest profiles are refused before any field is looked at."""
    bad = F.coalesce(F.col(col) != V.INGEST_PROFILE, F.lit(False))
    return frames.withColumn(
        "reason", F.when(bad, F.lit("invalid_ingest_profile")).otherwise(F.col("reason")))


def join_devices(frames: DataFrame, devices: DataFrame) -> DataFrame:
    """Left join of device material (base64 ``salt8``, ``ck_up``).

    The key is 16 bits wide, so after one row per key the right side has at most 65,536
    rows: a proven bound for the broadcast. Of a device's rows the first by (salt8, ck_up) counts, complete ones before others.
    """
    order = F.struct(F.col("salt8").isNull(), F.col("ck_up").isNull(), "salt8", "ck_up")
    bounded = (devices.filter(F.col("dev_id").between(0, 65535)).groupBy(F.col("dev_id").cast("bigint").alias("dev_id"))
               .agg(F.min_by(F.struct("salt8", "ck_up"), order).alias("_m"))
               .select("dev_id", F.col("_m.salt8").alias("_salt"), F.col("_m.ck_up").alias("_key"),
                       F.lit(True).alias("_known")))
    df = frames.withColumn("dev_id", F.col("dev_id").cast("bigint")).join(
        F.broadcast(bounded), "dev_id", "left")
    df = df.withColumns({"salt8": C.b64_or_null("_salt"), "ck_up": C.b64_or_null("_key")})
    df = reject(df, C.first_failure([
        ("unknown_device", F.col("_known").isNull()),
        ("missing_salt8", F.col("_salt").isNull()),
        ("invalid_base64", F.col("salt8").isNull()),
        ("unknown_device", F.col("_key").isNull()),
        ("invalid_base64", F.col("ck_up").isNull())]))
    return df.drop("_known", "_salt", "_key")


def check_lengths(frames: DataFrame) -> DataFrame:
    return reject(frames, C.first_failure([
        ("tag_length", F.octet_length("tag") != 16),
        ("ck_up_length", F.octet_length("ck_up") != 32),
        ("empty_ciphertext", F.octet_length("ct") == 0),
        ("ciphertext_too_large", F.octet_length("ct") > V.MAX_CIPHERTEXT),
        ("unsupported_flags", F.col("flags") != 0)]))


def check_nonce(frames: DataFrame) -> DataFrame:
    return reject(frames, C.first_failure([
        ("nonce_length", F.octet_length("nonce") != 24),
        ("salt8_length", F.octet_length("salt8") != 8),
        ("nonce_salt_mismatch", F.substring("nonce", 1, 8) != F.col("salt8")),
        ("nonce_fc_mismatch", F.substring("nonce", 9, 8) != C.uint_be("fc", 8))]))


def with_aad(frames: DataFrame) -> DataFrame:
    return frames.withColumn("aad", C.frame_aad("dev_id", "msg_type", "flags"))


_L, _I, _F = T.LongType(), T.IntegerType(), T.FloatType()
FACT = T.StructType([T.StructField(n, t) for n, t in zip(K.FACT_FIELDS, [
    T.StringType(), T.DecimalType(20, 0), _L, _L, _I, T.BinaryType(), _I, _L, _L,
    _F, _F, _F, _F, _L, _F, _I])])
SAMPLE_CODES = frozenset(code for code, _, _ in V.SAMPLE_TYPES)


@F.pandas_udf(FACT)
def open_frames(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Authenticate, decrypt and decode; ``pod_id`` is NULL where any step failed.

    Frames with a NULL key were rejected before and are passed over.
    """
    from decimal import Decimal
    nothing = (None,) * len(K.FACT_FIELDS)
    for cols in it:
        rows = [nothing] * len(cols[0])
        todo = [i for i, key in enumerate(cols[0]) if key is not None]
        for at in range(0, len(todo), K.BATCH):
            part = todo[at:at + K.BATCH]
            args = ([bytes(c.iat[i]) for i in part] for c in cols)
            for i, plain in zip(part, K.unseal(*args)):
                try:
                    fact = K.read_fact(plain or b"", SAMPLE_CODES)
                    rows[i] = (fact[0], Decimal(fact[1]), *fact[2:])
                except ValueError:
                    pass
        yield pd.DataFrame(rows, columns=K.FACT_FIELDS, dtype=object)


def decrypt_frames(frames: DataFrame) -> DataFrame:
    """Adds ``fact``; failures are ``decrypt_failed``. Rejected frames send no bytes to Python. Key material is left out of
    the result, so no later table holds it."""
    ready = with_aad(frames)
    args = [F.when(F.col("reason").isNull(), F.col(c)) for c in ("ck_up", "nonce", "aad", "ct", "tag")]
    opened = ready.withColumn("fact", open_frames(*args))
    opened = opened.drop("salt8", "ck_up", "nonce", "aad")
    return reject(opened, F.when(F.col("fact.pod_id").isNull(), F.lit("decrypt_failed")))


def check_binding(decoded: DataFrame, pod_id="fact.pod_id", fact_fc="fact.fc") -> DataFrame:
    return reject(decoded, C.first_failure([
        ("payload_device_id_mismatch", C.dev_id_of(pod_id) != F.col("dev_id")),
        ("payload_fc_mismatch", F.col(fact_fc) != F.col("fc"))]))


def sample_types(spark) -> DataFrame:
    """The fixed dimension (51 rows)."""
    return spark.createDataFrame(V.SAMPLE_TYPES, "sample_type int, sample_name string, property_key string")


def kind_label(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("string")
    for code, label in V.FACT_KINDS:
        out = F.when(col == code, F.lit(label)).otherwise(out)
    return out


def shape_facts(decoded: DataFrame, pod_time: str = "pod_time") -> DataFrame:
    """Accepted facts: labels, stamped ingest time, pod time filled in after replay admission."""
    names = F.broadcast(sample_types(decoded.sparkSession).select(
        F.col("sample_type").alias("_code"), "sample_name"))
    f = F.col("fact")
    df = decoded.join(names, f["sample_type"] == F.col("_code"), "left")
    env = F.struct(
        F.col("sample_name").alias("sample_type"), f["start"].alias("phenomenon_time_start"),
        f["end"].alias("phenomenon_time_end"), f["value"].alias("value"), f["min"].alias("min"),
        f["max"].alias("max"), f["mean"].alias("mean"), f["count"].alias("count"),
        f["quality"].alias("quality"), f["sensor_channel"].alias("sensor_channel"))
    return df.select(
        "arrival_seq", "dev_id", "msg_type", "flags", f["pod_id"].alias("pod_id"),
        f["fc"].cast("bigint").alias("fc"), "ingest_time",
        C.format_rfc3339("ingest_time").alias("ingest_time_rfc3339_utc"),
        F.coalesce(f["pod_time"], F.col(pod_time)).alias("pod_time"),
        kind_label(f["kind"]).alias("kind"),
        F.struct(F.when(f["custom"].isNull(), env).alias("Env"), f["custom"].alias("Custom"))
        .alias("payload"))


def env_error(df: DataFrame) -> DataFrame:
    """Instant and summary rules of environmental facts; ``error`` is NULL when one holds."""
    instant = (F.col("value").isNotNull() & (F.col("start") == F.col("end"))
               & F.coalesce(F.col("count") == 1, F.lit(False)))
    stats = F.col("min").isNotNull() & F.col("max").isNotNull() & F.col("mean").isNotNull()
    return df.withColumn("error", C.first_failure([
        ("time_range", F.col("start") > F.col("end")),
        ("count", F.coalesce(F.col("count") < 1, F.lit(False))),
        ("instant", F.col("value").isNotNull() & ~instant),
        ("summary", F.col("value").isNull()
         & ~(stats & F.coalesce(F.col("count") >= 1, F.lit(False))))]))


def admit_frames(lines: DataFrame, devices: DataFrame, raw: str = "raw") -> DataFrame:
    """From frame lines to decisions: one row per line, with ``reason`` and ``stage`` of a refused one and the decoded ``fact`` of
    an admitted one (see ``split_admission`` and ``shape_facts``).

    ``lines`` has the text, a unique ``arrival_seq`` and any other columns, which pass through. Checks come in the fixed order:
    parsing, device lookup, lengths, nonce, authentication, binding of the payload to the header, replay. A frame that fails one
    never reaches the next, so only authentic frames use up counters. Decryption happens once: its result is staged, without
    key material, and read for the replay decision and again for the rows.
    """
    from sealstream.operators.replay import admit_replay

    checked = check_nonce(check_lengths(join_devices(classify_frames(lines, raw), devices)))
    checked = staged(check_binding(decrypt_frames(checked)))
    replay = admit_replay(checked.filter("reason is null").select("dev_id", "arrival_seq", "fc"))
    decided = checked.join(replay.select("arrival_seq", F.col("reason").alias("_r")), "arrival_seq", "left")
    decided = reject(decided, F.col("_r")).drop("_r")
    return decided.withColumns({"stage": stage_of("reason"), "fact": F.when(F.col("reason").isNull(), F.col("fact"))})


PARSE_REASONS = ["invalid_json", "invalid_ingest_profile", "missing_frame_fields", "invalid_hdr",
                 "invalid_hdr_types", "invalid_frame_types", "invalid_base64"]
REPLAY_REASONS = ["duplicate", "out_of_window"]


def stage_of(reason: str) -> Column:
    """``replay``, ``parse`` or ``decrypt``; NULL for an admitted frame."""
    col = F.col(reason)
    return F.when(col.isNull(), F.lit(None).cast("string")).when(col.isin(REPLAY_REASONS), "replay").when(
        col.isin(PARSE_REASONS), "parse").otherwise("decrypt")


def split_admission(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). ``source`` is ``replay`` or ``decrypt``; ``stage`` also tells
    parse failures apart."""
    rejected = classified.filter("reason is not null").withColumns({
        "source": F.when(F.col("reason").isin(REPLAY_REASONS), "replay").otherwise("decrypt"),
        "stage": stage_of("reason")})
    return classified.filter("reason is null"), rejected


def check_rejections(records: DataFrame) -> DataFrame:
    """Closed vocabularies and digest form of rejection audit records."""
    return records.withColumn("error", C.first_failure([
        ("unknown_source", ~F.coalesce(F.col("source").isin(V.REJECTION_SOURCES), F.lit(False))),
        ("unknown_reason", ~F.coalesce(F.col("reason").isin(V.REJECTION_REASONS), F.lit(False))),
        ("invalid_frame_hash", ~C.is_hex("frame_sha256", 64))]))


def conservation(frames: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: input, accepted and rejected counts and whether they add up. The decisions are read once."""
    input_rows = frames.groupBy().agg(F.count(F.lit(1)).alias("input"), F.lit(0).alias("accepted"), F.lit(0).alias("rejected"))
    decided = classified.groupBy().agg(F.lit(0).alias("input"), F.count_if(F.col("reason").isNull()).alias("accepted"),
                                       F.count("reason").alias("rejected"))
    sums = input_rows.unionByName(decided).groupBy().agg(*[F.sum(c).alias(c) for c in ("input", "accepted", "rejected")])
    return sums.withColumn("balanced", F.col("input") == F.col("accepted") + F.col("rejected"))
