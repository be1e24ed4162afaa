"""Analytical aggregations over facts, rejections, channels and attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealstream.operators.plan import count_up, previous_row, staged


def rejection_report(rejections: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by every prefix of ``dims`` (rollup)."""
    return rejections.rollup(*dims).agg(F.count(F.lit(1)).alias("n"))


def daily_batches(facts: DataFrame) -> DataFrame:
    """Facts with the UTC day that batches them, from unix ``ingest_time``."""
    from sealstream.functions.columns import utc_day
    return facts.withColumn("day", utc_day("ingest_time"))


SERIES = ["pod_id", "sample_type", "sensor_channel"]


def window_summary(facts: DataFrame, every_s: int = 86400, value: str = "value") -> DataFrame:
    """min, max, mean and count per series and window of ``start`` seconds."""
    begin = F.expr(f"start - pmod(start, {every_s})")
    return (facts.groupBy(*SERIES, begin.alias("window_start"))
            .agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
                 F.count(value).alias("count"))
            .withColumn("window_end", F.col("window_start") + (every_s - 1)))


def merge_summaries(summaries: DataFrame, every_s: int = 86400) -> DataFrame:
    """Summaries of finer windows to coarser ones; means are weighted by their counts."""
    begin = F.expr(f"window_start - pmod(window_start, {every_s})")
    return (summaries.groupBy(*SERIES, begin.alias("window_start"))
            .agg(F.min("min").alias("min"), F.max("max").alias("max"),
                 (F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("mean"),
                 F.sum("count").alias("count")))


def _in_order(freq: DataFrame, part: list[str]) -> DataFrame:
    """Frequencies with ``_c``, the number of values up to each; a part has a bounded number of rows."""
    upto = Window.partitionBy(*part).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return freq.withColumn("_c", F.sum("n").over(upto))


def _narrowed(freq: DataFrame, group: list[str], want: DataFrame, few: int) -> DataFrame:
    """(group, name, value): the value at place ``left`` among a group's values from ``lo`` to ``hi``, for each row of ``want``.

    All groups go together: a range is cut into 1,024 slots, values are counted per slot, and the slot that holds the place
    is the next range, until a range has at most ``few`` distinct values and is sorted.
    """
    part, found = [*group, "lo", "hi"], None
    while True:
        want = staged(want)
        ranges = want.select(*part, "d").distinct()
        ranges = F.broadcast(ranges) if ranges.count() <= 10_000 else ranges
        inside = freq.join(ranges, group).filter("value BETWEEN lo AND hi")
        # Staged, as the union of branches that adaptive execution deals differently fails on their numbers of partitions.
        hit = staged(_in_order(inside.filter(F.col("d") <= few), part).join(want.select(*part, "name", "left"), part).filter(
            "_c > left AND _c - n <= left").select(*group, "name", "value"))
        found = hit if found is None else found.unionByName(hit)
        wide = want.filter(F.col("d") > few)
        if wide.isEmpty():
            return found
        share = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: no overflow
        slot = F.least(F.floor(share * 1024), F.lit(1023))
        slots = inside.filter(F.col("d") > few).groupBy(*part, slot.alias("slot")).agg(
            F.sum("n").alias("n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count(F.lit(1)).alias("_d"))
        before = Window.partitionBy(*part).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        slots = slots.withColumn("_c", F.sum("n").over(before))
        want = wide.drop("d").join(slots, part).filter("_c > left AND _c - n <= left").select(
            *group, "name", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_d").alias("d"),
            (F.col("left") - F.col("_c") + F.col("n")).alias("left"))


def quantiles(freq: DataFrame, group: list[str], points: dict[str, float], few: int = 4096) -> DataFrame:
    """Exact interpolated quantiles from value frequencies (group, ``value``, ``n``); NULL values are left out, and a group
    without others has no row.

    Groups of at most ``few`` distinct values are sorted; in others each place is found by narrowing ranges of values
    (see ``_narrowed``), so no window spans a large group. ``freq`` is read several times.
    """
    freq = freq.filter("value IS NOT NULL")
    sizes = staged(freq.groupBy(*group).agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("d"), F.min("value").alias("lo"),
                                            F.max("value").alias("hi")))
    places = {n: (F.col("_t") - 1) * F.lit(q) for n, q in points.items()}
    names = [f"{n}_{end}" for n in points for end in ("lo", "hi")]

    def at(index):
        return F.max(F.when((F.col("_c") > index) & (F.col("_c") - F.col("n") <= index), F.col("value")))
    ends = {f"{n}_{end}": rounded(place) for n, place in places.items() for end, rounded in (("lo", F.floor), ("hi", F.ceil))}
    whole = Window.partitionBy(*group)
    is_wide = F.col("d") > few
    wide = sizes.filter(is_wide)
    small = freq if wide.isEmpty() else freq.join(sizes.filter(~is_wide).select(*group), group, "left_semi")
    ranked = _in_order(small, group).withColumn("_t", F.sum("n").over(whole))
    found = ranked.groupBy(*group).agg(*[at(ends[n]).alias(n) for n in names], F.max("_t").alias("_t"))
    if not wide.isEmpty():
        want = wide.select(*group, "lo", "hi", "d", F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"), c.alias("left")) for n, c in ends.items()])).alias("x")).select(
            *group, "lo", "hi", "d", "x.name", "x.left")
        values = _narrowed(freq, group, want, few).groupBy(*group).agg(*[
            F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
        found = found.unionByName(staged(values.join(sizes.select(*group, "_t"), group)))
    return found.select(*group, *[
        (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * (p - F.floor(p))).alias(n) for n, p in places.items()])


def derived_daily_metrics(facts: DataFrame, expected: int, ratio: float = 0.5,
                          value: str = "value", few: int = 4096) -> DataFrame:
    """Per series and day: spread, quartiles, change of the mean, stability, sufficiency and
    values outside 1.5 interquartile ranges. NULL values (summaries have no value) count nowhere; a series and day
    of NULLs alone has a row with count 0.

    Facts are read once: values are counted first, and all else works on distinct values.
    """
    group = [*SERIES, "day"]
    freq = staged(facts.groupBy(*group, F.col(value).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n")))
    own = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    base = freq.groupBy(*group).agg((F.sum(F.col("value") * F.col("n")) / F.nullif(F.sum(own), F.lit(0))).alias("mean"),
                                    F.sum(own).alias("count"))
    full = base.join(quantiles(freq, group, {"q1": 0.25, "median": 0.5, "q3": 0.75}, few), group, "left")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    outside = (F.col("value") < F.col("q1") - fence) | (F.col("value") > F.col("q3") + fence)
    away = F.col("value") - F.col("mean")
    spread = freq.join(full.select(*group, "mean", "q1", "q3"), group).groupBy(*group).agg(
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outliers"), F.sum(F.col("n") * away * away).alias("_s"))
    prev = F.lag("mean").over(Window.partitionBy(*SERIES).orderBy("day"))
    return (full.join(spread, group)
            .withColumn("stddev", F.when(F.col("count") > 1, F.sqrt(F.col("_s") / (F.col("count") - 1)))).drop("_s")
            .withColumn("delta", F.col("mean") - prev)
            .withColumn("stability", F.col("stddev") / F.abs("mean"))
            .withColumn("sufficient", F.col("count") >= expected * ratio))


def frame_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("site_id", "day").agg(F.count(F.lit(1)).alias("frame_count"))


def detect_gaps(accepted: DataFrame, cadence_s: int) -> DataFrame:
    """Missing counters and silent periods per pod, one incident per gap, in counter order."""
    seen = previous_row(accepted.select("pod_id", "fc", "ingest_time"), ["pod_id"], "fc",
                        ["fc", "ingest_time"])
    missed = F.col("fc") - F.col("prev_fc") - 1
    silent = F.col("ingest_time") - F.col("prev_ingest_time")
    return seen.filter((missed > 0) | (silent > cadence_s)).select(
        "pod_id", (F.col("prev_fc") + 1).alias("first_missing"), (F.col("fc") - 1).alias("last_missing"),
        missed.alias("missed_frames"), silent.alias("silent_s"),
        F.when(missed > 0, "missed_frames").otherwise("silence").alias("kind"))


def classify_absences(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Counters between a device's first and last admitted one that were not admitted:
    ``observed_rejected`` or ``not_observed``. A gap of any width becomes
    rows in two bounded steps."""
    seen = previous_row(accepted.select("dev_id", "fc"), ["dev_id"], "fc", ["fc"])
    holes = seen.filter("fc - prev_fc > 1").select(
        "dev_id", (F.col("prev_fc") + 1).alias("_from"), (F.col("fc") - 1).alias("_to"))
    holes = count_up(holes, F.col("_from"), F.col("_to"), "fc").select("dev_id", "fc")
    refused = rejected.groupBy("dev_id", "fc").agg(F.min("reason").alias("reason"))
    return holes.join(refused, ["dev_id", "fc"], "left").withColumn(
        "status", F.when(F.col("reason").isNull(), "not_observed").otherwise("observed_rejected"))


def reduce_channels(channels: DataFrame, group: list[str], mode: str = "strict") -> DataFrame:
    """``overall`` per bundle from rows (channel, enabled, status)."""
    on = F.coalesce(F.col("enabled"), F.lit(False))
    if mode == "strict":
        bad = on & ~F.coalesce(F.col("status") == "verified", F.lit(False))
    else:
        bad = on & (F.col("channel") == "ots") & F.col("status").isin("failed", "missing")
    return channels.groupBy(*group).agg(
        F.when(F.bool_or(F.coalesce(bad, F.lit(False))), "failed").otherwise("success").alias("overall"))


CHANNELS = ["ots", "tsa", "peers"]


def anchoring_matrix(channels: DataFrame) -> DataFrame:
    """Status per channel and (site_id, day) as columns, with the flags of the day report."""
    wide = channels.groupBy("site_id", "day").pivot("channel", CHANNELS).agg(F.max("status"))
    return wide.withColumns({
        "ots_verified": F.coalesce(F.col("ots") == "verified", F.lit(False)),
        "tsa_verified": F.coalesce(F.col("tsa") == "verified", F.lit(False))})


def peer_quorum(attestations: DataFrame, k: int) -> DataFrame:
    """Distinct peers per attested root; repeated signatures are merged before the shuffle."""
    one = attestations.groupBy("site_id", "day", "day_root", "peer_id").agg(F.count(F.lit(1)).alias("_n"))
    return (one.groupBy("site_id", "day", "day_root").agg(F.count(F.lit(1)).alias("peers"))
            .withColumn("quorum", F.col("peers") >= k))


def anchor_index(receipts: DataFrame) -> DataFrame:
    """Totals over anchor receipts: anchors, changed ones and liveness warnings."""
    return receipts.agg(F.count(F.lit(1)).alias("anchors"),
                        F.sum(F.col("changed").cast("bigint")).alias("changed"),
                        F.sum(F.size("warnings")).alias("warnings"))
