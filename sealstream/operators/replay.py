"""Replay window admission over arrival order, in parallel also within one device.

The only sequential value is the highest admitted counter ``h``: a frame moves it when
``h < fc <= h + window``. Each bounded chunk of a device's arrivals is summarized as a step
function of ``h``; chaining these short summaries gives every chunk its starting value.
Given ``h``, a frame is out of window, or the first of its counter, or a duplicate. Devices
with one chunk need no chaining at all.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealstream.functions import values as V

CHUNK = 8192
_SPAN = 65536  # arrival numbers per counting bucket; unique, so at most this many rows


def chunked(frames: DataFrame, key: str, order: str, cols: list[str], chunk: int) -> DataFrame:
    """Exact chunks of ``chunk`` consecutive rows per key: key, ``chunk``, ``n``, ``rows`` array.

    Positions are counted per arrival bucket and offset by bucket totals, so no window spans
    a whole key.
    """
    rows = frames.select(key, order, *cols).withColumn(
        "_b", F.coalesce(F.expr(f"{order} div {_SPAN}"), F.lit(0)))
    sizes = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                           F.sum("_n").over(Window.partitionBy(key)).alias("n"))
    local = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order)) - 1
    placed = rows.withColumn("_i", local).join(offsets, [key, "_b"])
    return (placed.withColumn("chunk", F.floor((F.col("_off") + F.col("_i")) / chunk).cast("bigint"))
            .groupBy(key, "chunk")
            .agg(F.max("n").alias("n"),
                 F.array_sort(F.collect_list(F.struct(order, *cols))).alias("rows")))


class StepMap:
    """h -> h after a chunk; intervals not listed leave h unchanged."""

    def __init__(self):
        self.lo, self.hi, self.to = [], [], []

    def get(self, h: int) -> int:
        i = bisect_right(self.lo, h) - 1
        return self.to[i] if i >= 0 and h <= self.hi[i] else h

    def put(self, lo: int, hi: int, to: int) -> None:
        """Overwrite [lo, hi]; pieces with the same target that touch it are merged."""
        i = max(bisect_right(self.lo, lo) - 1, 0)
        while i < len(self.lo) and self.hi[i] < lo - 1:
            i += 1
        j, keep = i, []
        while j < len(self.lo) and self.lo[j] <= hi + 1:
            if self.to[j] == to:
                lo, hi = min(lo, self.lo[j]), max(hi, self.hi[j])
            else:
                if self.lo[j] < lo:
                    keep.append((self.lo[j], min(self.hi[j], lo - 1), self.to[j]))
                if self.hi[j] > hi:
                    keep.append((max(self.lo[j], hi + 1), self.hi[j], self.to[j]))
            j += 1
        pieces = sorted([*keep, (lo, hi, to)])
        for part, column in zip((self.lo, self.hi, self.to), zip(*pieces)):
            part[i:j] = column


def _transitions(window: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for fcs in pdf["fcs"]:
                steps, last = StepMap(), None
                for fc in reversed([int(x) for x in fcs]):
                    last = steps.get(fc)
                    if fc > 0:
                        steps.put(max(fc - window, 0), fc - 1, last)
                out.append((last, steps.lo, steps.hi, steps.to))
            yield pd.DataFrame({"k": pdf["k"], "chunk": pdf["chunk"], "h0": pdf["h0"],
                                "fresh": [o[0] for o in out], "lo": [o[1] for o in out],
                                "hi": [o[2] for o in out], "to": [o[3] for o in out]})
    return run


def _chain(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (k, chunk): the value of h before each chunk. Holds one row at a time."""
    key, h = None, None
    for pdf in it:
        starts = []
        for row in pdf.itertuples(index=False):
            if row.k != key:
                key, h = row.k, (None if pd.isna(row.h0) else int(row.h0))
            starts.append(h)
            if h is None:
                h = int(row.fresh)
            else:
                i = bisect_right(row.lo, h) - 1
                if i >= 0 and h <= row.hi[i]:
                    h = int(row.to[i])
        yield pd.DataFrame({"k": pdf["k"], "chunk": pdf["chunk"],
                            "h_in": pd.array(starts, dtype="Int64")})


def _classify(window: int):
    @F.pandas_udf("array<tinyint>")
    def codes(fcs: pd.Series, h_in: pd.Series, seen: pd.Series) -> pd.Series:
        """0 first of its counter in this chunk, 1 duplicate, 2 out of window."""
        out = []
        for chunk, start, known in zip(fcs, h_in, seen):
            h = None if pd.isna(start) else int(start)
            have = set() if known is None else {int(x) for x in known}
            res = []
            for fc in (int(x) for x in chunk):
                if h is not None and abs(fc - h) > window:
                    res.append(2)
                elif fc in have:
                    res.append(1)
                else:
                    have.add(fc)
                    res.append(0)
                    h = fc if h is None or fc > h else h
            out.append(res)
        return pd.Series(out)
    return codes


def admit_replay(frames: DataFrame, window: int = V.REPLAY_WINDOW, key: str = "dev_id",
                 order: str = "arrival_seq", fc: str = "fc", initial: DataFrame | None = None,
                 chunk: int = CHUNK) -> DataFrame:
    """Decision per frame: key, order, fc, ``reason`` (NULL, ``duplicate``, ``out_of_window``).

    ``initial`` holds restored state (key, ``highest``, ``seen``), see ``restore_replay``.
    """
    chunks = chunked(frames.withColumnRenamed(fc, "_fc"), key, order, ["_fc"], chunk)
    if initial is None:
        chunks = chunks.withColumn("h0", F.lit(None).cast("bigint")).withColumn(
            "seen", F.lit(None).cast("array<bigint>"))
    else:
        state = initial.select(key, F.col("highest").cast("bigint").alias("h0"),
                               F.col("seen").cast("array<bigint>").alias("seen"))
        chunks = chunks.join(state, key, "left")
    chunks = chunks.withColumn("fcs", F.transform("rows", lambda r: r["_fc"].cast("bigint")))
    decide = _classify(window)

    def opened(df, code_of):
        zipped = F.explode(F.arrays_zip("rows", code_of.alias("code"))).alias("r")
        return df.select(key, "chunk", zipped).select(
            key, "chunk", F.col(f"r.rows.{order}").alias(order), F.col("r.rows._fc").alias("_fc"),
            F.col("r.code").alias("_code"))

    single = chunks.filter(F.col("n") <= chunk)
    single = single.withColumn("code", decide("fcs", F.col("h0"), "seen"))
    cold = opened(single, F.col("code"))

    many = chunks.filter(F.col("n") > chunk)
    steps = many.select(F.col(key).alias("k"), "chunk", "h0", "fcs").mapInPandas(
        _transitions(window), many.select(F.col(key).alias("k"), "chunk", "h0").schema.simpleString()
        .removeprefix("struct<").removesuffix(">").replace(":", " ")
        + ", fresh bigint, lo array<bigint>, hi array<bigint>, to array<bigint>")
    key_type = dict(many.dtypes)[key]
    starts = (steps.repartition("k").sortWithinPartitions("k", "chunk")
              .mapInPandas(_chain, f"k {key_type}, chunk bigint, h_in bigint")
              .withColumnRenamed("k", key))
    many = many.join(starts, [key, "chunk"]).withColumn("code", decide("fcs", "h_in", "seen"))
    hot = opened(many, F.col("code"))
    # Other copies of a counter inside a chunk are settled already; only one candidate per
    # chunk meets the others here, the settled rows are spread by chunk.
    lane = F.when(F.col("_code") == 0, F.lit(-1)).otherwise(F.col("chunk"))
    first = F.min(order).over(Window.partitionBy(key, "_fc", lane))
    hot = hot.withColumn("_code", F.when((F.col("_code") == 0) & (F.col(order) != first), F.lit(1))
                         .otherwise(F.col("_code")).cast("tinyint"))
    both = cold.unionByName(hot)
    reason = F.when(F.col("_code") == 1, "duplicate").when(F.col("_code") == 2, "out_of_window")
    return both.select(key, order, F.col("_fc").alias(fc), reason.alias("reason"))


def snapshot_replay(decisions: DataFrame, window: int = V.REPLAY_WINDOW, key: str = "dev_id",
                    fc: str = "fc", initial: DataFrame | None = None) -> DataFrame:
    """State after the decisions: key, ``version``, ``window_size``, ``highest``, ``seen``.

    Admitted counters are unique per device, so ``seen`` holds at most window + 1 of them.
    """
    admitted = decisions.filter("reason is null").select(key, F.col(fc).cast("bigint").alias("_fc"))
    if initial is not None:
        old = initial.select(key, F.explode(F.array_union(
            F.col("seen").cast("array<bigint>"), F.array(F.col("highest").cast("bigint")))).alias("_fc"))
        admitted = admitted.unionByName(old).distinct()
    # Counters are unique, so a bucket of window + 1 of them is a bounded list, and the kept
    # ones lie in a device's last two buckets. Both steps combine before their shuffle.
    width = window + 1
    lists = admitted.groupBy(key, F.expr(f"_fc div {width}").alias("_b")).agg(
        F.collect_set("_fc").alias("_c"))
    none = F.lit(None).cast("array<bigint>")
    pairs = lists.select(key, "_b", F.col("_c").alias("cur"), none.alias("prev")).unionByName(
        lists.select(key, (F.col("_b") + 1).alias("_b"), none.alias("cur"), F.col("_c").alias("prev")))
    buckets = pairs.groupBy(key, "_b").agg(F.max("cur").alias("cur"), F.max("prev").alias("prev"))
    last = buckets.filter("cur is not null").groupBy(key).agg(
        F.max_by(F.struct("cur", "prev"), "_b").alias("_l"))
    highest = F.array_max("_l.cur")
    near = F.concat("_l.cur", F.coalesce("_l.prev", F.array().cast("array<bigint>")))
    return last.select(
        key, F.lit(1).alias("version"), F.lit(window).alias("window_size"), highest.alias("highest"),
        F.sort_array(F.filter(near, lambda x: x >= highest - window)).alias("seen"))


def restore_replay(snapshots: DataFrame) -> DataFrame:
    """Snapshot rows with ``error`` = ``continuity_break`` where they cannot be continued."""
    seen = F.coalesce(F.col("seen"), F.array().cast("array<bigint>"))
    low = F.greatest(F.col("highest") - F.col("window_size"), F.lit(0))
    outside = F.exists(seen, lambda x: (x < low) | (x > F.col("highest")))
    bad = ((F.col("version") != 1) | (F.col("window_size") == 0)
           | F.when(F.col("highest").isNull(), F.size(seen) > 0).otherwise(outside))
    return snapshots.withColumn("error", F.when(bad, "continuity_break")).withColumn(
        "seen", F.when(F.col("highest").isNull(), seen).otherwise(
            F.array_union(seen, F.array(F.col("highest").cast("bigint")))))


def first_per_counter(frames: DataFrame, key: str = "dev_id", fc: str = "fc",
                      order: str = "arrival_seq") -> DataFrame:
    """First arrival per (device, counter): a map-side combined minimum, no window."""
    return frames.groupBy(key, fc).agg(F.min(order).alias(order))


def device_state(accepted: DataFrame) -> DataFrame:
    """Latest admitted state per device: highest counter, last seen time, type and flags."""
    last = F.max_by(F.struct("ingest_time", "msg_type", "flags"), "arrival_seq")
    return accepted.groupBy("dev_id").agg(F.max("fc").alias("highest_fc_seen"), last.alias("_l")).select(
        "dev_id", "highest_fc_seen", F.col("_l.ingest_time").alias("last_seen"),
        F.col("_l.msg_type").alias("msg_type"), F.col("_l.flags").alias("flags"))
