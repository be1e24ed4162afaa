"""Helpers of the training-data operators: tables, names, joins that hold under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_text(name: str = "text") -> Column:
    """The text of a document; NULL counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def carried(docs: DataFrame, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under plain inner names, and the inner name of each column to keep; columns named in
    ``replaced`` are left out, so that new columns of those names cannot clash."""
    back = {c: f"c_{i}" for i, c in enumerate(docs.columns) if c not in replaced}
    return docs.select(*[F.col(f"`{c}`").alias(v) for c, v in back.items()]), back


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches, rows: int = 256):
    """Arrow batches cut into fewer rows, so that a task holds Python objects and results of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lookup(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str, spread: list[str],
           parts: int = 10_000) -> DataFrame:
    """Left join with a table of one row per key, whatever share of the rows a key holds.

    ``weight`` is a column of ``dim``: the number of rows of the key. Keys with at least
    1/``parts`` of the total weight, and there can be no more than ``parts`` of them, are broadcast;
    their rows are then scattered by a hash of ``spread``, so the second, shuffled join
    meets only keys below that share. Columns of ``dim`` must not clash with those of ``rows``.
    """
    values = [c for c in dim.columns if c not in keys]
    total = dim.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) * parts >= total
    heavy = dim.filter(is_heavy).select(*keys, *[F.col(c).alias(f"_h_{c}") for c in values])
    light = dim.filter(~is_heavy).select(*keys, *values, F.lit(0).alias("_scatter"))
    met = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "_scatter", F.when(F.col(f"_h_{weight}").isNull(), 0).otherwise(
            1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int")))
    met = met.join(light, [*keys, "_scatter"], "left")
    return met.select(*rows.columns, *[F.coalesce(c, f"_h_{c}").alias(c) for c in values])


def spread_join(rows: DataFrame, counted: DataFrame, dim: DataFrame, key: str, spread: str,
                parts: int = 1000) -> DataFrame:
    """Inner join with a table of wide rows, whose hot keys are repeated instead of broadcast.

    ``counted`` has the keys of ``rows``, and is cheap to count. A key with more than 1/``parts`` of all rows, and there are
    fewer than ``parts`` of those, is split into lanes of that many rows by a hash of ``spread``, and its row
    of ``dim`` is repeated for each lane: at most 2 * ``parts`` repeated rows in all.
    """
    sizes = counted.groupBy(key).agg(F.count("*").alias("_n"))
    lane = max(1, (counted.count() + parts - 1) // parts)
    hot = F.broadcast(sizes.filter(F.col("_n") > lane).select(key, F.ceil(F.col("_n") / lane).cast("int").alias("_lanes")))
    rows = rows.join(hot, key, "left").withColumn(
        "_lane", F.pmod(F.xxhash64(spread), F.coalesce("_lanes", F.lit(1))).cast("int")).drop("_lanes")
    dim = dim.join(hot, key, "left").withColumn(
        "_lane", F.explode(F.sequence(F.lit(0), F.coalesce("_lanes", F.lit(1)) - 1))).drop("_lanes")
    return rows.join(dim, [key, "_lane"]).drop("_lane")


def kth_largest(rows: DataFrame, col: str, k: int, few: int = 4096) -> float | None:
    """The k-th largest value of a column, exactly: counts in ever narrower ranges, then the values of a last range.
    The driver gets at most ``few`` rows or counts at a time."""
    values = rows.select(F.col(col).alias("x")).filter("x IS NOT NULL")
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n or k < 1:
        return None
    if k >= n:
        return low
    while True:
        inside = values.filter((F.col("x") >= low) & (F.col("x") <= high))
        if n <= few or low == high:
            return sorted((r.x for r in inside.collect()), reverse=True)[k - 1] if low != high else low
        step = (high - low) / 1024
        if step <= 0 or low + step == low:  # neighbours that no range divides: the values are few and repeat
            counts = sorted(inside.groupBy("x").count().collect(), reverse=True)
            for x, c in counts:
                if k <= c:
                    return x
                k -= c
        slot = F.least(F.floor((F.col("x") - low) / step), F.lit(1023))
        parts = inside.groupBy(slot.alias("s")).agg(F.count("*"), F.min("x"), F.max("x")).collect()
        for _, c, least, most in sorted(parts, key=lambda r: -r[0]):
            if k <= c:
                low, high, n = least, most, c
                break
            k -= c
