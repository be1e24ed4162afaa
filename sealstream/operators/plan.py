"""Small plan helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pinned(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once.

    A filter on a derived column is pushed below the projection with its whole expression
    inlined; for parsing and hashing chains that repeats the work per reference. A generator
    of one row stops the push and stays in the JVM.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, joined by sorting and never broadcast. Spark estimates sizes from
    compressed files and column widths; digests, derived texts and exploded rows are many times as large."""
    return df.hint("merge")


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Rows dealt by key into tasks of about ``rows`` rows, for small rows that much work follows on: file splits and adaptive
    execution go by bytes and would leave them in a few tasks. ``df`` is counted, so it should be cheap."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *keys)


def shared_folder(spark) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir`` of the session; local runs without
    one get a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="sealstream-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


_staged: dict[str, list[str]] = {}


def own_folder(spark, name: str) -> str:
    """Path of a new folder in the shared folder, for a result that is written and read again. It goes as staged tables do."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(release_staged)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write once, read many: a Parquet table in the shared folder.

    For results that several later passes need and that are dear to compute (decryption).
    Later passes read only their columns, and a lost executor costs no recomputation. The table goes
    with ``release_staged``, at the latest when the driver's program ends.
    """
    path = own_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_staged(spark=None) -> None:
    """Delete the staged tables of the running application; results that still read them must be written before."""
    context = spark.sparkContext if spark is not None else SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    for path in _staged.pop(context.applicationId, []):
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def running_totals(df: DataFrame, group: list[str], order: str, sums: dict[str, Column],
                   span: int = 65536) -> DataFrame:
    """Inclusive running sums per group in ``order``, without a window over a whole group.

    ``order`` is unique within a group, so a bucket of ``span`` consecutive values holds at
    most that many rows; bucket totals give each bucket its offset.
    """
    rows = df.withColumn("_b", F.coalesce(F.expr(f"{order} div {span}"), F.lit(0)))
    rows = rows.withColumns({f"_v_{n}": c for n, c in sums.items()})
    totals = rows.groupBy(*group, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_b", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    rows = rows.join(offsets, [*group, "_b"])
    return rows.select(*df.columns, *[(F.col(f"_v_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def previous_row(df: DataFrame, key: list[str], order: str, cols: list[str],
                 span: int = 65536) -> DataFrame:
    """``prev_<col>`` from the preceding row of the same key, NULL on the first.

    Inside a bucket of ``span`` order values this is a lag; the first row of a bucket takes
    the last row of the nearest bucket before it. No window spans a whole key's rows.
    """
    rows = df.withColumn("_b", F.coalesce(F.expr(f"{order} div {span}"), F.lit(0)))
    packed = F.struct(*cols)
    tails = rows.groupBy(*key, "_b").agg(F.max_by(packed, order).alias("_tail"))
    tails = tails.select(*key, "_b", F.lag("_tail").over(
        Window.partitionBy(*key).orderBy("_b")).alias("_before"))
    inside = F.lag(packed).over(Window.partitionBy(*key, "_b").orderBy(order))
    rows = rows.withColumn("_p", inside).join(tails, [*key, "_b"])
    prev = F.coalesce("_p", "_before")
    return rows.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in cols])


def running_max_before(df: DataFrame, key: list[str], order: str, col: str, name: str,
                       span: int = 65536) -> DataFrame:
    """Largest ``col`` among earlier rows of the key, by bucket maxima; NULL on the first row."""
    rows = df.withColumn("_b", F.coalesce(F.expr(f"{order} div {span}"), F.lit(0)))
    tops = rows.groupBy(*key, "_b").agg(F.max(col).alias("_m"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*key, "_b", F.max("_m").over(before).alias("_p"))
    inside = Window.partitionBy(*key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_q", F.max(col).over(inside)).join(tops, [*key, "_b"])
    return rows.select(*df.columns, F.greatest("_p", "_q").alias(name))


def salted_join(rows: DataFrame, dim: DataFrame, keys: list[str], spread: list[str],
                salts: int = 16) -> DataFrame:
    """Left join of many rows per key with one row per key: each key's rows are spread over
    ``salts`` tasks by a hash of their ``spread`` columns, the dimension row is repeated."""
    lane = F.pmod(F.xxhash64(*spread), F.lit(salts))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn(
        "_salt", F.col("_salt").cast("bigint"))
    return rows.withColumn("_salt", lane).join(merged(copies), [*keys, "_salt"], "left").drop("_salt")


def count_up(df: DataFrame, first: Column, last: Column, name: str, step: int = 65536) -> DataFrame:
    """A row for each number from ``first`` to ``last``, in two steps, so that no array of a whole range is made; none
    if ``last`` is smaller."""
    rows = df.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    rows = rows.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_last - _first) div {step})")))
    low = f"_first + _block * {step}"
    rows = rows.withColumn(name, F.explode(F.expr(f"sequence({low}, least(_last, {low} + {step - 1}))")))
    return rows.drop("_first", "_last", "_block")
