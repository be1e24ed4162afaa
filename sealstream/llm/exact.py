"""Exact deduplication of whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealstream.llm.common import lookup, whole_text
from sealstream.operators.plan import staged


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Of equal texts the row with the largest id stays. Texts meet in three steps, each of which
    groups by the full content beside the digest: inside a map task (partial aggregation), among
    the tasks of one salt, and among the winners of the salts. So a group of any size sends at
    most one row per map task to a salt and one row per salt to the last step. Documents then
    find their group by digest alone, narrow rows without text; that is exact where the content
    comparison found one text under the digest, and digests shared by different texts
    are joined by full content instead.

    NULL text counts as empty. NULL ids take part and lose to any other id; a group of only NULL
    ids has a NULL keep_id and its rows count as kept. Rows that repeat one id and text count
    each in group_size, and each is marked kept if the id stays. An empty table gives
    no rows; other columns are ignored.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(text_col).alias("_text"))
    base = base.withColumn("digest", digest(F.col("_text")))
    salted = (base.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
              .groupBy("digest", "_salt", "_text").agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_n")))
    winners = (salted.repartition("digest").groupBy("digest", "_text")
               .agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size")))
    groups = winners.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("_texts"))
    groups = staged(groups.filter((F.col("group_size") > 1) | (F.col("_texts") > 1)))

    found = lookup(base.select("doc_id", "digest"), groups, ["digest"], "group_size", ["doc_id"])
    if not groups.filter("_texts > 1").isEmpty():
        clash = groups.filter("_texts > 1").select("digest")
        exact = winners.join(clash, "digest", "left_semi")
        found = found.filter("coalesce(_texts, 1) = 1").unionByName(
            base.join(clash, "digest", "left_semi").join(exact, ["digest", "_text"])
            .select("doc_id", "digest", "keep_id", "group_size", F.lit(1).cast("bigint").alias("_texts")))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                        F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest")
