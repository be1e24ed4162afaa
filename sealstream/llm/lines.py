"""Line deduplication over all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealstream.llm.common import carried, lookup, lower_ascii, whole_text
from sealstream.operators.plan import staged


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit("\t\n\x0b\x0c\r ")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    r"""``docs`` with its text column replaced, and n_lines, n_dropped.

    Lines (split at \n) whose key has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents go, except in the document of the largest id that holds it.

    Lines are exploded to narrow rows (16-byte hash, document, position). Documents per hash are
    counted in two aggregations with partial sums, so a line of any frequency sends one row per
    task. Positions to drop come from a join of those rows with the frequent hashes, where the most
    frequent are broadcast (their number is bounded). Text is shuffled once, to meet its positions.

    NULL or empty text is one empty line. Rows of one id are one document for the count;
    rows are told apart by id and a hash of the text, so an id may repeat. Rows with a NULL id
    together count as one document that never holds the largest id. A document that loses all
    its lines stays, with empty text. Other columns pass through, except those named n_lines or n_dropped.
    """
    body = docs.select(F.col(f"`{id_col}`").alias("_id"), whole_text(text_col).alias("_text"))
    body = body.withColumn("_row", F.xxhash64("_text"))
    lines = body.select("_id", "_row", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    lines = lines.select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
    lines = lines.filter(F.length("_key") >= min_chars).select(
        F.unhex(F.md5("_key")).alias("_hash"), "_id", "_row", "_pos")
    frequent = (lines.groupBy("_hash", "_id").agg(F.count("*").alias("_rows"))
                .groupBy("_hash").agg(F.count("*").alias("_docs"), F.sum("_rows").alias("_weight"),
                                      F.max("_id").alias("_keep")))
    frequent = staged(frequent.filter(F.col("_docs") >= min_docs))
    drops = lookup(lines, frequent, ["_hash"], "_weight", ["_id", "_pos"])
    drops = drops.filter(F.col("_docs").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keep")))
    drops = drops.groupBy(F.col("_id").alias("_d_id"), F.col("_row").alias("_d_row")).agg(
        F.collect_set("_pos").alias("_drop"))

    rows, at = carried(docs, tuple({"n_lines", "n_dropped"} - {id_col, text_col}))
    rows = rows.withColumn("_text", whole_text(at[text_col])).withColumn("_row", F.xxhash64("_text"))
    rows = rows.join(drops, F.col(at[id_col]).eqNullSafe(F.col("_d_id")) & (F.col("_row") == F.col("_d_row")), "left")
    rows = rows.withColumn("_lines", F.split("_text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    text = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    return rows.select(
        *[(text if c == text_col else F.col(inner)).alias(c) for c, inner in at.items()],
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("bigint").alias("n_dropped"))
