"""Token ids as Parquet list columns, in id order, and reading them back.

File layout: one file per range of document ids, rows in ascending order. Columns ``doc_id`` and
``n_tokens`` are delta encoded, so the index of a corpus is read without its tokens; ``ids`` is a list
column with a dictionary per row group. Row groups and pages have set sizes, and every
page has an entry in the page index, so a filter on ``doc_id`` reads the pages it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealstream.llm.common import slices, whole_text
from sealstream.llm.encoding import encoder

LAYOUT = {
    "parquet.writer.version": "v2",  # delta encoding where there is no dictionary
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id and ids of whole texts, each with ``end_id`` appended; NULL text counts as empty.

    Rows keep their order and number within a partition. Encoding needs the tokenizer's library, so it runs in
    Arrow batches; everything else here is DataFrame work.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        for batch in slices(batches):
            found = [np.append(i, np.uint32(end_id)) for i in model.encode(batch["_text"].to_pylist())]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["_id"], ids], ["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").alias("_id"), whole_text(text_col).alias("_text")).mapInArrow(
        run, f"doc_id {id_type}, ids array<int>")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents dealt out by ranges of ids and sorted inside each. Rows of one id are told apart by
    their text, so an id that repeats any number of times is spread and its order is fixed."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    return rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Writes doc_id and ids in the layout above. The rows must come in order, as ``in_order`` gives them.

    An empty table leaves a folder with the schema alone. A task that runs again replaces its own file only.
    """
    rows = tokens.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")
    rows.write.options(**LAYOUT).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the place of a row: file and row in it. Columns not used are not read."""
    rows = spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").parquet(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def with_starts(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` of ``read_tokens``, or narrower ones with file, row and n_tokens, with start: the number of ids of
    all rows before.

    Totals per file come from ``index``, the files' narrow columns, and give each file its offset (one row
    per file in one task); a window inside each file does the rest.
    """
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("bigint")  # names alone sort wrong from part 100,000 on
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("_total"))
    files = files.select("file", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    start = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.withColumn("start", start).join(files, "file").withColumn(
        "start", F.col("start") + F.col("_offset")).drop("_offset")
