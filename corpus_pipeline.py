"""From raw documents to packed training sequences, in five stages.

Every stage works on what the one before kept. All but the last return the columns of documents; a column of any name
is carried through, whatever names the operators use. Rows with a NULL or empty text, or one without letters, go
in the language stage; an empty table gives an empty result in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealstream import ship
from sealstream.llm import langid, lines, minhash, packing, quality
from sealstream.llm.common import carried, vocabulary
from sealstream.operators.plan import staged

#: SQL cannot express fitted models, MinHash and packing; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(inner).alias(c) for c, inner in names.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents unlike the ones labelled good go: importance resampling, with the table labels as target."""
    ship(spark)
    rows, names = carried(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.resample(rows, labels, id_col=names["doc_id"], text_col=names["text"])
    return _back(rows.filter("kept"), names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go. Learns from the documents that name their language."""
    ship(spark)
    rows, names = carried(docs)
    known = langid.fit(rows, names["lang"], names["text"])
    return _back(langid.classify(rows, known, names["text"]).filter("sure"), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one. n_chars follows the text where lines went."""
    ship(spark)
    rows, names = carried(docs)
    rows = lines.line_dedup(rows, names["doc_id"], names["text"])
    if "n_chars" in names:
        chars = F.when(F.col("n_dropped") > 0, F.length(names["text"])).otherwise(F.col(names["n_chars"]))
        rows = rows.withColumn(names["n_chars"], chars.cast(docs.schema["n_chars"].dataType))
    return _back(rows, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one of the smallest id stays."""
    ship(spark)
    gone = minhash.near_duplicates(docs, size=5, percent=80).filter("NOT kept").select(
        F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents left, placed in sequences of 1024."""
    ship(spark)
    pieces = packing.document_pieces(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, keep_ids=False)
    return packing.pack(pieces, capacity=1024)


STAGES = [("quality_classifier", quality_classifier), ("language_id", language_id), ("line_dedup", line_dedup),
          ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; between stages the documents are Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
