"""Stream jobs: run available input to a table, and daily commitment of accepted facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealstream.operators import ledger as L
from sealstream.sources.sinks import write_sealed


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all input that is there into a Parquet table (exactly once) and read it."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def sealed_sink(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Producer outcomes to the sealed tables, one committed transition per micro-batch."""
    from sealstream.operators.producer import sealed_segments

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        write_sealed(sealed_segments(batch), batch.select("ledger_id", "seq", "segment_number"),
                     batch.select("ledger_id", "seq", "outcome"), path, batch_id)
        batch.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def commit_days(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Leaves (site_id, day, leaf) appended per micro-batch; block headers of the days they
    touch are recomputed and replaced."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Leaves lie by day, then batch: a retried batch replaces its own folders, and only touched days are read again.
        keyed = batch.withColumn("batch_id", F.lit(batch_id))
        (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id")
         .parquet(f"{path}/leaves"))
        leaves = spark.read.schema(keyed.schema).parquet(f"{path}/leaves")
        touched = leaves.filter(F.col("batch_id") == batch_id).select("site_id", "day").distinct()
        days = [r["day"] for r in touched.select("day").distinct().collect()]  # calendar days of one micro-batch
        every = leaves.filter(F.col("day").isin(days)).join(touched, ["site_id", "day"], "left_semi")
        blocks = L.build_block_headers(every.select("site_id", "day", "leaf"))
        (blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "site_id").parquet(f"{path}/blocks"))

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, folder: str, file: str, max_files: int = 1) -> DataFrame:
    """Parquet files named ``file`` below ``folder`` as a stream with the table's own schema."""
    schema = spark.read.option("pathGlobFilter", file).parquet(folder).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", file)
            .option("maxFilesPerTrigger", max_files).parquet(folder))
