"""Readers of frame lines, device and provisioning tables and audit lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealstream.operators.plan import staged

ENTRY = ("struct<salt8:string,ck_up:string,highest_fc_seen:bigint,last_seen:string,"
         "msg_type:int,flags:int>")
REJECTION = ("device_id string, fc bigint, reason string, observed_at_utc string, "
             "frame_sha256 string, source string")
FRAME_LINES = "value string"


def read_frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Frame lines with the raw text kept. Batch reads number arrivals by file and offset:
    ``monotonically_increasing_id`` follows file order within the scan."""
    if streaming:
        return spark.readStream.format("text").load(path).select(F.col("value").alias("raw"))
    return spark.read.text(path).select(
        F.col("value").alias("raw"), F.monotonically_increasing_id().alias("arrival_seq"))


def explode_device_map(texts: DataFrame, col: str = "value") -> DataFrame:
    """Object map (numeric key -> entry) to rows; ``_meta`` and other keys are left out."""
    entries = F.explode(F.from_json(F.col(col), f"map<string,{ENTRY}>")).alias("key", "e")
    rows = texts.select(entries).filter(F.col("key").rlike(r"^[0-9]{1,5}\z"))
    return rows.select(F.col("key").cast("int").alias("dev_id"), "e.*")


def read_device_table(spark: SparkSession, path: str) -> DataFrame:
    return explode_device_map(spark.read.text(path, wholetext=True))


PROVISIONING = """struct<site_id:string,deployment:struct<deployment_sensor_key:string,
  sensor_keys:map<string,string>>,records:array<struct<pod_id:string,site_id:string,
  firmware_version:string,firmware_hash:string,identity_pubkey:string,birth_cert_sig:string,
  provisioned_at:string,deployment:struct<deployment_sensor_key:string,
  sensor_keys:map<string,string>>>>>"""


def explode_provisioning(texts: DataFrame, col: str = "value") -> DataFrame:
    """One row per provisioning record of JSON bundles."""
    doc = texts.select(F.from_json(F.col(col), PROVISIONING).alias("d"))
    rows = doc.select("d.site_id", "d.deployment", F.explode("d.records").alias("r"))
    return rows.select("r.pod_id", F.coalesce("r.site_id", "site_id").alias("site_id"),
                       "r.firmware_version", "r.firmware_hash", "r.identity_pubkey",
                       "r.birth_cert_sig", "r.provisioned_at",
                       F.coalesce("r.deployment", "deployment").alias("deployment"))


def read_provisioning(spark: SparkSession, path: str) -> DataFrame:
    return explode_provisioning(spark.read.text(path, wholetext=True))


def parse_rejections(lines: DataFrame, col: str = "value", *keep: str) -> DataFrame:
    """Audit lines to records; blank lines are skipped, unreadable lines become NULL fields."""
    full = lines.filter(F.trim(F.col(col)) != "")
    return full.select(*keep, F.from_json(F.col(col), REJECTION).alias("r")).select(*keep, "r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files with file and 1-based line number, blank ones too; a large file is read by many tasks.

    Lines are numbered inside the split of the file that a task reads; the lines of the splits before it are added.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = staged(spark.read.option("lineSep", "\n").text(path).select("value", place.alias("p"), F.monotonically_increasing_id().alias("id")))
    raw = raw.select("value", "p.file", "p.start", "id")
    splits = raw.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return raw.join(splits, ["file", "start"]).select(
        "file", (F.col("_before") + F.col("id") - F.col("_first") + 1).alias("line_number"), F.col("value").alias("line"))


def read_rejection_audit(spark: SparkSession, path: str) -> DataFrame:
    """Records with file and 1-based line number. Blank lines count but give no record."""
    return parse_rejections(numbered_lines(spark, path), "line", "file", "line_number")
