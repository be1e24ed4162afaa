"""Transitions of sealed tables in a numbered log: one writer per revision, whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "revision bigint, previous bigint, data string, tables array<string>"


class StaleRevision(Exception):
    """Another writer has committed since the expected revision."""


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, unless one of that name is there: the file system decides between two writers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = target.getFileSystem(conf)
    files.mkdirs(target.getParent())
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getScheme() == "file":  # a link is made or refused in one step, a local rename would replace
            local = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                     for p in (target, draft)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            options = spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            context.rename(draft, target, options)
    except Exception as exc:
        if "FileAlreadyExists" in str(exc):
            return False
        raise
    finally:
        files.delete(draft, False)
    return True


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The committed transitions: revision, previous, data and tables."""
    try:
        return spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{path}/log")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def current_revision(spark: SparkSession, path: str) -> int | None:
    """The latest revision, None before the first."""
    return read_log(spark, path).agg(F.max("revision")).first()[0]


def commit_transition(spark: SparkSession, path: str, expected: int | None, tables: dict[str, DataFrame]) -> int:
    """Append rows to named tables as the revision after ``expected`` (None: the first) and return its number.

    The rows are written beside the others first; they show when the log has the file of the new revision, which is created only if
    it is absent. Of two writers that expect the same revision one wins, and the other gets ``StaleRevision`` and
    leaves nothing to be read. Revisions are numbered without gaps from 1.
    """
    now = current_revision(spark, path)
    if now != expected:
        raise StaleRevision(f"expected {expected}, found {now}")
    data, revision = f"d{uuid.uuid4().hex}", (expected or 0) + 1
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/data/{name}/data={data}")
    entry = {"revision": revision, "previous": expected, "data": data, "tables": sorted(tables)}
    if not _created(spark, f"{path}/log/{revision:020d}.json", json.dumps(entry) + "\n"):
        for name in tables:
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/{name}/data={data}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        raise StaleRevision(f"revision {revision} was committed by another writer")
    return revision


def read_committed(spark: SparkSession, path: str, name: str, upto: int | None = None) -> DataFrame:
    """Rows of a table with the ``revision`` that brought them, of all revisions or those up to one. Rows of writers that were
    refused, or have not committed yet, do not show."""
    log = read_log(spark, path).filter(F.array_contains("tables", name)).select("data", "revision")
    if upto is not None:
        log = log.filter(F.col("revision") <= upto)
    rows = spark.read.option("basePath", f"{path}/data/{name}").parquet(f"{path}/data/{name}")
    return rows.withColumn("data", F.col("data").cast("string")).join(log, "data").drop("data")
