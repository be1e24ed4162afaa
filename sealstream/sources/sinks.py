"""Sinks: rejection audit, sealed tables, fact export, verified export, export index."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.functions import columns as C
from sealstream.operators.bundles import result_json
from sealstream.operators.evidence import upsert_index
from sealstream.operators.ledger import day_file_parts
from sealstream.operators.plan import staged
from sealstream.sources.files import write_artifact_files


def write_rejections(rejected: DataFrame, path: str, batch_id: int | str | None = None) -> None:
    """Audit lines under ``rejections/day=<day>``, apart from any fact folder: appended, or under a ``batch_id=`` of their own,
    which a repeated batch replaces."""
    cols = ["device_id", "fc", "reason", "observed_at_utc", "frame_sha256", "source"]
    own = "" if batch_id is None else f"/batch_id={batch_id}"
    rejected.select(*cols, "day").write.mode("append" if batch_id is None else "overwrite").partitionBy("day").json(
        f"{path}/rejections{own}")


def write_sealed(segments: DataFrame, records: DataFrame, outcomes: DataFrame, path: str,
                 batch_id: int | str) -> None:
    """Three tables of one transition under ``batch_id=`` and an attempt of its own; the marker in ``commits`` names the
    attempt, is written last, and readers join it, so a transition shows whole or not at all. A repeated
    batch writes beside what is there and then moves the marker."""
    spark, attempt = segments.sparkSession, uuid.uuid4().hex
    for name, df in (("segments", segments), ("records", records), ("outcomes", outcomes)):
        df.write.parquet(f"{path}/{name}/batch_id={batch_id}/attempt=a{attempt}")
    spark.range(1).select(F.lit(f"a{attempt}").alias("attempt")).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/commits/batch_id={batch_id}")


def read_sealed(spark, path: str, name: str) -> DataFrame:
    """A sealed table without transitions that were not committed."""
    done = spark.read.parquet(f"{path}/commits").select("batch_id", "attempt").distinct()
    return spark.read.parquet(f"{path}/{name}").join(done, ["batch_id", "attempt"], "left_semi").drop("attempt")


def flat_facts(facts: DataFrame) -> DataFrame:
    """Nested facts (payload.Env) to wide typed columns with day and site_id."""
    env = F.col("payload.Env")
    return facts.select(
        "pod_id", "fc", "ingest_time", "pod_time", "kind", "day", "site_id",
        *[env[n].alias(n) for n in ("sample_type", "phenomenon_time_start", "phenomenon_time_end", "value", "min",
                                    "max", "mean", "count", "quality", "sensor_channel")])


def export_facts_parquet(facts: DataFrame, path: str, by_site: bool = True, files_per_day: int = 8,
                         codec: str = "zstd") -> None:
    """Wide facts partitioned by day (and site), rewritten per touched partition.

    Rows of one day go to ``files_per_day`` writers by pod hash, so a day of one large site is
    not one task; raise it until files are 128 to 512 MB.
    """
    keys = ["day", "site_id"] if by_site else ["day"]
    lane = F.pmod(F.xxhash64("pod_id", "fc"), F.lit(files_per_day))
    (flat_facts(facts).repartition(*keys, lane).sortWithinPartitions(*keys, "pod_id", "fc")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec)
     .partitionBy(*keys).parquet(path))


def _rewritten(include_frames: bool):
    """Manifest and sidecar of a bundle as they go into an export: paths inside the bundle, the fresh result in place of the old."""
    def text(value) -> str:
        return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"

    @F.pandas_udf("manifest string, meta string")
    def rewrite(day: pd.Series, manifest: pd.Series, meta: pd.Series, result: pd.Series) -> pd.DataFrame:
        out = []
        for d, m, s, r in zip(day, manifest, meta, result):
            m, s, r = json.loads(m), json.loads(s), json.loads(r)
            s.pop("milestone", None)
            side = text(s | {"artifact": f"day/{d}.cbor", "ots_proof": f"day/{d}.cbor.ots"})
            if not include_frames:
                m.pop("frames_file", None)
            m["artifacts"]["day_ots_meta"] = {"path": f"day/{d}.ots.meta.json", "sha256": hashlib.sha256(side.encode()).hexdigest()}
            m["verifier"] = r
            m["verification_bundle"] = {k: r["verification"][k] for k in ("disclosure_class", "commitment_profile_id")} | {
                k: r[k] for k in ("checks_executed", "checks_skipped")}
            out.append((text(m), side))
        return pd.DataFrame(out, columns=["manifest", "meta"])

    return rewrite


def export_rows(verdicts: DataFrame, files: DataFrame, facts: DataFrame, sidecars: DataFrame, mode: str = "warn",
                include_frames: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, index entries) of the bundles whose fresh verdict allows export.

    ``verdicts``: rows of ``verify_day_bundles``. ``files``: bundle, path, content; ``facts``: likewise, the fact artifacts; ``sidecars``:
    bundle, meta_json. Files (path, bytes) lie below ``site/<site>/day/<day>``: facts under ``facts/``, the artifacts that
    the manifest lists, the frames if asked for, and the rewritten manifest and sidecar.
    """
    m = F.col("manifest")
    good = verdicts.filter("export_refusal IS NULL")
    root = F.concat(F.lit("site/"), m["site"], F.lit("/day/"), m["date"])
    kept = staged(good.join(sidecars.select("bundle", "meta_json"), "bundle").select(
        "bundle", root.alias("root"), m["site"].alias("site"), m["date"].alias("day"), C.clean_path(m["facts_dir"]).alias("facts_dir"),
        C.clean_path(m["frames_file"]).alias("frames"), F.map_filter(m["artifacts"], lambda k, _: k != "day_ots_meta").alias("artifacts"),
        _rewritten(include_frames)(m["date"], "manifest_json", "meta_json", result_json(mode)).alias("new")))
    at = files.select("bundle", C.clean_path("path").alias("path"), "content")
    listed = kept.select("bundle", "root", F.explode(F.map_values("artifacts")).alias("r")).select(
        "bundle", "root", C.clean_path(F.col("r.path")).alias("path")).distinct().join(at, ["bundle", "path"]).select(
        F.concat("root", F.lit("/"), "path").alias("path"), F.col("content").alias("bytes"))
    own = facts.select("bundle", C.clean_path("path").alias("path"), "content").join(
        kept.select("bundle", "root", F.concat("facts_dir", F.lit("/")).alias("dir")), "bundle")
    own = own.filter(F.startswith("path", "dir")).select(
        F.concat("root", F.lit("/facts/"), F.expr("substring(path, length(dir) + 1)")).alias("path"), F.col("content").alias("bytes"))
    new = kept.select(F.explode(F.map_from_arrays(
        F.array(F.concat("root", F.lit("/day/"), "day", F.lit(".verify.json")), F.concat("root", F.lit("/day/"), "day", F.lit(".ots.meta.json"))),
        F.array(C.text_bytes("new.manifest"), C.text_bytes("new.meta")))).alias("path", "bytes"))
    rows = listed.unionByName(own).unionByName(new)
    if include_frames:
        rows = rows.unionByName(kept.join(at, (kept["bundle"] == at["bundle"]) & (kept["frames"] == at["path"])).select(
            F.concat("root", F.lit("/frames.ndjson")).alias("path"), F.col("content").alias("bytes")))
    index = kept.select("site", "day", F.col("root").alias("bundle_root"),
                        F.concat("root", F.lit("/day/"), "day", F.lit(".verify.json")).alias("manifest"),
                        F.lit(include_frames).alias("frames_included"))
    return rows, index


def index_parts(index: DataFrame) -> DataFrame:
    """``index.json`` as ordered parts (path, part, bytes): the entries by site and day."""
    key = F.concat("site", F.lit(":"), "day")
    first = index.agg(F.min(key)).first()[0]
    entry = F.concat(F.when(key == first, "").otherwise(","), F.to_json(F.struct(
        "bundle_root", "day", F.col("frames_included"), "manifest", "site")))
    ends = index.sparkSession.createDataFrame([("0", '{"exports":['), ("2", '],"version":1}\n')], "part string, text string")
    rows = ends.unionByName(index.select(F.concat(F.lit("1"), key).alias("part"), entry.alias("text")))
    return rows.select(F.lit("index.json").alias("path"), "part", C.text_bytes("text").alias("bytes"))


def export_bundles(verdicts: DataFrame, files: DataFrame, facts: DataFrame, sidecars: DataFrame, root: str,
                   previous: DataFrame | None = None, mode: str = "warn", include_frames: bool = False) -> DataFrame:
    """Write the export of all good bundles as one new folder, with its index; returns the index entries.

    ``previous`` are index entries of earlier exports: those of other sites and days stay in the new index. All files show at
    once, when the export is complete (see ``write_artifact_files``).
    """
    rows, index = export_rows(verdicts, files, facts, sidecars, mode, include_frames)
    index = staged(index if previous is None else upsert_index(previous, index))
    rows = rows.withColumn("part", F.lit("")).unionByName(index_parts(index))
    write_artifact_files(rows, root, "part")
    return index


def write_day_artifacts(leaves: DataFrame, root: str) -> None:
    """Block header, day record as CBOR and JSON, and digest line of every day of ``leaves`` (site_id, day, leaf), as one new folder."""
    write_artifact_files(day_file_parts(leaves), root, "part")


__all__ = ["export_bundles", "export_facts_parquet", "export_rows", "flat_facts", "read_sealed", "upsert_index",
           "write_day_artifacts", "write_rejections", "write_sealed"]
