"""Blocks, day records, segments and their deterministic bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealstream.functions import codecs as K
from sealstream.functions import columns as C
from sealstream.functions import values as V
from sealstream.functions.sha256 import Sha256, finished
from sealstream.operators import merkle as M
from sealstream.operators.plan import staged


def check_policy(policies: DataFrame) -> DataFrame:
    """All limits of a closure policy must be positive; ``error`` names the first that is not."""
    def zero(name, nullable=False):
        bad = F.col(name) <= 0
        return F.coalesce(bad, F.lit(False)) if nullable else F.coalesce(bad, F.lit(True))
    return policies.withColumn("error", C.first_failure([
        ("interval_ms", zero("interval_ms")), ("batch_record_limit", zero("batch_record_limit")),
        ("record_limit", zero("record_limit", True)), ("size_limit_bytes", zero("size_limit_bytes", True))]))


def positional_cbor(custom: str | None = None) -> Column:
    """Positional fact bytes from columns pod_id (bytes), fc, ingest_time, pod_time, kind and
    the flat environmental fields, or the bytes column ``custom`` where it is set."""
    f = K.float32_cbor("value", "min", "max", "mean", "quality")

    def real(name):
        return F.when(F.col(name).isNull(), F.lit(b"\xf6")).otherwise(f[name])

    env = F.concat(C.cbor_head(4, 11), C.cbor_lit(1), C.cbor_uint("sample_type"),
                   C.cbor_int("start"), C.cbor_int("end"), real("value"), real("min"), real("max"),
                   real("mean"), C.cbor_nullable("count"), real("quality"), C.cbor_nullable("sensor_channel"))
    payload = F.concat(C.cbor_lit(0), env)
    if custom is not None:
        payload = F.when(F.col(custom).isNull(), payload).otherwise(
            F.concat(C.cbor_lit(1), C.cbor_bytes(custom)))
    return F.concat(C.cbor_head(4, 7), C.cbor_lit(1), C.cbor_bytes("pod_id"),
                    C.cbor_uint("fc"), C.cbor_int("ingest_time"), C.cbor_nullable("pod_time", C.cbor_int),
                    C.cbor_uint("kind"), C.cbor_head(4, 2), payload)


def provisioning_cbor() -> Column:
    """Positional bytes of a provisioning record (bytes columns except texts and times)."""
    return F.concat(
        C.cbor_head(4, 8), C.cbor_lit(1), C.cbor_bytes("device_id"),
        C.cbor_text("firmware_version"), C.cbor_bytes("firmware_hash"), C.cbor_bytes("identity_pubkey"),
        C.cbor_bytes("birth_cert_sig"), C.cbor_int("provisioned_at"), C.cbor_nullable("site_id", C.cbor_text))


def build_block_headers(leaves: DataFrame, version: int = 1) -> DataFrame:
    """Block per (site_id, day): count and root. Leaf lists stay a table, see ``block_leaves``."""
    roots = M.roots_of(M.sort_leaves(leaves, ["site_id", "day"]), ["site_id", "day"], version)
    return roots.select(
        F.lit(1).alias("version"), "site_id", "day",
        F.concat("site_id", F.lit("-"), "day", F.lit("-00")).alias("batch_id"),
        C.hex_lower("root").alias("merkle_root"), F.col("leaf_count").alias("count"))


def block_leaves(leaves: DataFrame) -> DataFrame:
    """Sorted leaves of each block: hex digest, first position and copies."""
    return M.sort_leaves(leaves, ["site_id", "day"]).select(
        "site_id", "day", F.col("start").alias("position"), "copies", C.hex_lower("leaf").alias("leaf"))


def link_days(blocks: DataFrame) -> DataFrame:
    """``prev_day_root`` of each day: the root of the site's previous day, zeros at the start."""
    w = Window.partitionBy("site_id").orderBy("day")
    return blocks.withColumn("prev_day_root", F.lag("merkle_root", 1, V.ZERO_SHA256).over(w))


def build_day_records(blocks: DataFrame) -> DataFrame:
    """Day records with a single batch: ``day_root`` equals the batch root."""
    return link_days(blocks).select(
        F.lit(1).alias("version"), "site_id", F.col("day").alias("date"), "prev_day_root",
        "batch_id", "count", F.col("merkle_root").alias("day_root"))


DAY = ["site_id", "day"]


def _hash_items(nodes: str) -> Column:
    return F.expr(f"unhex(array_join(transform({nodes}, b -> concat('7840', "
                  "hex(encode(lower(hex(b)), 'UTF-8')))), ''))")


def _days_of(runs: DataFrame) -> DataFrame:
    """Day records of sorted leaves, one per (site_id, day)."""
    return build_day_records(M.roots_of(runs, DAY, 1).select(
        "site_id", "day", F.concat("site_id", F.lit("-"), "day", F.lit("-00")).alias("batch_id"),
        C.hex_lower("root").alias("merkle_root"), F.col("leaf_count").alias("count")))


def _around(rows: DataFrame, keys: list[str], first: Column, last: Column) -> DataFrame:
    """Part -1 and the part after all others."""
    return rows.select(*keys, F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("part"), first.alias("bytes")),
        F.struct(F.lit(1 << 40).alias("part"), last.alias("bytes")))).alias("x")).select(*keys, "x.*")


def _day_cbor(days: DataFrame, blocks: DataFrame) -> DataFrame:
    t, u = C.cbor_text, C.cbor_uint
    first = F.concat(
        C.cbor_head(5, 6), C.cbor_lit("date"), t("date"), C.cbor_lit("batches"),
        C.cbor_head(4, 1), C.cbor_head(5, 7), C.cbor_lit("day"), t("date"),
        C.cbor_lit("count"), u("count"), C.cbor_lit("site_id"), t("site_id"), C.cbor_lit("version"),
        C.cbor_lit(1), C.cbor_lit("batch_id"), t("batch_id"), C.cbor_lit("leaf_hashes"),
        C.cbor_head(4, "count"))
    last = F.concat(
        C.cbor_lit("merkle_root"), t("day_root"), C.cbor_lit("site_id"), t("site_id"),
        C.cbor_lit("version"), C.cbor_lit(1), C.cbor_lit("day_root"), t("day_root"),
        C.cbor_lit("prev_day_root"), t("prev_day_root"))
    ends = _around(days.withColumn("day", F.col("date")), DAY, first, last)
    return ends.unionByName(blocks.select(*DAY, "part", _hash_items("nodes").alias("bytes")))


def day_parts(leaves: DataFrame) -> DataFrame:
    """Day record bytes as ordered parts (site_id, day, part, bytes).

    Map keys in order: date, batches, site_id, version, day_root, prev_day_root; batch keys:
    day, count, site_id, version, batch_id, leaf_hashes, merkle_root. The leaf list is cut
    into blocks, so a day of any size is never one row.
    """
    runs = M.sort_leaves(leaves, DAY)
    return _day_cbor(_days_of(runs), M._blocks(runs, DAY))


def day_file_parts(leaves: DataFrame) -> DataFrame:
    """The files of every day as ordered parts (path, part, bytes): ``<site>/blocks/<day>-00.block.json``, the block header with its
    leaf list, ``<site>/day/<day>.cbor`` and ``.json``, the day record, and ``.cbor.sha256``, its digest line. JSON is
    canonical: keys in order, no white space. Leaves are sorted once.
    """
    runs = staged(M.sort_leaves(leaves, DAY))
    days, blocks = staged(_days_of(runs)), M._blocks(runs, DAY)
    cbor = staged(_day_cbor(days, blocks))
    named = days.withColumn("day", F.col("date"))
    q, text = C.json_quoted, C.text_bytes
    head = F.concat(F.lit('{"batch_id":'), q("batch_id"), F.lit(',"count":'), F.col("count").cast("string"), F.lit(',"day":'), q("day"),
                    F.lit(',"leaf_hashes":['))
    tail = F.concat(F.lit('],"merkle_root":'), q("day_root"), F.lit(',"site_id":'), q("site_id"), F.lit(',"version":1}'))
    outer = F.concat(F.lit('],"date":'), q("day"), F.lit(',"day_root":'), q("day_root"), F.lit(',"prev_day_root":'), q("prev_day_root"),
                     F.lit(',"site_id":'), q("site_id"), F.lit(',"version":1}'))
    items = F.concat(F.when(F.col("part") == 0, "").otherwise(","), F.lit('"'), F.array_join(
        F.transform("nodes", C.hex_lower), '","'), F.lit('"'))
    leaf_lists = blocks.select(*DAY, "part", text(items).alias("bytes"))
    site = F.concat("site_id", F.lit("/"))

    def file(rows: DataFrame, *name) -> DataFrame:
        return rows.select(F.concat(site, *name).alias("path"), "part", "bytes")
    block = _around(named, DAY, text(head), text(tail)).unionByName(leaf_lists)
    day = _around(named, DAY, text(F.concat(F.lit('{"batches":['), head)), text(F.concat(tail, outer))).unionByName(leaf_lists)
    sums = digest_parts(cbor, DAY).select(*DAY, F.lit(0).cast("bigint").alias("part"), text(F.concat(
        "sha256", F.lit("  "), "day", F.lit(".cbor\n"))).alias("bytes"))
    return (file(block, F.lit("blocks/"), "day", F.lit("-00.block.json")).unionByName(file(day, F.lit("day/"), "day", F.lit(".json")))
            .unionByName(file(cbor, F.lit("day/"), "day", F.lit(".cbor")))
            .unionByName(file(sums, F.lit("day/"), "day", F.lit(".cbor.sha256"))))


def digest_parts(parts: DataFrame, keys: list[str], part: str = "part") -> DataFrame:
    """SHA-256 and size of artifacts given as ordered parts; reads parts as a stream."""
    import hashlib
    types = dict(parts.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", sha256 string, size bigint"

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest, size = None, None, 0
        for pdf in it:
            done = []
            for key, raw in zip(zip(*(pdf[k] for k in keys)), pdf["bytes"]):
                if key != current:
                    if current is not None:
                        done.append((*current, digest.hexdigest(), size))
                    current, digest, size = key, hashlib.sha256(), 0
                digest.update(raw)
                size += len(raw)
            yield pd.DataFrame(done, columns=[*keys, "sha256", "size"])
        if current is not None:
            yield pd.DataFrame([(*current, digest.hexdigest(), size)], columns=[*keys, "sha256", "size"])

    ordered = parts.repartition(*keys).sortWithinPartitions(*keys, part).select(*keys, "bytes")
    return ordered.mapInPandas(fold, schema)


def batch_objects(frames: DataFrame, group: list[str], limit: int, version: int = 2) -> DataFrame:
    """Batches with what they commit to: group, batch_number, count, merkle_root and the frames in the order of their leaves.

    ``frames`` has the group and frame (bytes). A batch holds at most ``limit`` frames, so it fits a row; equal frames travel as
    one row with a count. Groups are counted first: where one block holds each of them, frames are shuffled once, by group, and
    hashed, placed and cut in the same tasks.
    """
    hashed = M.leaf_hash_v2 if version == 2 else M.leaf_hash_v1
    frames = frames.select(*group, "frame")
    if M.largest_group(frames, group) <= M._SIZE:
        known = F.lit(True)
        for g in group:  # a batch of no group is none
            known = known & F.col(g).isNotNull()
        runs = frames.filter(known).repartition(*group).groupBy(*group, "frame").agg(F.count(F.lit(1)).alias("copies"))
        placed = M.located_small(runs.withColumn("leaf", hashed("frame")), group, "frame")
        batches = M.cut_runs(placed, limit).groupBy(*group, F.col("part").alias("batch_number")).agg(
            F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct("pos", "n", "leaf", "frame"))).alias("_p"))
        batches = batches.select(*group, "batch_number", "count", *[F.expr(
            f"flatten(transform({runs}, x -> array_repeat(x.{c}, cast(x.n as int))))").alias(n) for runs, c, n in (
                ("_p", "leaf", "nodes"), ("filter(_p, x -> x.frame IS NOT NULL)", "frame", "frames"))])
        return batches.filter("size(frames) > 0").select(
            *group, "batch_number", "count", C.hex_lower(M.reduce_array(version, "nodes")).alias("merkle_root"), "frames")
    leaves = staged(frames.select(*group, "frame", hashed("frame").alias("leaf")).groupBy(*group, "leaf", "frame").agg(
        F.count(F.lit(1)).alias("copies")))
    runs = M.located_runs(leaves.select(*group, "leaf", "copies"), group)
    cut = M.cut_runs(runs, limit).join(leaves.select(*group, "leaf", "frame"), [*group, "leaf"])
    held = cut.groupBy(*group, F.col("part").alias("batch_number")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "n", "frame"))).alias("_p"))
    held = held.select(*group, "batch_number", F.expr("flatten(transform(_p, x -> array_repeat(x.frame, cast(x.n as int))))").alias("frames"))
    lists = M.batch_lists(runs, group, limit, version).drop("leaf_hashes")
    return lists.join(held, [*group, "batch_number"])


SEG = ["ledger_id", "segment_number"]


def segment_parts(segments: DataFrame, batches: DataFrame) -> DataFrame:
    """Segment bytes around the predecessor digest: head, one part per batch, tail.

    ``segments``: SEG, site_id, close_reason, segment_root and the policy columns interval_ms,
    batch_record_limit, record_limit, size_limit_bytes, empty_mode. ``batches``: SEG,
    batch_number, count, leaf_hashes, merkle_root. The chain inserts the digest after ``tail``
    and the profile id after that.
    """
    t, u = C.cbor_text, C.cbor_uint
    counts = batches.groupBy(*SEG).agg(F.count(F.lit(1)).alias("_n"))
    full = segments.join(counts, SEG, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    head = F.concat(C.cbor_head(5, 10), C.cbor_lit("batches"), C.cbor_head(4, "_n"))
    policy = C.cbor_map([
        ("version", C.cbor_lit(1)), ("empty_mode", t("empty_mode")), ("interval_ms", u("interval_ms")),
        ("record_limit", C.cbor_nullable("record_limit")),
        ("size_limit_bytes", C.cbor_nullable("size_limit_bytes")),
        ("batch_record_limit", u("batch_record_limit"))])
    tail = F.concat(
        C.cbor_lit("site_id"), t("site_id"), C.cbor_lit("version"), C.cbor_lit(2), C.cbor_lit("ledger_id"),
        t("ledger_id"), C.cbor_lit("close_reason"), t("close_reason"), C.cbor_lit("segment_root"),
        t("segment_root"), C.cbor_lit("closure_policy"), policy, C.cbor_lit("segment_number"),
        u("segment_number"), C.cbor_lit("prev_segment_sha256"))
    ends = full.select(*SEG, F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("part"), head.alias("bytes"), F.lit(False).alias("last")),
        F.struct(F.lit(1 << 40).alias("part"), tail.alias("bytes"), F.lit(True).alias("last")))).alias("x"))
    sites = segments.select(*SEG, "site_id")
    body = batches.join(sites, SEG).select(
        *SEG, F.col("batch_number").cast("bigint").alias("part"), C.cbor_map([
            ("count", u("count")), ("site_id", t("site_id")), ("version", C.cbor_lit(2)),
            ("ledger_id", t("ledger_id")), ("leaf_hashes", C.cbor_text_array("leaf_hashes")),
            ("merkle_root", t("merkle_root")), ("batch_number", u("batch_number")),
            ("segment_number", u("segment_number"))]).alias("bytes"), F.lit(False).alias("last"))
    return ends.select(*SEG, "x.*").unionByName(body)


def segment_end(prev: str) -> Column:
    return F.concat(C.cbor_text(prev), C.cbor_lit("commitment_profile_id"), C.cbor_lit(V.PROFILE_V2))


def segment_states(parts: DataFrame) -> DataFrame:
    """SEG, state, rest and length: how far the hash of each segment comes before the predecessor digest is needed.

    Segments are hashed apart from each other, however many a ledger has; parts are read as a stream.
    """
    types = dict(parts.dtypes)
    schema = f"ledger_id string, segment_number {types['segment_number']}, state binary, rest binary, length bigint"

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = Sha256()
        for batch in it:
            done, rows = [], []
            for k, (raw, last) in enumerate(zip(batch["bytes"], batch["last"].to_pylist())):
                running.update(raw.as_py())
                if last:
                    done.append(running.saved())
                    rows.append(k)
                    running = Sha256()
            ids = [batch[c].take(pa.array(rows, pa.int64())) for c in SEG]
            saved = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*ids, *saved], [*SEG, "state", "rest", "length"])

    ordered = parts.repartition(*SEG).sortWithinPartitions(*SEG, "part").select(*SEG, "bytes", "last")
    return ordered.mapInArrow(fold, schema)


def chain_states(states: DataFrame) -> DataFrame:
    """Chain digests per ledger from ``segment_states``: SEG, prev_segment_sha256, artifact_sha256, artifact_size.

    Each digest enters the next artifact, so a ledger is read in order; but the read is of some 150 bytes a segment, of any size.
    """
    types = dict(states.dtypes)
    schema = (f"ledger_id string, segment_number {types['segment_number']}, "
              "prev_segment_sha256 string, artifact_sha256 string, artifact_size bigint")
    profile = K.to_cbor("commitment_profile_id") + K.to_cbor(V.PROFILE_V2)

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, prev = None, V.ZERO_SHA256
        for batch in it:
            before, own, sizes = [], [], []
            for lid, state, rest, length in zip(*(batch[c].to_pylist() for c in ("ledger_id", "state", "rest", "length"))):
                if lid != ledger:
                    ledger, prev = lid, V.ZERO_SHA256
                end = K.to_cbor(prev) + profile
                before.append(prev)
                prev = finished(state, rest, length, end).hex()
                own.append(prev)
                sizes.append(length + len(end))
            yield pa.RecordBatch.from_arrays(
                [batch["ledger_id"], batch["segment_number"], pa.array(before, pa.string()), pa.array(own, pa.string()),
                 pa.array(sizes, pa.int64())],
                ["ledger_id", "segment_number", "prev_segment_sha256", "artifact_sha256", "artifact_size"])

    return states.repartition("ledger_id").sortWithinPartitions(*SEG).mapInArrow(fold, schema)


def chain_segments(parts: DataFrame) -> DataFrame:
    """Chain digests per ledger: SEG, prev_segment_sha256, artifact_sha256, artifact_size. All of a segment but its end is
    hashed in parallel; only the ends are hashed in order."""
    return chain_states(segment_states(parts))


def segment_artifacts(parts: DataFrame, chain: DataFrame) -> DataFrame:
    """Whole artifact bytes per segment, for segments whose policy bounds their size."""
    body = parts.groupBy(*SEG).agg(F.array_sort(F.collect_list(F.struct("part", "bytes"))).alias("_p"))
    return body.join(chain, SEG).select(
        *SEG, "prev_segment_sha256", "artifact_sha256",
        F.concat(C.concat_binary(F.transform("_p", lambda x: x["bytes"])),
                 segment_end("prev_segment_sha256")).alias("artifact_cbor"))


def seal(records: DataFrame, segments: DataFrame, batch_limit: int,
         stage: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments with root, batches) of records (SEG, record). Empty segments keep the empty root.

    One plan that uses both results sorts the leaves once; with ``stage`` the sorted leaves are
    written first, for results that are written by separate jobs.
    """
    leaves = records.select(*SEG, M.leaf_hash_v2("record").alias("leaf"))
    runs = M.sort_leaves(leaves, SEG, stage=stage)
    batches = M.batch_lists(runs, SEG, batch_limit)
    roots = M.roots_of(runs, SEG, 2).select(*SEG, C.hex_lower("root").alias("_r"))
    rooted = segments.join(roots, SEG, "left").withColumn(
        "segment_root", F.coalesce("_r", F.lit(V.EMPTY_SHA256))).drop("_r")
    return rooted, batches
