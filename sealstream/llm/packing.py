"""Packing token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.llm.common import carried, slices, whole_text
from sealstream.llm.encoding import encoder
from sealstream.operators.plan import staged


class OpenBins:
    """Best fit over at most ``limit`` open bins.

    A bitset has bit f set while some open bin has f free places, so the tightest bin
    that takes a piece is the lowest set bit from the piece's length on. When a new bin would
    exceed the limit, the fullest open bin closes, which is the lowest set bit of all.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.open, self.opened = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset of a piece."""
        fits = self.mask >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            bin_no = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, bin_no = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.free[left].append(bin_no)
            self.mask |= 1 << left
            self.open += 1
        return bin_no, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.free[free]
        bin_no = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        self.open -= 1
        return bin_no

    def left_open(self) -> list[tuple[int, int]]:
        """(bin, used places) of the bins still open."""
        return [(b, self.capacity - f) for f, bins in enumerate(self.free) for b in bins]


def _place_all(length: str, capacity: int, limit: int):
    """Packs a partition's rows, ``limit`` at a time and the longest of those first. Rows get bin and
    offset; a row marked as end follows for each bin still open, with its used places as length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, schema, part = OpenBins(capacity, limit), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            part = batch["_part"][0].as_py()
            lengths, placed = batch[length].to_numpy(), np.empty((batch.num_rows, 2), dtype=np.int64)
            for at in range(0, batch.num_rows, limit):
                for k in at + np.argsort(-lengths[at:at + limit], kind="stable"):
                    placed[k] = bins.place(int(lengths[k]))
            yield _with(batch, placed[:, 0] + (part << 40), placed[:, 1], False)
        ends = bins.left_open()
        if ends:
            rest = np.array(ends, dtype=np.int64)
            empty = {f.name: pa.nulls(len(ends), f.type) for f in schema}
            empty[length] = pa.array(rest[:, 1]).cast(schema.field(length).type)
            yield _with(pa.RecordBatch.from_pydict(empty, schema=pa.schema([pa.field(f.name, f.type) for f in schema])),
                        rest[:, 0] + (part << 40), np.zeros(len(ends), dtype=np.int64), True)
    return run


def _with(batch: pa.RecordBatch, bin_no, offset, is_end: bool) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != "_part"]
    return pa.RecordBatch.from_arrays(
        [*[batch[n] for n in names], pa.array(bin_no), pa.array(offset), pa.array([is_end] * batch.num_rows)],
        [*names, "_bin", "_offset", "_end"])


def _placed(rows: DataFrame, length: str, order: list, parts: int | None, capacity: int, limit: int) -> DataFrame:
    """Deals rows out by a hash, orders them by it, and packs each partition."""
    key = F.xxhash64(*order)
    rows = rows.withColumn("_order", key)
    rows = rows.repartition(parts, "_order") if parts else rows.repartition("_order")
    rows = rows.sortWithinPartitions("_order", *order).drop("_order")
    rows = rows.withColumn("_part", F.spark_partition_id().cast("bigint"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_part"]
    return rows.mapInArrow(_place_all(length, capacity, limit), ", ".join(
        [*fields, "_bin bigint", "_offset bigint", "_end boolean"]))


def pack(pieces: DataFrame, length: str = "length", capacity: int = 1024, open_bins: int = 2048,
         merge: int = 16) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece lies, gapless from 0.

    Pieces are dealt out by a hash of their columns, and each task runs online best fit over at most
    ``open_bins`` open bins, taking as many arrivals at a time, longest first. Bins still open at a task's end are packed once more, as items of
    their fill, in one task for every ``merge`` tasks before; a task holds only its
    open bins in memory. Only narrow rows move. Rows are ordered inside a task by the hash and
    all their columns, so a task that runs again gives the same places.

    Every length must be from 0 to ``capacity``; a piece of length 0 takes a place without using any.
    Rows that repeat are packed each. An empty table gives no rows. All columns pass through, except
    columns named sequence_id or offset, which are replaced.
    """
    spark = pieces.sparkSession
    rows, names = carried(pieces, ("sequence_id", "offset"))
    size = names[length]
    first = staged(_placed(rows, size, list(names.values()), None, capacity, open_bins))
    ends = first.filter("_end").select(F.col("_bin").alias("_old"), F.col(size).cast("bigint").alias("_used"))
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // merge)
    second = staged(_placed(ends, "_used", ["_old", "_used"], groups, capacity, open_bins))
    moved = second.filter(~F.col("_end")).select("_old", F.col("_bin").alias("_new"), F.col("_offset").alias("_base"))
    out = first.filter(~F.col("_end")).join(moved, F.col("_bin") == F.col("_old"), "left")
    return out.select(
        *[F.col(v).alias(c) for c, v in names.items()],
        F.when(F.col("_new").isNull(), F.col("_bin") * 2).otherwise(F.col("_new") * 2 + 1).alias("sequence_id"),
        (F.col("_offset") + F.coalesce("_base", F.lit(0))).alias("offset"))


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024,
                    id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Token pieces of whole documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its text's ids and ``end_id``. A longer one than ``capacity`` is cut into pieces of
    exactly that length after a first piece of what is over. NULL text counts as empty: one
    piece with the end id alone. Repeated ids and rows are pieces of their own; a NULL id stays NULL.
    Other columns are ignored. ``tokenizer`` is a path that every executor has.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            where, parts = [], []
            for k, ids in enumerate(model.encode(batch["_text"].to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    where.append(k)
                    parts.append(ids[a:b])
                    for column, value in zip(rows, (piece, a, b - a, zlib.crc32(ids[a:b]))):
                        column.append(value)
            out = [batch["_id"].take(pa.array(where)), pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()),
                   pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                ends = np.cumsum([0, *rows[2]], dtype=np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(f"`{id_col}`").alias("_id"), whole_text(text_col).alias("_text")).mapInArrow(
        run, schema + (", ids array<int>" if keep_ids else ""))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed token sequences: sequence_id and its ids in order, from placed pieces with ids.
    A sequence has a bounded number of ids, so its pieces fit one row."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"))
