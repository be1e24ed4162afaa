"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.llm.common import lookup, lower_ascii, slices, spread_join, whole_text
from sealstream.llm.components import connected
from sealstream.operators.plan import staged

WHITE = "\t\n\x0b\x0c\r "


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x735A2D97)
    x ^= x >> np.uint32(15)
    return x


def _mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of ``size`` words, as sorted 64-bit hashes of their words' hashes in order; of
    fewer words, the whole sequence as one."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    found = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        found = _mix64(found * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - size + 1 + k])
    return np.unique(found)


def signature(found: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash. A first permutation scatters the shingles over a circle of 2^32 places; the second
    one, shifted along the circle by one step for each coordinate, ranks the places; the smallest rank counts."""
    places = _mix32((found >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    shifts = np.arange(1, length + 1, dtype=np.uint32)
    out = np.full(length, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(places), 256):
        ranks = _mix32(places[at:at + 256, None] + shifts)
        np.minimum(out, ranks.min(axis=0), out=out)
    return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of a signature, different for equal values in different bands."""
    parts = values.reshape(bands, -1).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(parts.shape[1]):
        keys = _mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return keys


def _word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.btrim(lower_ascii(whole_text(text_col)), F.lit(WHITE))
    words = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "[\\x20\\x09-\\x0D]+"))
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                       F.transform(words, lambda w: F.xxhash64(w)).alias("_words"))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    lists = batch["_words"]
    flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64), lists.offsets.to_numpy()
    for a, b in zip(ends, ends[1:]):
        yield shingles(flat[a:b], size)


def signed(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the digest of the shingle set, and the band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            number, digest, keys = [], [], []
            for found in _sets(batch, size):
                number.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(band_keys(signature(found, bands * rows), bands).view(np.int64) if len(found) else np.empty(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, keys)], dtype=np.int32))
            flat = np.concatenate([np.empty(0, np.int64), *keys])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(number, pa.int64()), pa.array(digest, pa.binary()),
                 pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "n_shingles", "digest", "keys"])

    return _word_hashes(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """node and its whole shingle set, for the given nodes only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(_sets(batch, size))
            ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
            flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(ends, pa.array(flat))],
                                             ["node", "shingles"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), whole_text(text_col).alias("_text"))
    rows = rows.join(nodes.select(F.col("node").alias("_id")), "_id", "left_semi")
    return _word_hashes(rows, "_id", "_text").mapInArrow(run, "node bigint, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough. ``b`` may be a hot key."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a")
    both = spread_join(left, pairs, sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b", "a")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.filter(100 * common >= percent * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")


def _alike_sizes(n: str, m: str, percent: int):
    """Sets of very different sizes cannot be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Those rows whose key holds nodes of several components, with the component that has most of them."""
    parts = rows.groupBy(key, "label").agg(F.count("*").alias("members"))
    mixed = parts.groupBy(key).agg(F.max_by("label", F.struct("members", "label")).alias("major"),
                                   F.sum("members").alias("weight"), F.count("*").alias("labels"))
    mixed = staged(mixed.filter("labels > 1").select(key, "major", "weight"))
    return lookup(rows, mixed, [key], "weight", ["node"]).filter("major IS NOT NULL")


def _rare_first(sets: DataFrame, percent: int, slots: int = 1 << 17) -> DataFrame:
    """node, n, label, and the first shingles of each set in an order common to all sets, with their positions.

    Rare shingles come first: the order is by a count in a table of ``slots`` hashed counters, then by the shingle, so
    it depends on the shingle alone. Two sets similar enough share a shingle among the first n - ceil(t n) + 1 of the
    larger and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller one (marked as short).
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(slots, np.int64)
        for batch in batches:
            sums += np.bincount(batch["shingles"].flatten().to_numpy() & (slots - 1), minlength=slots)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["slot", "number"])

    sums = sets.select("shingles").mapInArrow(count, "slot bigint, number bigint").groupBy("slot").agg(
        F.sum("number").alias("number")).toArrow()
    counts = np.zeros(slots, np.int64)
    counts[sums["slot"].to_numpy()] = sums["number"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch["shingles"], []
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, b in zip(ends, ends[1:]):
                found, n = flat[a:b], int(b - a)
                first = found[np.lexsort((found, shared.value[found & (slots - 1)]))][:n + percent * n // -100 + 1]
                out.append((first, n + 2 * percent * n // -(100 + percent) + 1))
            sizes = np.array([len(f) for f, _ in out], dtype=np.int64)
            row = np.repeat(np.arange(len(out)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c].take(pa.array(row)) for c in ("node", "n", "label")],
                 pa.array(np.concatenate([np.empty(0, np.int64), *[f for f, _ in out]])), pa.array(place),
                 pa.array(place < np.array([s for _, s in out], dtype=np.int64)[row])],
                ["node", "n", "label", "shingle", "place", "short"])

    return sets.mapInArrow(prefix, "node bigint, n bigint, label bigint, shingle bigint, place bigint, short boolean")


def _across(full: DataFrame, groups: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that may still be similar enough: all such pairs of a bucket are among them.

    Nodes of buckets with several components are compared by their rare shingles: a prefix of each set, and the
    positions in it, bound the intersection. For a shingle only the nodes outside its largest component are paired.
    """
    labels = full.select("key", "node", "n").join(groups, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("label"))
    nodes = _mixed(staged(labels), "key").select("node", "label").distinct()
    nodes = nodes.join(sets, "node").select("node", F.size("shingles").cast("bigint").alias("n"), "label", "shingles")
    rows = staged(_mixed(staged(_rare_first(staged(nodes), percent)), "shingle"))
    minor = rows.filter("label <> major").select("shingle", *[F.col(c).alias(f"a_{c}") for c in (
        "node", "n", "label", "place", "short")])
    other = rows.select("shingle", (F.col("label") == F.col("major")).alias("main"), *[F.col(c).alias(f"b_{c}") for c in (
        "node", "n", "label", "place", "short")])
    a_first = F.struct("a_n", "a_node") < F.struct("b_n", "b_node")
    most = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))  # shingles from the match on
    pairs = minor.join(other, "shingle").filter(
        (F.col("a_label") != F.col("b_label")) & (F.col("main") | (F.col("a_node") > F.col("b_node")))
        & _alike_sizes("a_n", "b_n", percent) & F.when(a_first, F.col("a_short")).otherwise(F.col("b_short"))
        & ((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))))
    pairs = pairs.select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b")).distinct()
    return staged(pairs.join(known, ["a", "b"], "left_anti"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` or more are linked; a
    component's id is its smallest document id, and that document is kept.

    Equal sets are one node from the start, so copies cost one narrow row each. Nodes meet in the buckets of
    ``bands`` bands of ``rows`` MinHash values (a pair at the threshold of 0.8 is missed with a probability of
    5e-7, a closer one with less). First each node is compared with the smallest node of each of
    its buckets only. Nodes of buckets that then still hold several components are compared across components,
    where the prefix and position filters on rare shingles, which are exact, do not rule a pair
    out. So no link between components is left out, and no pairs are made inside groups that
    already hang together. All links are confirmed on full sets.
    Hot buckets and hot nodes are split by ``lookup`` and ``spread_join``.

    Texts without words, NULL ones too, have no shingles and are linked with nothing. Rows with a NULL id are
    linked with nothing, have a NULL component and are kept. Rows that share an id are one document.
    An empty table gives no rows; other columns are ignored. Ids are cast to bigint.
    """
    marks = staged(signed(docs, id_col, text_col, size, bands, rows))
    linked = marks.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(linked.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"),
        F.first("keys").alias("keys")))
    slots = classes.select("node", "n", F.explode("keys").alias("key"))
    buckets = staged(slots.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("size"))
                     .filter("size > 1"))
    full = staged(lookup(slots, buckets, ["key"], "size", ["node"]).filter("size IS NOT NULL"))
    sets = staged(full_sets(docs, full.select("node").distinct(), id_col, text_col, size))

    stars = full.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), "n", F.col("hub.n").alias("m"))
    stars = staged(stars.filter((F.col("a") != F.col("b")) & _alike_sizes("n", "m", percent)).select("a", "b").distinct())
    # documents that share an id are linked, whatever their texts
    ids = linked.join(classes.select("digest", "node"), "digest").groupBy("doc_id").agg(
        F.min("node").alias("b"), F.max("node").alias("_max"), F.collect_set("node").alias("_nodes"))
    shared = ids.filter("b <> _max").select(F.explode("_nodes").alias("a"), "b")
    links = staged(verified(stars, sets, percent).unionByName(shared))
    groups = connected(links)

    more = staged(verified(_across(full, groups, sets, stars, percent), sets, percent))
    if not more.isEmpty():
        groups = connected(links.unionByName(more))

    named = staged(classes.select("digest", "node", "copies").join(groups, "node", "left").select(
        "digest", "copies", F.coalesce("component", "node").alias("component")))
    out = lookup(marks.select("doc_id", "n_shingles", "digest"), named, ["digest"], "copies", ["doc_id"])
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
