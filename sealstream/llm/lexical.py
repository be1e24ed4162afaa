"""Ranked lexical search: an inverted index in shards of documents, searched by Block-Max MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealstream.llm.common import lower_ascii, whole_text
from sealstream.operators.plan import staged

#: A term is a maximal run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 128
INDEX = ("shard bigint, term binary, df int, total bigint, last array<int>, most array<int>, least array<int>, "
         "blocks array<binary>")


def _folding() -> np.ndarray:
    """What each byte of a text counts as: A-Z as a-z, any other ASCII byte outside terms as a space."""
    table = np.arange(256, dtype=np.uint8)
    for first, last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[first:last + 1] = 32
    table[65:91] += 32
    return table


FOLD = _folding()


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of a text or binary array."""
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int32)[array.offset:array.offset + len(array) + 1] if offsets else np.zeros(1, np.int32)
    return ends, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, then term, document and occurrences of each posting, by term and document, and each
    document's number of terms. Work is on the bytes: a character beyond ASCII is bytes of a term throughout."""
    ends, data = _bytes_of(texts)
    folded = FOLD[data[ends[0]:ends[-1]]]
    ends = ends - ends[0]
    inside = folded != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = ends[(ends > 0) & (ends < len(folded))]  # terms do not go on from one document to the next
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    document = np.searchsorted(ends[1:], starts, side="right")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside])])
    coded = words.dictionary_encode()
    keys, times = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, len(texts)) + document, return_counts=True)
    term, document_of = np.divmod(keys, max(1, len(texts)))
    return coded.dictionary, term, document_of, times, np.bincount(document, minlength=len(texts))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as bytes of seven bits, low ones first, each but the last marked; where each begins, and the end."""
    sizes = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.uint8)
    for k in range(5):
        some = sizes > k
        out[at[:-1][some] + k] = (values[some] >> 7 * k & 127) | np.where(sizes[some] > k + 1, 128, 0)
    return out, at


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers written by ``packed``."""
    if not len(data):
        return np.empty(0, np.int64)
    begin = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin)


def _shard_rows(shard: int, ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """A row per term of the shard, with its postings in compressed blocks, and one of the empty term for the documents."""
    names, term, document, times, sizes = postings(texts)
    new = np.concatenate([[True], np.diff(term) != 0])[:len(term)]
    begin = np.flatnonzero(new)
    place = np.arange(len(term)) - begin[term] if len(term) else term
    gap = document - np.where(new, -1, np.concatenate([[0], document[:-1]])[:len(document)])
    data, at = packed(np.stack([gap, times], axis=1).ravel())
    block = np.flatnonzero(place % BLOCK == 0)
    stop = np.append(block[1:], len(term))
    per_term = np.searchsorted(block, np.append(begin, len(term)))
    entry = np.concatenate([ids.astype("<i8").view(np.uint8), sizes.astype("<i4").view(np.uint8)])

    def lists(values, extra) -> pa.Array:
        every = np.concatenate([values, extra]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.append(per_term, len(every)).astype(np.int32)), pa.array(every))

    none = np.empty(0, np.int64)
    most = np.maximum.reduceat(times, block) if len(block) else none
    least = np.minimum.reduceat(sizes[document], block) if len(block) else none
    bounds = np.concatenate([at[2 * block], [at[-1], at[-1] + 8 * len(ids), at[-1] + 12 * len(ids)]]).astype(np.int32)
    blocks = pa.Array.from_buffers(pa.binary(), len(block) + 2, [None, pa.py_buffer(bounds),
                                                                 pa.py_buffer(np.concatenate([data, entry]))])
    offsets = pa.array(np.append(per_term, len(blocks)).astype(np.int32))
    counts = np.diff(np.append(begin, len(term)))
    rows = len(begin) + 1
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, shard)), pa.concat_arrays([names, pa.array([b""], pa.binary())]),
        pa.array(np.append(counts, (sizes > 0).sum()).astype(np.int32)),
        pa.array(np.append(np.add.reduceat(times, begin) if len(begin) else none, sizes.sum()).astype(np.int64)),
        lists(document[stop - 1] if len(block) else none, none), lists(most, none), lists(least, none),
        pa.ListArray.from_arrays(offsets, blocks)],
        ["shard", "term", "df", "total", "last", "most", "least", "blocks"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """The inverted index of all terms of whole texts, in shards of about ``shard_bytes`` of text.

    A shard is inverted where its documents are read, without a shuffle. Each term of it is a row: df documents hold it,
    ``total`` times; its postings lie in blocks of 128, compressed one by one, and for each block the row has the last
    document, the most occurrences in a document and the least number of terms of one. These bound the score of
    a block under the statistics of any corpus, so shards added later leave the others as they are. The row of the empty term has the
    ids and sizes of the shard's documents.

    NULL texts count as empty. Rows with a NULL id are no documents; rows that share an id are documents each. Ids
    are cast to bigint; other columns are ignored. An empty table gives an empty index.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flushed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return _shard_rows(number, whole["id"].to_numpy(), whole["text"])

        for batch in batches:
            ends, _ = _bytes_of(batch["text"])
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + shard_bytes - size, side="right")) - 1)
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop] - ends[at])
                at = stop
                if size >= shard_bytes or at < batch.num_rows:
                    yield flushed()
                    number, held, size = number + 1, [], 0
        if held:
            yield flushed()

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), whole_text(text_col).alias("text"))
    return rows.filter("id IS NOT NULL").mapInArrow(run, INDEX)


def _impact(times, sizes, documents: int, terms: int):
    """A term's share of the score in a document that has it so many times among so many terms; grows with the first
    and falls with the second."""
    return (10 ** 9 * times) // (1000 * times + 20 * (50 + 50 * sizes * documents // terms))


class _Shard:
    """The posting lists of one shard that the items ask for."""

    def __init__(self, rows: pa.Table, documents: int, terms: int):
        blocks = rows["blocks"].combine_chunks()
        flat = blocks.flatten()
        self.ends, self.data = _bytes_of(flat)
        self.first = blocks.offsets.to_numpy() - blocks.offsets.to_numpy()[0]
        self.last, most, least = (rows[c].combine_chunks().flatten().to_numpy() for c in ("last", "most", "least"))
        own = next(k for k, t in enumerate(rows["term"].to_pylist()) if t == b"")
        ids, sizes = flat[self.first[own]].as_py(), flat[self.first[own] + 1].as_py()
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i4").astype(np.int64)
        self.totals = documents, terms
        inner = np.concatenate([[0], np.cumsum(np.diff(rows["last"].combine_chunks().offsets.to_numpy()))])
        self.inner = inner  # the documents' row has blocks, but no bounds
        self.bounds = _impact(most.astype(np.int64), least.astype(np.int64), documents, terms)
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.score = np.zeros(len(self.ids), np.int64)

    def peak(self, k: int) -> int:
        return int(self.bounds[self.inner[k]:self.inner[k + 1]].max())

    def _decoded(self, k: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[k]
        values = unpacked(self.data[self.ends[at + a]:self.ends[at + b]])
        before = self.last[self.inner[k] + a - 1] if a else -1
        found = before + np.cumsum(values[::2])
        return found, _impact(values[1::2], self.sizes[found], *self.totals)

    def postings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a whole list."""
        if k not in self.whole:
            self.whole[k] = self._decoded(k, 0, int(self.inner[k + 1] - self.inner[k]))
        return self.whole[k]

    def some_postings(self, k: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks of a list."""
        if k in self.whole:
            return self.whole[k]
        parts = [self._decoded(k, int(b), int(b) + 1) for b in blocks]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def best(self, lists: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best documents for (list, weight) pairs, among those of at least ``least``.

        Lists go by falling bound. As long as those left could lift a document not seen yet to the threshold, they are essential:
        their documents are all candidates. Of the lists after that a block is decompressed only if a candidate in it can
        still reach the threshold by the block's maximum and the bounds of the lists to come.
        """
        lists = sorted(((w * self.peak(j), j, w) for j, w in lists), reverse=True)
        rest = np.append(np.cumsum([b for b, _, _ in lists][::-1])[::-1], 0)
        score, given, at = self.score, least > 1, 0
        score[:] = 0
        while at < len(lists) and rest[at] >= least:
            found, impact = self.postings(lists[at][1])
            score[found] += lists[at][2] * impact
            at += 1
            if not given and at < len(lists) and len(score) >= k:
                least = max(least, int(np.partition(score, -k)[-k]))
        some = np.flatnonzero((score > 0) & (score + rest[at] >= least))
        for place in range(at, len(lists)):
            _, j, w = lists[place]
            a, b = self.inner[j], self.inner[j + 1]
            block = np.searchsorted(self.last[a:b], some)
            bound = w * np.append(self.bounds[a:b], 0)[block]
            able = score[some] + bound + rest[place + 1] >= least
            some, block = some[able], block[able]
            asked = np.unique(block[block < b - a])
            if len(asked):
                found, impact = self.some_postings(j, asked)
                where = np.minimum(np.searchsorted(found, some), len(found) - 1)
                score[some] += np.where(found[where] == some, w * impact[where], 0)
        some = some[score[some] >= max(1, least)]
        some = some[np.lexsort((self.ids[some], -score[some]))[:k]]
        return self.ids[some], score[some]


def _search_shards(lists: DataFrame, k: int, documents: int, terms: int) -> DataFrame:
    """item_id, doc_id and score of the best documents of each shard; ``lists`` has the index's rows with lot and asked."""
    def run(rows: pa.Table) -> pa.Table:
        shard = _Shard(rows, documents, terms)
        items: dict[int, list[tuple[int, int]]] = {}
        least: dict[int, int] = {}
        for j, asked in enumerate(rows["asked"].to_pylist()):
            for entry in asked or ():
                items.setdefault(entry["item_id"], []).append((j, entry["weight"]))
                least[entry["item_id"]] = entry["least"]
        found = [(i, *shard.best(lists, k, least[i])) for i, lists in items.items()]
        return pa.table({
            "item_id": pa.array(np.repeat(np.array([i for i, _, _ in found], np.int64), [len(d) for _, d, _ in found])),
            "doc_id": pa.array(np.concatenate([np.empty(0, np.int64), *[d for _, d, _ in found]])),
            "score": pa.array(np.concatenate([np.empty(0, np.int64), *[s for _, _, s in found]]))})

    return lists.groupBy("shard", "lot").applyInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text",
           lot_terms: int = 50_000, first: int = 16) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` documents of the highest score above 0 for each item, equal scores by
    doc_id. ``index`` is read several times and should be a written table.

    A document's score sums, over an item's terms, the term's weight floor(1000 ln((2 N + 2) / (2 df + 1))) times its impact
    10^9 tf div (1000 tf + 20 m), where m is 50 + 50 n N div L; all in 64-bit integers.

    Only the lists of terms that items name are read. A task searches one shard for a lot of items (of about ``lot_terms``
    terms in all) and returns at most ``k`` documents of each; these heaps are merged per item. One shard of ``first`` is searched
    before the others: the k-th score found there is a sure lower bound, with which the other shards start.

    Items of a NULL id take no part; items that share an id are one, of all their terms. An item without terms, or with
    terms that no document has, has no rows. An empty table of items or documents gives no rows. Other columns are ignored.
    """
    spark = index.sparkSession
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    entries = index.filter(F.col("term") == F.lit(b""))
    documents, terms = entries.agg(F.sum("df"), F.sum("total")).first()
    if not terms:
        return spark.createDataFrame([], schema)
    words = F.regexp_extract_all(lower_ascii(whole_text(text_col)), F.lit(TERM), F.lit(0))
    asked = items.select(F.col(f"`{id_col}`").cast("bigint").alias("item_id"), F.explode(words).alias("term"))
    asked = asked.select("item_id", F.col("term").cast("binary").alias("term"))
    asked = staged(asked.filter("item_id IS NOT NULL").distinct())
    lists = staged(index.join(asked.select("term").distinct(), "term", "left_semi"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("bigint")
    known = lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    lots = max(1, -(-asked.count() // lot_terms))
    asked = asked.join(known.filter("weight > 0"), "term").withColumn("lot", F.pmod(F.xxhash64("item_id"), F.lit(lots)))
    asked = staged(asked)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")

    def found_in(shards, least: DataFrame) -> DataFrame:
        entry = F.struct("item_id", "weight", F.coalesce("least", F.lit(1).cast("bigint")).alias("least"))
        per_term = asked.join(least, "item_id", "left").groupBy("term", "lot").agg(F.collect_list(entry).alias("asked"))
        rows = lists.filter(shards).join(per_term, "term").unionByName(
            entries.filter(shards).withColumn("lot", F.explode(F.expr(f"sequence(0L, {lots - 1}L)"))),
            allowMissingColumns=True)
        found = _search_shards(rows, k, documents, terms).withColumn("rank", F.row_number().over(order))
        return staged(found.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))

    is_first = F.pmod(F.xxhash64("shard"), F.lit(first)) == 0
    none = spark.createDataFrame([], "item_id bigint, least bigint")
    early = found_in(is_first, none)
    bound = early.filter(F.col("rank") == k).select("item_id", F.col("score").alias("least"))
    late = found_in(~is_first, bound)
    ranked = early.unionByName(late).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
