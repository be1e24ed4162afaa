"""Repeated byte strings across a corpus: prefix-free parsing, orders of phrases and of what follows them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.llm.common import lookup, whole_text
from sealstream.operators.plan import staged

GRAM = 8
RESULT = "id binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
CONTEXT = "key bigint, at int, low int, high int, fixed boolean, left binary, right binary"


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of a text column; a longer text is a batch of its own."""
    held, have = [], 0
    for batch in batches:
        ends = texts_of(batch[column])[0]
        at = 0
        while at < batch.num_rows:
            stop = max(at + (not held), int(np.searchsorted(ends, ends[at] + size - have, side="right")) - 1)
            if stop > at:
                held.append(batch.slice(at, stop - at))
                have += int(ends[stop] - ends[at])
            if stop < batch.num_rows or have >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, have = [], 0
            at = stop
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def texts_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column."""
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int32)[array.offset:array.offset + len(array) + 1] if offsets else np.zeros(1, np.int32)
    return ends.astype(np.int64), np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Parse:
    """The prefix-free parse of a batch of texts for strings of ``length`` bytes.

    A rolling hash is taken at each byte. Where it is the least among the hashes inside some string of ``length`` bytes (the last
    one of equals) is a trigger, and phrases go from trigger to trigger. So a string has exactly one trigger that counts for it, at a place that
    depends on its own bytes alone, and no phrase is longer than a string.

    A trigger counts for a run of strings, ``low`` to ``high`` bytes before it. Strings that begin less than half their length
    before it share what follows the trigger, the others what precedes it; a run is cut there into two parts, and ``key``
    is a hash of the shared bytes: no string of a part is repeated unless its key is.
    """

    def __init__(self, ends: np.ndarray, data: np.ndarray, length: int):
        self.length, self.shared = length, length // 2 + 4
        self.ends, self.data = ends - ends[0], data[ends[0]:ends[-1]]
        span, n = length - GRAM + 1, int(self.ends[-1])
        long = np.diff(self.ends) >= length
        none = np.empty(0, np.int64)
        self.document = self.at = self.low = self.high = self.side = self.number = none
        self.key = none
        if not long.any():
            return
        padded = np.concatenate([self.data, np.zeros(GRAM, np.uint8)])
        hashes = _mix(np.ndarray((n - GRAM + 1,), np.uint64, padded, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15))
        hashes &= np.uint64(~0x7FFFFFFF & (1 << 64) - 1)
        hashes |= np.uint64(0x7FFFFFFF) - np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            hashes = np.minimum(hashes[:-width], hashes[width:])
            width *= 2
        count = n - length + 1
        place = np.minimum(hashes[:count], hashes[span - width:span - width + count]) & np.uint64(0x7FFFFFFF)
        place = 0x7FFFFFFF - place.astype(np.int64)
        inner = np.zeros(n + 1, np.int8)  # strings do not go on from one text to the next
        inner[self.ends[:-1][long]] += 1
        inner[self.ends[1:][long] - length + 1] -= 1
        inner = np.cumsum(inner, dtype=np.int8)[:count] > 0
        turn = np.ones(count + 1, bool)
        turn[1:-1] = (place[1:] != place[:-1]) | (inner[1:] != inner[:-1])
        first = np.flatnonzero(turn[:-1] & inner)
        last = np.flatnonzero(turn[1:] & inner)
        at = place[first]
        low, high = at - last, at - first
        half = length // 2 - 4
        near, far = np.flatnonzero(low <= half), np.flatnonzero(high > half)
        own = np.concatenate([near, far])
        side = np.repeat([0, 1], [len(near), len(far)])
        order = np.lexsort((side, at[own], first[own]))
        own, self.side = own[order], side[order]
        self.at = at[own]
        self.low = np.where(self.side, np.maximum(low[own], half + 1), low[own])
        self.high = np.where(self.side, high[own], np.minimum(high[own], half))
        self.document = np.searchsorted(self.ends[1:], first[own], side="right")
        self.number = 2 * (self.at - self.ends[self.document]) + self.side
        begin = self.at - np.where(self.side, half + 1, 0)
        key = _mix(np.uint64(1) + self.side.astype(np.uint64))
        for k in range(0, self.shared, 8):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.ndarray(
                (max(0, n - GRAM + 1),), np.uint64, padded, 0, (1,))[begin + min(k, self.shared - 8)])
        self.key = key.view(np.int64)

    def context(self, k: int) -> bytes:
        """All bytes of the strings of a part, and how they lie."""
        a, b = self.at[k] - self.high[k], self.at[k] + self.length - self.low[k]
        return self.data[a:b].tobytes() + b"%d %d" % (self.low[k], self.high[k])

    def covered(self, parts: np.ndarray) -> np.ndarray:
        """For each byte of the batch, whether a string of one of the parts has it."""
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, self.at[parts] - self.high[parts], 1)
        np.add.at(change, self.at[parts] + self.length - self.low[parts], -1)
        return np.cumsum(change[:-1]) > 0


def _digest(text) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _identity(text_col: str):
    """The name of a text: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(whole_text(text_col), 256)), 1, 16)


def _shared_keys(docs: DataFrame, text_col: str, length: int, batch_bytes: int) -> DataFrame:
    """key and weight: the keys that occur more than once, and how many rows the next pass has of each at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", batch_bytes):
            keys, times = np.unique(Parse(*texts_of(batch["text"]), length).key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(times, pa.int64())], ["key", "n"])

    keys = docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "key bigint, n bigint")
    return staged(keys.groupBy("key").agg(F.sum("n").alias("weight")).filter("weight > 1"))


def _parts(docs: DataFrame, text_col: str, length: int, batch_bytes: int) -> DataFrame:
    """id, number, key, context and n for each part of each text; copies of a text in a batch are one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", batch_bytes):
            ends, data = texts_of(batch["text"])
            names = [_digest(data[a:b]) for a, b in zip(ends, ends[1:])]
            first, copies = {}, {}
            for k, name in enumerate(names):
                first.setdefault(name, k)
                copies[name] = copies.get(name, 0) + 1
            parse = Parse(ends, data, length)
            mine = np.array([first[name] == k for k, name in enumerate(names)], bool)
            some = np.flatnonzero(mine[parse.document])
            contexts = [int.from_bytes(hashlib.blake2b(parse.context(k), digest_size=8).digest(), "little", signed=True)
                        for k in some]
            own = parse.document[some]
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.binary()).take(pa.array(own)), pa.array(parse.number[some]), pa.array(parse.key[some]),
                pa.array(contexts, pa.int64()), pa.array(np.array([copies[n] for n in names], np.int64)[own])],
                ["id", "number", "key", "context", "n"])

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(
        run, "id binary, number bigint, key bigint, context bigint, n bigint")


def _measured(data: np.ndarray, ends: np.ndarray, gone: np.ndarray, chosen: np.ndarray) -> list[pa.Array]:
    """n_bytes, n_removed, n_spans and kept_sha256 of the chosen texts."""
    sums = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = ends[(ends > 0) & (ends < len(gone))]
    begins[inner] = gone[inner]
    spans = np.concatenate([[0], np.cumsum(begins)])
    a, b = ends[chosen], ends[chosen + 1]
    kept = [hashlib.sha256(data[x:y] if not (sums[y] - sums[x]) else data[x:y][~gone[x:y]].tobytes()).hexdigest()
            for x, y in zip(a, b)]
    return [pa.array(b - a, pa.int64()), pa.array(sums[b] - sums[a], pa.int64()), pa.array(spans[b] - spans[a], pa.int64()),
            pa.array(kept, pa.string())]


def _decided(texts: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """Results of texts whose parts are decided; the others with the bytes of the parts that need comparing.

    ``texts`` has id, text, copies and marks (number, key, whole, shown). Rows of kind 0 are results, of kind 1 texts
    to be finished with the string starts removed so far, of kind 2 contexts.
    """
    empty = pa.Table.from_batches([], pa.schema([
        ("kind", pa.int32()), ("id", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), ("text", pa.string()), ("lows", pa.list_(pa.int32())), ("highs", pa.list_(pa.int32())),
        ("key", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("fixed", pa.bool_()),
        ("left", pa.binary()), ("right", pa.binary())])).schema

    def rows(number: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(number, f.type)
                                           for f in empty], schema=empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", batch_bytes):
            ends, data = texts_of(batch["text"])
            parse = Parse(ends, data, length)
            ends, data = parse.ends, parse.data
            copies, marks = batch["copies"].to_numpy(), batch["marks"]
            counts = np.diff(marks.offsets.to_numpy()) if len(marks) else np.empty(0, np.int64)
            flat = marks.flatten()
            number, key, whole, shown = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("number", "key", "whole", "shown"))
            owner = np.repeat(np.arange(len(counts)), counts)
            # the parse is sorted by text and number
            spots = np.searchsorted(parse.document * (1 << 33) + parse.number, owner * (1 << 33) + number)
            whole, shown = whole.astype(bool), shown.astype(bool)
            full = np.zeros(len(parse.at), bool)
            full[spots[whole]] = True
            full |= (copies > 1)[parse.document]
            gone = parse.covered(np.flatnonzero(full))
            open_ = np.zeros(len(copies), bool)
            open_[owner[~whole]] = True
            open_ &= copies == 1
            done = np.flatnonzero(~open_)
            measures = _measured(data, ends, gone, done)
            yield rows(len(done), kind=pa.array(np.zeros(len(done), np.int32)), id=batch["id"].take(pa.array(done)),
                       **dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), measures)))
            left = np.flatnonzero(open_)
            if len(left):
                known = np.flatnonzero(full & open_[parse.document])
                home = ends[parse.document[known]]
                offsets = pa.array(np.append(np.searchsorted(parse.document[known], left), len(known)).astype(np.int32))
                lows = pa.array((parse.at - parse.high)[known] - home, pa.int32())
                highs = pa.array((parse.at - parse.low)[known] - home, pa.int32())
                yield rows(len(left), kind=pa.array(np.ones(len(left), np.int32)), id=batch["id"].take(pa.array(left)),
                           text=batch["text"].take(pa.array(left)), lows=pa.ListArray.from_arrays(offsets, lows),
                           highs=pa.ListArray.from_arrays(offsets, highs))
            for at in range(0, int(shown.sum()), 4096):
                some = np.flatnonzero(shown)[at:at + 4096]
                part = spots[some]
                at_, low, high = parse.at[part], parse.low[part], parse.high[part]
                yield rows(len(some), kind=pa.array(np.full(len(some), 2, np.int32)), id=batch["id"].take(pa.array(owner[some])),
                           key=pa.array(key[some]), at=pa.array(at_ - ends[parse.document[part]]), low=pa.array(low),
                           high=pa.array(high), fixed=pa.array(whole[some] | (copies[owner[some]] > 1)),
                           left=pa.array([data[x - h:x].tobytes() for x, h in zip(at_, high)], pa.binary()),
                           right=pa.array([data[x:x + length - w].tobytes() for x, w in zip(at_, low)], pa.binary()))

    schema = ("kind int, " + RESULT + ", text string, lows array<int>, highs array<int>, " + CONTEXT)
    return texts.mapInArrow(run, schema)


def _sorted_runs(keys: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A suffix order: the strings' order inside each key, and how many bytes each has in common with the one before, -1
    across keys."""
    table = np.zeros((len(strings), 8 + width), np.uint8)
    table[:, :8] = keys.astype(">i8").view(np.uint8).reshape(-1, 8)
    for k, s in enumerate(strings):
        table[k, 8:8 + len(s)] = np.frombuffer(s, np.uint8)
    order = np.argsort(table.view(f"V{8 + width}").ravel(), kind="stable")
    table = table[order]
    common = np.full(len(order), -1, np.int64)
    differs = table[1:] != table[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), 8 + width)
    common[1:] = np.where(first < 8, -1, first - 8)
    return order, common


def repeated_starts(length: int):
    """Which strings of the contexts of a bucket of keys occur in another context too: id, low and high of their starts.

    The phrases before the triggers are sorted from their ends (the order of the dictionary's suffixes), and what follows
    the triggers from its beginning (the order of the parse). Neighbours' common lengths in both orders give, for each
    distance of a start from its trigger, the rank of the phrase suffix and of what follows it; equal pairs are equal strings.
    """
    def run(rows: pa.Table) -> pa.Table:
        keys = rows["key"].to_numpy()
        low, high, at = (rows[c].to_numpy().astype(np.int64) for c in ("low", "high", "at"))
        fixed = rows["fixed"].to_numpy(zero_copy_only=False).astype(bool)
        before, before_common = _sorted_runs(keys, [s[::-1] for s in rows["left"].to_pylist()], length)
        after, after_common = _sorted_runs(keys, rows["right"].to_pylist(), length)
        found = np.zeros((len(keys), length + 1), bool)
        for distance in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
            own = (low <= distance) & (distance <= high)
            ranks = np.empty((2, len(keys)), np.int64)
            ranks[0, before] = np.cumsum(before_common < distance)
            ranks[1, after] = np.cumsum(after_common < length - distance)
            some = np.flatnonzero(own)
            _, where, times = np.unique(ranks[0, some] * (len(keys) + 1) + ranks[1, some], return_inverse=True, return_counts=True)
            found[some, distance] = (times > 1)[where] & ~fixed[some]
        turn = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(turn == 1)
        _, stop = np.nonzero(turn == -1)
        return pa.table({"id": rows["id"].take(pa.array(row)).combine_chunks() if len(row) else pa.array([], pa.binary()),
                         "low": pa.array((at[row] - stop + 1).astype(np.int32)), "high": pa.array((at[row] - first).astype(np.int32))})
    return run


def _compared(contexts: DataFrame, length: int, together: int, most: int) -> DataFrame:
    """id, low and high: starts of repeated strings among the contexts. Keys with more than ``most`` contexts are compared string by string."""
    sizes = contexts.groupBy("key").agg(F.count("*").alias("weight"))
    heavy = staged(sizes.filter(F.col("weight") > most))
    rows = contexts
    hot = None
    if not heavy.isEmpty():
        marked = staged(lookup(contexts, heavy, ["key"], "weight", ["id", "at"]))
        rows, hot = marked.filter("weight IS NULL").drop("weight"), marked.filter("weight IS NOT NULL").drop("weight")
    buckets = max(1, -(-rows.count() // together))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    found = rows.groupBy("bucket").applyInArrow(repeated_starts(length), "id binary, low int, high int")
    if hot is None:
        return found
    strings = hot.withColumn("distance", F.explode(F.sequence("low", "high")))
    string = F.concat(F.expr("substring(left, high - distance + 1)"), F.expr(f"substring(right, 1, {length} - distance)"))
    strings = staged(strings.select("id", "fixed", (F.col("at") - F.col("distance")).alias("start"),
                                    F.substring(F.unhex(F.sha2(string, 256)), 1, 16).alias("string")))
    counts = staged(strings.groupBy("string").agg(F.count("*").alias("weight")).filter("weight > 1"))
    again = lookup(strings.filter("NOT fixed"), counts, ["string"], "weight", ["id", "start"]).filter("weight IS NOT NULL")
    return found.unionByName(again.select("id", F.col("start").alias("low"), F.col("start").alias("high")))


def _finished(texts: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """Results of texts from the starts of their repeated strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", batch_bytes):
            ends, data = texts_of(batch["text"])
            ends, data = ends - ends[0], data[ends[0]:ends[-1]]
            change = np.zeros(len(data) + 1, np.int32)
            for first, last in (("lows", "highs"), ("more_lows", "more_highs")):
                sizes = np.diff(batch[first].offsets.to_numpy())
                home = np.repeat(ends[:-1], sizes)
                np.add.at(change, home + batch[first].flatten().to_numpy(), 1)
                np.add.at(change, home + batch[last].flatten().to_numpy() + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            measures = _measured(data, ends, gone, np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch["id"], *measures], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(run, RESULT)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   batch_bytes: int = 8 << 20, together: int = 20_000, most: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per row of ``docs``: what is left of each text without the
    bytes covered by a string of ``length`` bytes that also starts anywhere else, in the same text or another.

    Texts are parsed where they are read (see ``Parse``). A first pass counts the keys of all parts; in a second, parts of keys that
    occur once fall away, and parts whose whole context is repeated are decided. Only contexts that share a key and differ are
    compared byte by byte, in the orders of ``repeated_starts``: the edges of copied passages. Equal texts are one, and
    all their strings are repeated. Keys with more than ``most`` different contexts are compared by digests of their strings,
    which gives the same result for any number of them. Text moves once, and once more for documents with open edges.

    Contexts are equal if their 64-bit digests and 64-bit keys are, texts and strings if 128 bits of their SHA-256 are. NULL
    texts count as empty; texts shorter than ``length`` bytes lose nothing. Rows that repeat an id or a text are texts each, and NULL ids
    stay NULL. An empty table gives no rows; other columns are ignored.
    """
    if length < 32 or length > 2000:
        raise ValueError("length must be from 32 to 2000")
    keys = _shared_keys(docs, text_col, length, batch_bytes)
    live = lookup(_parts(docs, text_col, length, batch_bytes), keys, ["key"], "weight", ["id", "number"])
    live = staged(live.filter("weight IS NOT NULL").drop("weight"))
    kinds = live.groupBy("key", "context").agg(F.sum("n").alias("times"), F.count("*").alias("weight"),
                                               F.min(F.struct("number", "id")).alias("one"))
    kinds = staged(kinds)
    per_key = kinds.groupBy("key").agg(F.min("times").alias("least"), F.count("*").alias("contexts"))
    kinds = lookup(kinds, staged(per_key), ["key"], "contexts", ["context"])
    kinds = staged(kinds.withColumn("open", F.col("least") == 1).drop("least", "contexts"))
    marks = lookup(live.select("id", "number", "key", "context"), kinds, ["key", "context"], "weight", ["id", "number"])
    whole = F.col("times") > 1
    shown = F.col("open") & (~whole | (F.struct("number", "id") == F.col("one")))
    marks = marks.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(
        "number", "key", whole.alias("whole"), shown.alias("shown")))).alias("marks"))
    texts = docs.select(_identity(text_col).alias("id"), whole_text(text_col).alias("text")).groupBy("id").agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    none = F.expr("CAST(array() AS array<struct<number:bigint,key:bigint,whole:boolean,shown:boolean>>)")
    texts = texts.join(marks, "id", "left").withColumn("marks", F.coalesce("marks", none))
    state = staged(_decided(texts, length, batch_bytes))

    contexts = state.filter("kind = 2").select("id", "key", "at", "low", "high", "fixed", "left", "right")
    more = _compared(contexts, length, together, most).groupBy("id").agg(
        F.collect_list(F.struct("low", "high")).alias("_more"))
    rest = state.filter("kind = 1").select("id", "text", "lows", "highs").join(more, "id", "left")
    numbers = F.expr("CAST(array() AS array<int>)")
    rest = rest.select("id", "text", "lows", "highs", F.coalesce("_more.low", numbers).alias("more_lows"),
                       F.coalesce("_more.high", numbers).alias("more_highs"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    results = state.filter("kind = 0").select(*names).unionByName(_finished(rest, length, batch_bytes))
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _identity(text_col).alias("id"))
    weights = named.groupBy("id").agg(F.count("*").alias("copies"))
    results = staged(results.join(weights, "id"))
    return lookup(named, results, ["id"], "copies", ["doc_id"]).select("doc_id", *names[1:])
