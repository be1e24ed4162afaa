"""Nearest neighbours by inner product: cross-polytope hashing, multiprobe tables, exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealstream.operators.plan import staged


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the length is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        halves = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.float32(np.sqrt(width))


class CrossPolytope:
    """Hash tables of two joined pseudo-rotations each: three rounds of random signs and a Hadamard transform. A rotation takes a vector
    to the signed axis nearest to it, whatever its length; a table's bucket is the pair of axes, one of (2 * width)^2.
    """

    def __init__(self, width: int, tables: int, seed: int = 7):
        self.width = 1 << max(0, (width - 1).bit_length())
        self.axes, self.tables = 2 * self.width, tables
        self.buckets = self.axes ** 2
        self.signs = np.random.default_rng(seed).choice(np.float32([-1, 1]), (tables, 2, 3, self.width))

    def rotated(self, vectors: np.ndarray):
        """For each table the signed coordinates after its two rotations."""
        x = np.zeros((len(vectors), self.width), dtype=np.float32)
        x[:, :vectors.shape[1]] = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-300)
        for pair in self.signs:
            both = []
            for signs in pair:
                turned = x
                for flip in signs:
                    turned = hadamard(turned * flip)
                both.append(np.concatenate([turned, -turned], axis=1))
            yield both

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return np.stack([a.argmax(axis=1) * self.axes + b.argmax(axis=1) for a, b in self.rotated(vectors)], axis=1)

    def probes(self, vectors: np.ndarray, number: int):
        """For each table the ``number`` best buckets of each vector, by the sum of its two coordinates, best first. A pair of
        the i-th and j-th best axes has (i + 1) * (j + 1) - 1 better ones, so few pairs need sorting."""
        number = min(number, self.buckets)
        first = np.concatenate([np.full(min(self.axes, number // (i + 1)), i) for i in range(min(self.axes, number))])
        second = np.concatenate([np.arange(min(self.axes, number // (i + 1))) for i in range(min(self.axes, number))])
        for a, b in self.rotated(vectors):
            by_a, by_b = np.argsort(-a, axis=1, kind="stable"), np.argsort(-b, axis=1, kind="stable")
            sums = np.take_along_axis(a, by_a, 1)[:, first] + np.take_along_axis(b, by_b, 1)[:, second]
            best = np.argsort(-sums, axis=1, kind="stable")[:, :number]
            yield (np.take_along_axis(by_a, first[best], 1) * self.axes + np.take_along_axis(by_b, second[best], 1))

    def ranks(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """How many buckets come before that of ``vectors[n]`` for ``queries[n]``, in the table where they are fewest."""
        least = np.full(len(queries), self.buckets)
        for (a, b), code in zip(self.rotated(queries), self.codes(vectors).T):
            n = np.arange(len(queries))
            own = a[n, code // self.axes] + b[n, code % self.axes]
            ordered = np.sort(b, axis=1)
            before = [(self.axes - np.searchsorted(ordered[i], own[i] - a[i], side="right")).sum() for i in n]
            least = np.minimum(least, np.array(before, dtype=np.int64))
        return least


def _matrix(column) -> np.ndarray:
    """Rows of equal-length lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _indexed(rows: DataFrame, hasher: CrossPolytope, groups: int) -> DataFrame:
    """``rows`` with one row per table: ``code``, the bucket of their column ``vector``, and ``bucket``, the group of neighbouring
    buckets of one table that are searched together."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = hasher.codes(_matrix(part["vector"]))
                ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*[part[n] for n in names], lists], [*names, "_codes"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    out = rows.mapInArrow(run, ", ".join([*fields, "_codes array<bigint>"])).select(*names, F.posexplode("_codes").alias("_t", "code"))
    return out.select(*names, "code", (F.col("_t").cast("bigint") * groups + F.expr(f"code * {groups} div {hasher.buckets}")).alias("bucket"))


def _probing(rows: DataFrame, hasher: CrossPolytope, groups: int, number: int, tables: range) -> DataFrame:
    """query_id, vector and least of ``rows`` for each group of buckets of some tables they look into, with the ``codes`` there and
    their ``ranks``."""
    schema = (f"query_id bigint, vector {rows.schema['vector'].dataType.simpleString()}, least double, bucket bigint, "
              "codes array<bigint>, ranks array<int>")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, (1 << 18) // number)):
                part = batch.slice(at, max(1, (1 << 18) // number))
                for t, codes in enumerate(hasher.probes(_matrix(part["vector"]), number)):
                    if t not in tables:
                        continue
                    group = codes * groups // hasher.buckets
                    row, rank = np.divmod(np.arange(codes.size), codes.shape[1])
                    order = np.lexsort((rank, group.ravel(), row))
                    row, rank, group, flat = row[order], rank[order], group.ravel()[order], codes.ravel()[order]
                    begin = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(group) != 0)]))
                    ends = pa.array(np.append(begin, len(row)).astype(np.int32))
                    who = pa.array(row[begin])
                    yield pa.RecordBatch.from_arrays([
                        part["query_id"].take(who), part["vector"].take(who), part["least"].take(who), pa.array(t * groups + group[begin]),
                        pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(rank.astype(np.int32)))],
                        ["query_id", "vector", "least", "bucket", "codes", "ranks"])

    return rows.select("query_id", "vector", "least").mapInArrow(run, schema)


def _best(k: int, row: np.ndarray, col: np.ndarray, score: np.ndarray, firsts: np.ndarray):
    """The ``k`` best of each row's columns, ties to the smaller first id."""
    order = np.lexsort((firsts[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], score[kept]


def _matched(k: int, pairs: int = 1 << 18):
    """Best ``k`` vectors of a group of buckets for each query that looks into it, among those in its buckets alone and of
    the score ``least`` or more."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [np.empty(0, np.int64)], "at": [np.empty(0, np.int64)], "score": [np.empty(0)]}
        if left.num_rows and right.num_rows:
            q, x = _matrix(left["vector"]).astype(np.float64), _matrix(right["vector"]).astype(np.float64)
            firsts, ids, limit = right["first"].to_numpy(), left["query_id"].to_numpy(), right["limit"].to_numpy()
            least = left["least"].to_numpy()
            by_code = np.argsort(right["code"].to_numpy(), kind="stable")
            held = right["code"].to_numpy()[by_code]
            lists = left["codes"].combine_chunks()
            flat, ranks = lists.flatten().to_numpy(), left["ranks"].combine_chunks().flatten().to_numpy()
            asker = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            low, high = np.searchsorted(held, flat, side="left"), np.searchsorted(held, flat, side="right")
            used = np.flatnonzero(high > low)
            asker, ranks, low, size = asker[used], ranks[used], low[used], (high - low)[used]
            sums = np.cumsum(size)
            a = 0
            while a < len(used):  # whole queries, about as many pairs at a time
                b = max(int(np.searchsorted(sums, (sums[a - 1] if a else 0) + pairs)), a + 1)
                b = int(np.searchsorted(asker, asker[min(b, len(used)) - 1], side="right"))
                n = size[a:b]
                place = np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                row, col = np.repeat(asker[a:b], n), by_code[place]
                able = np.repeat(ranks[a:b], n) < limit[col]
                row, col = row[able], col[able]
                score = np.empty(len(row))
                for c in range(0, len(row), 1 << 16):
                    score[c:c + (1 << 16)] = (q[row[c:c + (1 << 16)]] * x[col[c:c + (1 << 16)]]).sum(axis=1)
                able = score >= least[row]
                row, col, score = _best(k, row[able], col[able], score[able], firsts)
                for name, values in (("query_id", ids[row]), ("at", col), ("score", score)):
                    out[name].append(values)
                a = b
        flat_out = {c: np.concatenate(v) for c, v in out.items()}
        return pa.table({"query_id": pa.array(flat_out["query_id"]), "ids": right["ids"].take(pa.array(flat_out["at"])),
                         "score": pa.array(flat_out["score"])})
    return run


def _rerank(k: int):
    """Best ``k`` vectors of a block for each query of a block: by a matrix product first, then, for those near the
    last place, by a sum that does not depend on the block."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "at": [], "score": []}
        if left.num_rows and right.num_rows:
            q, x = _matrix(left["vector"]).astype(np.float64), _matrix(right["vector"]).astype(np.float64)
            firsts, ids = right["first"].to_numpy(), left["query_id"].to_numpy()
            for at in range(0, len(q), 256):
                rough = q[at:at + 256] @ x.T
                least = np.partition(rough, -min(k, len(x)), axis=1)[:, -min(k, len(x))]
                slack = 1e-9 * (1 + np.abs(least))
                rows, cols = np.nonzero(rough >= (least - slack)[:, None])
                score = (q[at + rows] * x[cols]).sum(axis=1)
                order = np.lexsort((firsts[cols], -score, rows))
                rows, cols, score = rows[order], cols[order], score[order]
                starts = np.searchsorted(rows, rows)
                best = np.arange(len(rows)) - starts < k
                out["query_id"].append(ids[at + rows[best]])
                out["at"].append(cols[best])
                out["score"].append(score[best])
        where = np.concatenate([np.empty(0, np.int64), *out["at"]])
        return pa.table({"query_id": pa.array(np.concatenate([np.empty(0, np.int64), *out["query_id"]])),
                         "ids": right["ids"].take(pa.array(where)),
                         "score": pa.array(np.concatenate([np.empty(0), *out["score"]]))})
    return run


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector: rows with an id and a vector of finite components, not all zero, and of the most frequent
    length (the larger of two). Of rows that share an id, the one of the smallest vector counts."""
    x = F.col("vector")
    good = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    good = good.filter(F.col("vec_id").isNotNull() & x.isNotNull())
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = good.filter(~bad & F.exists(x, lambda c: c != 0))
    lengths = good.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n"))
    width = lengths.agg(F.max_by("w", F.struct("n", "w"))).first()[0]
    return good.filter(F.size("vector") == (width or 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _joined(data: DataFrame, asked: DataFrame, kernel, block: int) -> DataFrame:
    """Queries against the vectors of their buckets: ``data`` has bucket, first, ids and vector, ``asked`` bucket, query_id and vector. A
    bucket's rows are dealt out in blocks of about ``block`` vectors and as many queries, however full it is."""
    sizes = data.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).join(
        asked.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("lots")), "bucket")
    sizes = staged(sizes)
    sizes = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    data = data.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("first"), F.col("parts")).cast("int"))
    data = data.withColumn("lot", every("lots")).drop("parts", "lots")
    asked = asked.join(sizes, "bucket").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int"))
    asked = asked.withColumn("part", every("parts")).drop("parts", "lots")
    keys = ["bucket", "part", "lot"]  # dealt out by all three: a full bucket is many tasks
    asked, data = asked.repartition(*keys), data.repartition(*keys)
    return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(kernel, "query_id bigint, ids array<bigint>, score double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` best of what was found in any block or table, a vector counted once."""
    first = F.get("ids", F.lit(0))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    found = found.groupBy("query_id", first.alias("first")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    found = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _nearest(data: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """The exact ``k`` nearest among all vectors, block by block."""
    every = F.lit(0).cast("bigint")
    return _merged(_joined(data.withColumn("bucket", every), asked.withColumn("bucket", every), _rerank(k + 1), block), k)


def probe_limits(data: DataFrame, asked: DataFrame, hasher: CrossPolytope, k: int, block: int, recall: float, sample: int) -> dict[int, int]:
    """How many buckets of each table a query must look into for the vectors of each range of lengths, as measured.

    Of ``sample`` queries, chosen by a hash, the exact nearest are found by brute force. A range's limit is the number of buckets
    after which the share ``recall`` of its vectors among these has been met in some table; half of all buckets or more means that
    hashing does not help there. Ranges without one of the nearest get the least limit of the others.
    """
    chosen = staged(asked.orderBy(F.xxhash64("query_id"), "query_id").limit(sample))
    near = _nearest(data.select("first", "ids", "vector"), chosen, k, block).select("query_id", "vec_id")
    owners = data.select("vector", "span", F.explode("ids").alias("vec_id"))
    pairs = near.join(owners, "vec_id").join(chosen.select("query_id", F.col("vector").alias("q")), "query_id")
    pairs = pairs.select("q", "vector", "span").toArrow()
    if not pairs.num_rows:
        return {}
    spans = pairs["span"].to_numpy()
    ranks = np.concatenate([hasher.ranks(_matrix(b["q"]), _matrix(b["vector"])) for b in pairs.combine_chunks().to_batches(256)])
    limits = {}
    for s in np.unique(spans):
        own = np.sort(ranks[spans == s])
        limits[int(s)] = int(own[len(own) - 1 - int((1 - recall) * len(own))]) + 1
    return limits


def search(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           tables: int = 10, probes: int = 16, recall: float = 0.98, sample: int = 64, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest vectors found for each row for which ``is_query``, a column
    over vec_id, holds; the nearest has the largest inner product of the original vectors, ties go to the smaller id.

    Every usable vector is hashed by direction, into one bucket of each table (see ``CrossPolytope``). A query looks into the buckets nearest
    to it, and what it finds there is scored exactly. How many buckets depends on the range of lengths (ends differ by a factor of
    sqrt(2)) a vector is in, and is measured: on ``sample`` queries against all vectors, so that ``recall`` of their nearest would be found
    in each range; ``probes`` is the least. Few long vectors are near by length more than by angle; where half of all buckets would be needed, the
    range is scored whole. A query that finds fewer than ``k``, and fewer than there are candidates, is scored against all vectors.

    The first table is searched before the others, which then return only vectors that reach its k-th score. Equal vectors are one
    entry with their ``k`` + 1 smallest ids, which are all that can be among the nearest. Neighbouring buckets of a
    table form groups of about ``block`` vectors, so the number of groups grows with the table, and a query's rows are bounded by its
    buckets, not by the table.

    NULL or zero vectors and those with NULL or non-finite components take no part, nor do NULL ids
    and vectors of another length than most. Of rows that share an id, one counts. A query finds fewer than ``k`` if
    there are fewer candidates; an empty table gives no rows. Other columns are ignored.
    """
    good = staged(usable(rows, id_col, vector_col))
    square = F.aggregate("vector", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    span = F.coalesce(F.floor(F.log2(square) + 0.5), F.lit(-(1 << 20)))  # as many as a double has exponents, at most
    few = Window.partitionBy("vector").orderBy("vec_id")  # ranks are limited before the shuffle
    distinct = good.withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= k + 1)
    distinct = distinct.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    data = staged(distinct.select("vector", "ids", F.get("ids", F.lit(0)).alias("first"), span.cast("int").alias("span")))
    entries, width = data.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not entries:
        return rows.sparkSession.createDataFrame([], schema)
    asked = staged(good.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector"))
    hasher = CrossPolytope(width, tables)
    limits = probe_limits(data, asked, hasher, k, block, recall, sample)
    whole = [s for s, n in limits.items() if 2 * n >= hasher.buckets]
    hashed = {s: max(n, probes) for s, n in limits.items() if s not in whole}
    least = min(hashed.values(), default=probes)
    groups = max(1, min(hasher.buckets, -(-entries // block)))
    limit = F.lit(least)
    for s, n in hashed.items():  # one entry per range of lengths
        limit = F.when(F.col("span") == s, F.lit(n)).otherwise(limit)
    inside = F.col("span").isin(whole) if whole else F.lit(False)
    index = staged(_indexed(data.filter(~inside).select("first", "ids", "vector", limit.cast("int").alias("limit")), hasher, groups))
    number, anything = max(hashed.values(), default=probes), F.lit(float("-inf")).alias("least")
    probing = _probing(asked.select("*", anything), hasher, groups, number, range(1))
    found = _joined(index.filter(F.col("bucket") < groups), staged(probing), _matched(k + 1), block)
    if whole:
        zero = F.lit(0).cast("bigint")
        found = found.unionByName(_joined(data.filter(inside).select("first", "ids", "vector", zero.alias("bucket")),
                                          asked.withColumn("bucket", zero), _rerank(k + 1), block))
    found = staged(found)
    # The first table gives a score that k others reach, so the other tables need not return less.
    first = F.get("ids", F.lit(0)).alias("first")
    ranked = found.groupBy("query_id", first).agg(F.max("score").alias("score")).withColumn(
        "_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    bound = ranked.filter(F.col("_n") == k + 1).select("query_id", F.col("score").alias("least"))
    later = asked.join(bound, "query_id", "left").select("query_id", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    probing = _probing(later, hasher, groups, number, range(1, tables))
    found = found.unionByName(_joined(index.filter(F.col("bucket") >= groups), staged(probing), _matched(k + 1), block))
    best = staged(_merged(found, k))

    most = min(k, good.count() - 1)
    done = best.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= most)
    short = staged(asked.join(done, "query_id", "left_anti"))
    if short.isEmpty():
        return best
    return best.join(short.select("query_id"), "query_id", "left_anti").select(*best.columns).unionByName(
        _nearest(data.select("first", "ids", "vector"), short, k, block))
