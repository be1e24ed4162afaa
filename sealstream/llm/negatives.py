"""Hard negatives: threshold joins over an inverted index with bounds by norms, in windows of scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealstream.llm.common import lookup
from sealstream.operators.plan import staged

#: Scores lie between these: vectors have a norm below 2^29 after scaling.
LEAST, MOST = -(1 << 58), 1 << 58
STRIP = 8


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, label, q: rows with an id, a label and a vector of finite components, scaled and rounded down. Of rows
    that share an id, the one of the smallest label and vector counts."""
    x = F.col("vector")
    good = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                       F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    good = good.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull())
    good = good.filter(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    square = F.aggregate(x, F.lit(0.0), lambda s, c: s + F.pow(scale * c, F.lit(2.0)))
    good = good.filter(square < 2.0 ** 58)
    good = good.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_r"))
    return good.select("vec_id", "_r.label", F.transform("_r.vector", lambda c: F.floor(scale * c)).alias("q"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of integers; a shorter vector counts as 0 beyond its end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class ThresholdIndex:
    """Inverted lists over a block of vectors, by dimension, for scores of at least ``share`` of a query's norm.

    Dimensions stand in rising order of energy. A vector's first dimensions, as long as their norm stays below
    ``share``, are not in the lists: alone they cannot lift a score to a threshold. Vectors are sorted by where their
    indexed part begins, so that each list is one run of them.
    """

    def __init__(self, x: np.ndarray, share: float, exact: type):
        energy = np.square(x.astype(np.float64))
        self.order = np.argsort(energy.sum(axis=0), kind="stable")
        self.edges = np.arange(0, x.shape[1] + STRIP, STRIP).clip(max=x.shape[1])
        sums = np.concatenate([np.zeros((len(x), 1)), np.cumsum(energy[:, self.order], axis=1)], axis=1)
        norms = np.sqrt(sums[:, self.edges])
        begin = (norms < share * (1 - 1e-9)).sum(axis=1) - 1 if share > 0 else np.zeros(len(x), np.int64)
        begin = begin.clip(min=0)
        self.rows = np.argsort(begin, kind="stable")
        self.begin, self.norms = begin[self.rows], norms[self.rows]
        self.x = x[self.rows][:, self.order].astype(exact)

    def matches(self, q: np.ndarray, least: np.ndarray):
        """Query, vector and score of all pairs whose score reaches the query's threshold.

        Lists are read from the last dimension back, adding to partial scores. A pair is dropped as soon as its partial
        score and the norms of what is left stay below the threshold; what the lists omit is added for pairs that remain.
        """
        q = q[:, self.order].astype(self.x.dtype)
        left = np.sqrt(np.concatenate([np.zeros((len(q), 1)), np.cumsum(np.square(q.astype(np.float64)), axis=1)], axis=1))
        left = left[:, self.edges]
        slack = 1 + 1e-9 * left[:, -1] * (self.norms[:, -1].max() if len(self.x) else 0)
        floor = least.astype(np.float64) - slack
        alive = np.flatnonzero(self.norms[:, -1] * left[:, -1].max() >= floor.min())
        partial = np.zeros((len(q), len(alive)), self.x.dtype)
        strip = len(self.edges) - 2
        pairs = None
        while strip >= 0 and len(alive):
            cut = np.searchsorted(self.begin[alive], strip, side="right")  # those whose indexed part has this strip
            a, b = self.edges[strip], self.edges[strip + 1]
            partial[:, :cut] += q[:, a:b] @ self.x[alive[:cut], a:b].T
            rest = np.maximum(self.begin[alive], strip)
            able = partial + left[:, rest] * self.norms[alive, rest] >= floor[:, None]
            kept = able.any(axis=0)
            if kept.sum() < 0.8 * len(kept):
                alive, partial, able = alive[kept], partial[:, kept], able[:, kept]
            if strip == 0 or able.sum() < 0.05 * able.size:
                row, col = np.nonzero(able)
                pairs = row, alive[col], partial[row, col], np.maximum(self.begin[alive[col]], strip)
                break
            strip -= 1
        if pairs is None:
            none = np.empty(0, np.int64)
            return none, none, none
        row, col, score, rest = pairs
        for strip in range(int(rest.max(initial=0)) - 1, -1, -1):
            a, b = self.edges[strip], self.edges[strip + 1]
            some = np.flatnonzero(rest > strip)
            score[some] += (q[row[some], a:b] * self.x[col[some], a:b]).sum(axis=1)
            rest[some] = strip
            able = score + left[row, rest] * self.norms[col, rest] >= floor[row]
            row, col, score, rest = row[able], col[able], score[able], rest[able]
        score = score.astype(np.int64)
        able = score >= least[row]
        return row[able], self.rows[col[able]], score[able]


def _windows(k: int, same: bool, share: float, reach: float, width: int):
    """The ``k`` best of a block of entries in each score window of a block of queries, down to this round's thresholds."""
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "win": [], "score": [], "at": []}
        if asked.num_rows and held.num_rows:
            q, x = _matrix(asked["q"], width), _matrix(held["q"], width)
            norms = np.sqrt(np.square(q.astype(np.float64)).sum(axis=1))
            top = norms * reach + 1
            exact = np.float64 if top.max() < 2.0 ** 52 else np.int64
            wins = asked["wins"].to_pylist()
            least = np.empty(len(q), np.int64)
            for n, own in enumerate(wins):
                for w in own:
                    high, low = min(w["hi"], top[n]), max(w["lo"], -top[n])
                    w["least"] = w["lo"] if share >= 1 else max(w["lo"], int(np.floor(high - share * (high - low))))
                least[n] = min(w["least"] for w in own)
            firsts, queries = held["first"].to_numpy(), asked["query"].to_numpy()
            labels, own_labels = (t["label"].combine_chunks().dictionary_encode() for t in (held, asked))
            names = {v: n for n, v in enumerate(labels.dictionary.to_pylist())}
            label = labels.indices.to_numpy()
            own_label = np.array([names.get(v, -1) for v in own_labels.dictionary.to_pylist()])[own_labels.indices.to_numpy()]
            index = ThresholdIndex(x, float((least / np.maximum(norms, 1e-300)).min()), exact)
            for at in range(0, len(q), 256):
                row, col, score = index.matches(q[at:at + 256], least[at:at + 256])
                fits = (label[col] == own_label[at + row]) == same
                row, col, score = row[fits], col[fits], score[fits]
                order = np.lexsort((firsts[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                ends = np.searchsorted(row, np.arange(len(q[at:at + 256]) + 1))
                for n, (a, b) in enumerate(zip(ends, ends[1:])):
                    for w in wins[at + n]:
                        begin = a + np.searchsorted(-score[a:b], -w["hi"])
                        stop = min(begin + k, a + np.searchsorted(-score[a:b], -w["least"], side="right"))
                        if stop > begin:
                            out["at"].append(col[begin:stop])
                            out["score"].append(score[begin:stop])
                            out["query"].append(np.full(stop - begin, queries[at + n]))
                            out["win"].append(np.full(stop - begin, w["win"]))
        none = np.empty(0, np.int64)
        flat = {c: np.concatenate([none, *v]) for c, v in out.items()}
        return pa.table({"query": pa.array(flat["query"]), "win": pa.array(flat["win"]), "score": pa.array(flat["score"]),
                         "ids": held["ids"].take(pa.array(flat["at"]))})
    return run


def _in_blocks(entries: DataFrame, queries: DataFrame, run, same: bool, block: int, lot: int) -> DataFrame:
    """Blocks of entries against lots of queries; for searches inside a label these are dealt out by a hash of it."""
    bucket = F.pmod(F.xxhash64("label"), F.lit(64)) if same else F.lit(0).cast("bigint")
    entries, queries = entries.withColumn("bucket", bucket), queries.withColumn("bucket", bucket)
    sizes = entries.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).join(
        queries.groupBy("bucket").agg(F.ceil(F.count("*") / lot).cast("int").alias("lots")), "bucket")
    sizes = F.broadcast(staged(sizes))  # 64 rows at most

    def dealt(id_col: str, number: str) -> Column:
        return F.pmod(F.xxhash64(id_col), F.col(number)).cast("int")

    def every(number: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    held = entries.join(sizes, "bucket").withColumn("part", dealt("first", "parts")).withColumn("lot", every("lots"))
    asked = queries.join(sizes, "bucket").withColumn("lot", dealt("query", "lots")).withColumn("part", every("parts"))
    keys = ["bucket", "part", "lot"]
    held, asked = held.drop("parts", "lots"), asked.drop("parts", "lots")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        run, "query bigint, win bigint, score bigint, ids array<bigint>")


def window_search(entries: DataFrame, queries: DataFrame, windows: DataFrame, k: int, same: bool,
                  steps: tuple[float, ...] = (0.25, 0.375, 0.5, 1.0), block: int = 8192, lot: int = 1024) -> DataFrame:
    """query, win, rank, vec_id and score: the ``k`` best ids in each window, best first and ties by id.

    ``entries`` has first, label, q and ids (its ids in order, as many as can be asked for), ``queries`` query, label and
    q, ``windows`` query, win, lo and hi, the scores wanted. With ``same`` only entries of the query's label count, else only others.

    Each round is a threshold join: a window's threshold lies ``steps`` of the way from its upper to its lower end, as far as norms
    allow such scores. Windows with ``k`` ids at or above the threshold are full and done, exactly; the others go on with the
    next, lower threshold, at last the lower end itself.
    """
    square = F.aggregate("q", F.lit(0.0), lambda s, c: s + F.pow(c.cast("double"), F.lit(2.0)))
    reach, width = entries.agg(F.sqrt(F.max(square)), F.max(F.size("q"))).first()
    other = queries.agg(F.max(F.size("q"))).first()[0]
    schema = "query bigint, win bigint, rank int, vec_id bigint, score bigint"
    spark = entries.sparkSession
    if reach is None or other is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("query", "win").orderBy(F.desc("score"), "vec_id")
    done, pending = [], staged(windows.filter("lo <= hi"))
    for share in steps:
        asked = pending.groupBy("query").agg(F.collect_list(F.struct("win", "lo", "hi")).alias("wins"))
        run = _windows(k, same, share, reach, max(width, other, 1))
        found = _in_blocks(entries, queries.join(asked, "query"), run, same, block, lot)
        found = found.select("query", "win", "score", F.explode("ids").alias("vec_id"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = staged(found.select("query", "win", "rank", "vec_id", "score"))
        if share >= 1:
            done.append(found)
            break
        full = found.filter(F.col("rank") == k).select("query", "win")
        done.append(found.join(full, ["query", "win"], "left_semi"))
        pending = staged(pending.join(full, ["query", "win"], "left_anti"))
        if pending.isEmpty():
            break
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, scale: int = 256,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = 8192,
         lot: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Components are scaled and rounded down; a score is the inner product of integers, higher first, ties by the smaller id.
    An anchor (a row for which ``is_anchor``, a column over vec_id, holds) has the ``positives`` first other rows of its label. For each
    of these the ``negatives`` first rows of another label are returned whose score is from ``low`` to ``high`` tenths of the positive's.

    Equal vectors of a label are one entry, with as many of its smallest ids as can be asked for; anchors among them are searched
    once, and once for each different positive score. Blocks of entries meet lots of anchors; see ``window_search``.

    Rows with a NULL id or label, a NULL vector or NULL or non-finite components take no part, nor do vectors of a norm of 2^29 or
    more after scaling, whose scores would leave 64 bits. Zero vectors take part; a shorter vector counts as 0 beyond its end. Of rows that
    share an id, the one of the smallest label and vector counts. Anchors without positives, or positives without rows in
    their window, have no rows. An empty table gives none. Other columns are ignored.
    """
    good = staged(usable(rows, id_col, label_col, vector_col, scale))
    few = Window.partitionBy("label", "q").orderBy("vec_id")  # ranks are limited before the shuffle
    most = max(positives + 1, negatives)
    entries = good.withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= most)
    entries = entries.groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = staged(entries.withColumn("first", F.get("ids", F.lit(0))))

    chosen = good.filter(is_anchor)
    groups = chosen.groupBy("label", "q").agg(F.count("*").alias("weight"))
    groups = staged(groups.join(entries, ["label", "q"]).select("label", "q", "weight", F.col("first").alias("query")))
    anchors = lookup(chosen.withColumnRenamed("vec_id", "anchor_id"), groups, ["label", "q"], "weight", ["anchor_id"])
    queries = groups.select("query", "label", "q")
    everything = queries.select("query", F.lit(0).cast("bigint").alias("win"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    near = window_search(entries, queries, everything, positives + 1, True, block=block, lot=lot)
    near = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    near = staged(near.join(groups.select("query", "weight"), "query"))
    others = F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("anchor_id")), 1, positives)
    pairs = lookup(anchors.select("anchor_id", "query"), near, ["query"], "weight", ["anchor_id"])
    pairs = pairs.select("anchor_id", "query", F.explode(others).alias("p"))
    pairs = staged(pairs.select("anchor_id", "query", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("win")))

    scores = staged(pairs.groupBy("query", "win").agg(F.count("*").alias("weight")))
    # ends are rounded to whole scores inside the window
    windows = scores.select("query", "win", F.expr(f"({low}L * win + pmod(-{low}L * win, 10L)) div 10").alias("lo"),
                            F.expr(f"({high}L * win - pmod({high}L * win, 10L)) div 10").alias("hi"))
    hard = window_search(entries, queries, windows, negatives, False, block=block, lot=lot)
    hard = hard.groupBy("query", "win").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("hard"))
    hard = hard.join(scores, ["query", "win"])
    out = lookup(pairs, staged(hard), ["query", "win"], "weight", ["anchor_id", "positive_id"])
    out = out.select("anchor_id", "positive_id", F.col("win").alias("positive_score"), F.explode("hard").alias("n"))
    return out.select("anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.vec_id").alias("negative_id"),
                      "positive_score", F.col("n.score").alias("negative_score"))
