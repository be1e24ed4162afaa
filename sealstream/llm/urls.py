"""URL filter: rules first, then words cut out of host names and paths, judged by naive Bayes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealstream.llm.common import carried, kth_largest, lower_ascii
from sealstream.operators.plan import staged

#: Words that mark a site as unwanted; a training page is one whose host or path holds one.
UNWANTED = ("ad", "ads", "adult", "banner", "bet", "bets", "betting", "bingo", "casino", "cams", "click", "clicks",
            "coupon", "dating", "doubleclick", "escort", "gamble", "gambling", "jackpot", "lottery", "malware", "nude",
            "payday", "phishing", "pills", "pharma", "poker", "popunder", "porn", "popup", "roulette", "scam", "sex",
            "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end.
    Both are empty if the url is NULL or has no ://."""
    pattern = "://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL if none fits. A rule is (host, path, verdict): it fits its host
    and all subdomains where the path starts with the rule's. A short list, written out as one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def word_counts(texts: Column, rows: DataFrame, most: int = 100_000) -> dict[str, int]:
    """Unigram counts over the visible text of all rows; at most the ``most`` frequent words form the vocabulary, which is
    sent to every task. Words that tie at the last place are left out."""
    visible = F.regexp_replace(texts, "(?is)<(script|style)\\b.*?</\\1>|<!--.*?-->|<[^>]*>", " ")
    words = rows.select(F.explode(F.split(F.lower(visible), "[^\\p{L}]+")).alias("word"))
    words = staged(words.filter(F.col("word").rlike("^[a-z]{2,24}$")).groupBy("word").agg(F.count("*").alias("n")))
    if words.count() > most:
        words = words.filter(F.col("n") > kth_largest(words, "n", most + 1))
    return {r["word"]: r["n"] for r in words.collect()}


class Segmenter:
    """Cuts a run of letters into the likeliest words under a unigram model (Viterbi). What is not in the
    vocabulary costs ten times more with each letter."""

    CACHED = 100_000

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.unknown = math.log(total) + math.log(10)
        self.seen: dict[str, list[str]] = {}

    def cut(self, run: str) -> list[str]:
        if run in self.seen:
            return self.seen[run]
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            options = [(best[start] + self.cost[word], start) for start in range(max(0, end - self.longest), end)
                       if (word := run[start:end]) in self.cost]
            options += [(best[start] + self.unknown + math.log(10) * (end - start), start)
                        for start in range(max(0, end - 24), end)]
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        words, end = [], len(run)
        while end:
            words.append(run[back[end]:end])
            end = back[end]
        if len(self.seen) >= self.CACHED:
            self.seen.clear()
        self.seen[run] = words[::-1]
        return self.seen[run]


_RUNS = re.compile(r"[a-z]+")


def _with_tokens(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``rows`` with tokens: words of the host marked h:, of the path p:."""
    names = rows.columns
    model = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segmenter(model.value)
        for batch in batches:
            tokens = [[f"{mark}:{word}" for mark, part in (("h", host), ("p", path.lower()))
                       for piece in _RUNS.findall(part) for word in cutter.cut(piece)]
                      for host, path in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(tokens, pa.list_(pa.string()))],
                                             [*names, "tokens"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join([*fields, "tokens array<string>"]))


def _buckets(number: int) -> Column:
    return F.transform("tokens", lambda t: F.pmod(F.hash(t), F.lit(number)))


def fit_bayes(rows: DataFrame, blocked: Column, number: int = 1 << 16) -> np.ndarray:
    """Multinomial naive Bayes over hashed tokens: log odds of block to allow for each bucket, the prior last. Counts of
    the buckets seen are smoothed by one; the others say nothing. All rows count; tasks send sums per bucket, so the driver gets at most ``number`` rows."""
    sums = rows.select(blocked.alias("b"), F.explode(_buckets(number)).alias("bucket")).groupBy("bucket").agg(
        F.sum(F.col("b").cast("bigint")).alias("block"), F.sum((~F.col("b")).cast("bigint")).alias("allow")).collect()
    bad, good = rows.agg(F.count_if(blocked), F.count_if(~blocked)).first()
    odds = np.append(np.zeros(number), math.log((bad + 1) / (good + 1)))
    if sums:
        where, *counts = np.array(sums, dtype=np.int64).T
        shares = np.log(np.array(counts) + 1.0) - np.log(np.array(counts).sum(axis=1, keepdims=True) + len(where))
        odds[where] = shares[0] - shares[1]
    return odds


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", text_col: str = "html",
                unwanted: tuple[str, ...] = UNWANTED) -> DataFrame:
    """``pages`` without its text column, with host, path, rule, verdict, tokens and score.

    The longest rule that fits decides. Other pages are judged by their words: names that run together in
    hosts and paths are cut by a unigram model of the pages' own visible words (all rows) and
    ``unwanted``; multinomial naive Bayes, fitted on all pages with the label block where a word is
    ``unwanted``, gives a score, the log odds of block, and a page with a positive one is blocked.

    A NULL url, or one without ://, has empty host and path and is judged by the prior alone. NULL texts
    teach no words. Rows map one to one, so repeated ids and rows stay; an empty table gives no rows. Other columns
    pass through, except those with a name of a new column.
    """
    counts = word_counts(F.col(f"`{text_col}`"), pages)
    middle = sorted(counts.values())[len(counts) // 2] if counts else 1
    counts |= {w: max(middle, counts.get(w, 0)) for w in unwanted}
    rows, back = carried(pages.drop(text_col), ("host", "path", "rule", "verdict", "tokens", "score"))
    host, path = host_and_path(F.col(back[url_col]))
    rows = rows.withColumns({"host": host, "path": path})
    rows = staged(_with_tokens(rows, counts))
    blocked = F.exists("tokens", lambda t: F.substring(t, 3, 99).isin(*unwanted))
    odds = rows.sparkSession.sparkContext.broadcast(fit_bayes(rows, blocked))
    names = rows.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["_buckets"]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            score = odds.value[-1] + np.bincount(row, weights=odds.value[lists.flatten().to_numpy()],
                                                 minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(score)], [*names, "score"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    rows = rows.withColumn("_buckets", _buckets(1 << 16)).mapInArrow(judge, ", ".join([*fields, "score double"]))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select(*[F.col(v).alias(c) for c, v in back.items()], "host", "path", rule.alias("rule"),
                       verdict.alias("verdict"), "tokens", "score")
