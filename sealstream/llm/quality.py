"""Quality by importance resampling: how much likelier is a text under the target's model than under the raw corpus?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.llm.common import carried, kth_largest, slices, whole_text
from sealstream.operators.plan import staged

#: Words and runs of other marks, as n-gram units.
UNITS = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]+"
#: Stands for a word that repeats the one before it, in place of the pair itself.
REPEATED = np.int64(0x5EED)


def _grams(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the hashed unigrams and bigrams of a batch, and the row of each."""
    lists = batch["_hashes"]
    ends = lists.offsets.to_numpy()
    flat, ends = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.int64), ends - ends[0]
    rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    inside = rows[1:] == rows[:-1]
    a, b = flat[:-1][inside], flat[1:][inside]
    pairs = np.where(a == b, REPEATED, (a * 0x2545F491 + b * 0x9E3779B1) >> 7)
    return np.concatenate([flat % buckets, pairs % buckets]), np.concatenate([rows, rows[1:][inside]])


def _units(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with a hash of each unit of the lower-cased whole text."""
    units = F.regexp_extract_all(F.lower(whole_text(text_col)), F.lit(UNITS), F.lit(0))
    return docs.withColumn("_hashes", F.transform(units, lambda u: F.hash(u)))


def fit(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = 10_007) -> np.ndarray:
    """Log ratio of target to raw probability for each n-gram bucket.

    The raw model counts every document; the target model those whose id is in ``target``, a bounded
    table of ids that is broadcast. Each task counts its rows and sends one row
    per bucket; the driver gets one row per bucket. Counts are smoothed by one.
    """
    rows = _units(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), "_text")
    good = target.select(F.col(f"`{id_col}`").alias("_id"), F.lit(True).alias("_good")).distinct()
    rows = rows.join(F.broadcast(good), "_id", "left").select("_hashes", F.coalesce("_good", F.lit(False)).alias("_good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, picked = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            grams, row = _grams(batch, buckets)
            raw += np.bincount(grams, minlength=buckets)
            picked += np.bincount(grams[batch["_good"].to_numpy(zero_copy_only=False)[row]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(picked)],
                                         ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, picked = np.ones(buckets), np.ones(buckets)
    for bucket, a, b in sums:
        raw[bucket] += a
        picked[bucket] += b
    return np.log(picked / picked.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          seed: int = 1, per: int = 100, prior: int = 10) -> DataFrame:
    """``docs`` with n_grams, log_weight (the mean log ratio of its n-grams and of ``prior`` neutral ones, for
    ``per`` of them: length alone neither lifts nor sinks a text, and a few words prove little) and
    key, log_weight plus Gumbel noise drawn from a hash of id, text and ``seed``."""
    rows, back = carried(docs, ("n_grams", "log_weight", "key"))
    noise = F.xxhash64(F.lit(seed), back[id_col], whole_text(back[text_col]))
    uniform = (F.shiftrightunsigned(noise, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = _units(rows.withColumn("_noise", -F.log(-F.log(uniform))), back[text_col])
    names, buckets = list(back.values()), len(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, row = _grams(batch, buckets)
            number = np.bincount(row, minlength=batch.num_rows)
            weight = np.bincount(row, weights=ratios[grams], minlength=batch.num_rows)
            weight = weight * per / (number + prior)
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], pa.array(number), pa.array(weight),
                 pa.array(weight + batch["_noise"].to_numpy())], [*names, "n_grams", "log_weight", "key"])

    fields = [f"{v} {docs.schema[c].dataType.simpleString()}" for c, v in back.items()]
    out = rows.select(*names, "_noise", "_hashes").mapInArrow(
        score, ", ".join([*fields, "n_grams bigint", "log_weight double", "key double"]))
    return out.select(*[F.col(v).alias(c) for c, v in back.items()], "n_grams", "log_weight", "key")


def cut_between(scores: list[tuple[float, int]]) -> float:
    """The value that best parts good (1) from bad (0) scores: the middle of the best gap, where
    the share of good ones above less that of bad ones above is largest. Without bad ones: minus infinity."""
    good, bad = sum(q for _, q in scores), sum(1 - q for _, q in scores)
    if not bad or not good:
        return float("-inf")
    best, cut, below, seen = 0.0, float("-inf"), 0, 0
    ordered = sorted(scores)
    for (x, q), (y, _) in zip(ordered, [*ordered[1:], (ordered[-1][0] + 1, 1)]):
        below, seen = below + (1 - q), seen + q
        if y > x and below / bad - seen / good > best:
            best, cut = below / bad - seen / good, (x + y) / 2
    return cut


def labelled(labels: DataFrame, most: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One label per id, the worse if they differ, of about ``most`` ids at most, chosen by a hash.
    The result is bounded and may be broadcast."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    number = max(1, rows.count())
    rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < min(1 << 30, (most << 30) // number))
    return rows.groupBy(id_col).agg(F.min(label_col).alias(label_col))


def resample(docs: DataFrame, labels: DataFrame, keep: int | None = None, id_col: str = "doc_id",
             text_col: str = "text", most_labels: int = 50_000, seed: int = 1) -> DataFrame:
    """``docs`` with n_grams, log_weight, key and kept: a sample of the documents by importance.

    Two generative models of hashed uni- and bigrams are fitted, one on documents labelled good, one on
    all documents. The log of their ratio over a whole text, plus Gumbel noise, ranks documents, and the
    ``keep`` largest stay, which is a sample without replacement by importance weight. By default
    ``keep`` is the estimated number of good documents: those with a log weight above the value
    that best parts good from bad ones among labels the target model has not seen, a quarter of
    the good and all bad ones; an id on several rows counts once, with its least weight. At most about ``most_labels`` labels are used. Ties at the last place all stay.

    NULL or empty text has log weight 0. NULL ids are scored and never labelled. Rows that repeat are scored
    alike. Without labels, or without bad ones, every document stays. Other columns pass
    through, except those with a name of a new column. The result is staged once in the shared folder.
    """
    known = labelled(labels.select(F.col("doc_id").alias(id_col), "quality"), most_labels, id_col)
    unseen = (F.col("quality") <= 0) | (F.pmod(F.xxhash64(F.lit("unseen"), id_col), F.lit(4)) == 0)
    ratios = fit(docs, known.filter(~unseen), id_col, text_col)
    rows = staged(weigh(docs.drop("kept"), ratios, id_col, text_col, seed))
    if keep is None:
        # One log weight per labelled id, however many rows it has: the labels bound what is collected.
        judged = rows.select(id_col, "log_weight").join(F.broadcast(known.filter(unseen)), id_col).groupBy(id_col).agg(
            F.min("log_weight").alias("log_weight"), F.min("quality").alias("quality"))
        cut = cut_between([(r.log_weight, int(r.quality > 0)) for r in judged.select("log_weight", "quality").collect()])
        keep = rows.filter(F.col("log_weight") >= cut).count()
    last = kth_largest(rows, "key", keep)
    return rows.withColumn("kept", F.col("key") >= F.lit(last) if last is not None else F.lit(False))
