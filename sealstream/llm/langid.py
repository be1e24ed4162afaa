"""Language by compression: the dictionary that shortens a text most is in its language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealstream.llm.common import carried, slices

UNKNOWN = "und"
#: Bytes compressed at a time, so that a long text is judged evenly by the dictionary.
BLOCK = 4096
#: Written before each block: without it, short blocks that do not shrink would be stored as they are.
PAD = b"\n" * 64
_APART = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words with single spaces between; everything but letters is left out."""
    return _APART.sub(" ", text.lower()).strip()


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", samples: int = 64,
        chars: int = 2048) -> dict[str, bytes]:
    """A raw-content dictionary per language: blocks of ``chars`` characters of distinct texts, however many copies a text
    has, and at any place in them, ``samples`` blocks at most. Hashes choose the texts and one block of each; a language of
    fewer texts goes on with their second blocks, and so forth. That bounds a dictionary at 128 Ki characters and the driver's
    memory by the number of languages. Rows without language or text teach nothing."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    rows = rows.withColumn("_h", F.xxhash64("text"))
    hashes = rows.groupBy("lang", "_h").agg(F.count("*").alias("copies"))  # copies meet in their task
    numbers = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not numbers:
        return {}
    # about four times as many as needed, spread evenly; the window then sees a few rows per language
    share = F.create_map(*[F.lit(x) for lang, n in numbers.items() for x in (lang, min(1 << 40, (4 * samples << 40) // n))])
    few = rows.filter(F.pmod("_h", F.lit(1 << 40)) < share[F.col("lang")])
    deep = F.when(F.col("lang").isin([lang for lang, n in numbers.items() if n < samples]), samples).otherwise(1)
    places = F.sequence(F.lit(0), F.expr(f"(length(text) - 1) div {chars}").cast("int"))
    places = F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64("_h", i).alias("h"), i.alias("i"))))
    blocks = F.transform(F.slice(places, 1, deep), lambda p: F.substring("text", p["i"] * chars + 1, F.lit(chars)))
    few = few.select("lang", "_h", F.posexplode(blocks).alias("_r", "text")).distinct()
    order = Window.partitionBy("lang").orderBy("_r", F.pmod("_h", F.lit(1 << 40)), "_h", "text")
    few = few.withColumn("_k", F.row_number().over(order)).filter(f"_k <= {samples}")
    texts: dict[str, list] = {}
    for r in few.collect():
        texts.setdefault(r["lang"], []).append((r["_k"], letters(r["text"])))
    return {lang: " ".join(t for _, t in sorted(parts)).encode() for lang, parts in sorted(texts.items())}


class Classifier:
    """Compressors of one dictionary each. Languages in alphabetical order, which decides ties."""

    def __init__(self, dictionaries: dict[str, bytes]):
        setup = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=17, search_log=3, min_match=3, target_length=16,
            strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.packers = {}
        for lang, content in sorted(dictionaries.items()):
            if len(content) < 8:  # too short for a dictionary
                self.packers[lang] = zstandard.ZstdCompressor(compression_params=setup)
                continue
            ready = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            ready.precompute_compress(compression_params=setup)
            self.packers[lang] = zstandard.ZstdCompressor(dict_data=ready, compression_params=setup)

    def judge(self, text: str) -> tuple[str, float]:
        """Language and score. The score is how much shorter the best code is than the second best, as a share
        of the latter; 1 if only one language is known, 0 for unknown."""
        words = letters(text)
        if not self.packers or not any(map(str.isalpha, words)):
            return UNKNOWN, 0.0
        data = f" {words} ".encode()
        blocks = [PAD + data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(p.compress(b)) for b in blocks), lang) for lang, p in self.packers.items())
        return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
             margin: float = 0.01) -> DataFrame:
    """``docs`` with lang_pred, score and sure: score is at least ``margin``.

    Whole texts are coded, in blocks, once per language; the code lengths of all blocks are summed. NULL texts and texts
    without a letter are "und" with score 0 and not sure, and so is every text if no language was
    learned. Equal lengths go to the language first in the alphabet, with score 0. Other columns
    pass through, except those with a name of a new column.
    """
    rows, back = carried(docs, ("lang_pred", "score", "sure"))
    names, text = list(back.values()), back[text_col]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in slices(batches):
            found = [model.judge(t or "") for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])

    fields = [f"{v} {docs.schema[c].dataType.simpleString()}" for c, v in back.items()]
    out = rows.mapInArrow(
        run, ", ".join([*fields, "lang_pred string", "score double"]))
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= margin)
    return out.select(*[F.col(v).alias(c) for c, v in back.items()], "lang_pred", "score", sure.alias("sure"))
