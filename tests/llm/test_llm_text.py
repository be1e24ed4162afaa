"""Exact and line deduplication, quality, language and the encoders, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from llm_cases import CLASHES, documents, expected_lines, hard_rows, words
from pyspark.sql import functions as F

from sealstream.llm import exact, langid, lines, quality
from sealstream.llm.common import lookup, spread_join


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def expected_exact(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha(text)))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = hard_rows()
    # a weak digest puts different texts under one value, so content must decide
    how = {"digest": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))} if weak else {}
    got = exact.exact_dedup(documents(spark, rows), **how)
    texts = got.select("doc_id", "keep_id", "group_size", "kept").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r[:4])
    assert sorted(map(tuple, texts), key=key) == sorted([r[:4] for r in expected_exact(rows)], key=key)
    if not weak:
        assert sorted(got.select(F.lower(F.hex("digest"))).toPandas().iloc[:, 0]) == sorted(r[4] for r in expected_exact(rows))
    assert exact.exact_dedup(documents(spark, []), **how).count() == 0


def test_line_dedup(spark):
    rng = random.Random(3)
    common = [" ".join(words(s, 9))[:60] for s in range(6)]
    common += ["É" * 39 + "x", "é" * 40, "A" * 39]
    rows = []
    for i in range(60):
        parts = [rng.choice(common) if rng.random() < 0.4 else " ".join(words(100 + i, 3)) for _ in range(rng.randint(1, 12))]
        parts = [p.upper() if rng.random() < 0.2 else "\t" + p + " \r" if rng.random() < 0.2 else p for p in parts]
        rows.append((i, "\n".join(parts)))
    rows += hard_rows() + [(3, common[0]), (None, common[1]), (None, common[1]), (500, "\n".join([common[0]] * 3)),
                           (501, common[0]), (600, "\n".join(common * 3000))]
    docs = documents(spark, rows)
    got = lines.line_dedup(docs)
    assert set(CLASHES) <= set(got.columns)
    found = sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)
    assert found == sorted(expected_lines(rows), key=str)
    assert got.filter("_text <> 'own _text' OR key <> 'own key'").count() == 0
    assert lines.line_dedup(documents(spark, [])).count() == 0


def quality_rows():
    rng = random.Random(5)
    vocabulary = words(9, 400)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = " ".join(rng.choice(vocabulary) + ("!!" if bad else "") for _ in range(rng.randint(20, 120)))
        rows.append((i, text.upper() if bad else text + "."))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_keeps_good_documents(spark):
    rows, labels = quality_rows()
    rows += [(1000, None), (1001, ""), (None, rows[1][1]), (1002, " ".join(words(9, 60_000)))]
    labels += [(0, 1, 0), (None, 0, 0), (3, None, 0), (99999, 1, 1)]  # two labels for 0: the worse counts
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.resample(documents(spark, rows), table)
    assert set(CLASHES) - {"key", "kept"} <= set(got.columns) and got.count() == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[i] == (i % 5 != 0) for i in range(400))
    assert got.filter("doc_id >= 1000 AND doc_id < 1002 AND log_weight <> 0").count() == 0
    few = quality.resample(documents(spark, rows), table, keep=37)
    assert few.filter("kept").count() == 37
    assert few.filter("kept").agg(F.min("key")).first()[0] >= few.filter("NOT kept").agg(F.max("key")).first()[0]
    assert quality.resample(documents(spark, []), table).count() == 0
    assert quality.resample(documents(spark, rows), table.limit(0)).filter("NOT kept").count() == 0


def test_quality_ratio_is_that_of_the_counts(spark):
    """Log ratios against counting in Python: units seen in target and raw texts."""
    rows = [(1, "aa bb aa"), (2, "cc!"), (3, None)]
    docs = documents(spark, rows)
    ratios = quality.fit(docs, spark.createDataFrame([(1,)], "doc_id bigint"))
    bucket = lambda w: spark.range(1).select(F.hash(F.lit(w))).first()[0] % 10_007
    raw, target = 5 + 3, 5  # five n-grams in the first text, three in the second
    assert np.isclose(ratios[bucket("aa")], np.log((2 + 1) / (target + 10_007)) - np.log((2 + 1) / (raw + 10_007)))
    assert np.isclose(ratios[bucket("cc")], np.log(1 / (target + 10_007)) - np.log((1 + 1) / (raw + 10_007)))


def test_quality_equals_brute_force(spark):
    """Weights, noise, cut and sample against plain Python over the units' hashes; labelled ids on many rows count once."""
    import re

    rows, labels = quality_rows()
    rows = [(i, t) for i, t in rows[:120]] + [rows[3]] * 30 + [(900, None), (901, "!!"), (902, "one one one")]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    units = sorted({u for _, t in rows for u in re.findall(r"[^\W]+|[^\s\w]+", (t or "").lower())})
    spread = spark.createDataFrame([(u,) for u in units], "u string").select("u", F.hash("u").alias("h")).collect()
    code = {r["u"]: r["h"] for r in spread}

    def grams(text):
        found = [code[u] for u in re.findall(r"[^\W]+|[^\s\w]+", (text or "").lower())]
        pairs = [int(quality.REPEATED) if a == b else (((a * 0x2545F491 + b * 0x9E3779B1) + 2**63) % 2**64 - 2**63) >> 7
                 for a, b in zip(found, found[1:])]
        return [g % 10_007 for g in found + pairs]
    known = {r["doc_id"]: r["quality"] for r in quality.labelled(table, 50_000).collect()}
    place = {r["doc_id"]: r["p"] for r in spark.createDataFrame([(i,) for i in known], "doc_id bigint").select(
        "doc_id", F.pmod(F.xxhash64(F.lit("unseen"), "doc_id"), F.lit(4)).alias("p")).collect()}
    unseen = {i for i, q in known.items() if q <= 0 or place[i] == 0}
    raw, target = np.ones(10_007), np.ones(10_007)
    for i, text in rows:
        for g in grams(text):
            raw[g] += 1
            target[g] += i in known and i not in unseen
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = {i: sum(ratio[g] for g in grams(t)) * 100 / (len(grams(t)) + 10) for i, t in rows}
    got = quality.resample(documents(spark, rows), table).select("doc_id", "n_grams", "log_weight", "key", "kept").collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r["n_grams"] == len(grams(texts[r["doc_id"]])) and np.isclose(r["log_weight"], want[r["doc_id"]])
    cut = quality.cut_between([(want[i], int(known[i] > 0)) for i in unseen if i in want])
    keep = sum(want[i] >= cut - 1e-9 for i, _ in rows)
    last = sorted((r["key"] for r in got), reverse=True)[keep - 1]
    assert all(r["kept"] == (r["key"] >= last) for r in got)


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 5) for _ in range(3000)] + [1.0] * 500 + [float("1e300"), 5e-324, 0.0]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 3503):
        assert quality.kth_largest(rows, "x", k, few=50) == ordered[k - 1]
    assert quality.kth_largest(rows, "x", 10_000) == ordered[-1]
    assert quality.kth_largest(rows.limit(0), "x", 1) is None


TEXTS = {"en": "the quick brown fox and the lazy dog went over the hill with all of their friends because they could",
         "de": "der schnelle braune fuchs und der faule hund gingen mit ihren freunden über den hügel weil sie es konnten",
         "fr": "le rapide renard brun et le chien paresseux sont passés sur la colline avec tous leurs amis parce que"}


def language_rows():
    rng, rows = random.Random(2), []
    for k in range(240):
        lang = sorted(TEXTS)[k % 3]
        rows.append((k, " ".join(rng.choices(TEXTS[lang].split(), k=rng.randint(12, 200))), lang))
    return rows


def test_language_id(spark):
    rows = language_rows()
    known = langid.fit(documents(spark, rows[:120]), samples=20)
    assert sorted(known) == ["de", "en", "fr"]
    odd = [(1000, None), (1001, ""), (1002, "123 !!"), (None, rows[0][1]), (1003, rows[1][1].upper()), (1003, "de"),
           (1004, " ".join(rows[1][1] for _ in range(500)))]
    got = langid.classify(documents(spark, rows[120:] + odd), known)
    assert set(CLASHES) <= set(got.columns) and got.count() == 120 + len(odd)
    right = got.filter("doc_id < 1000 AND lang_pred = lang").count()
    assert right >= 118  # held out from fitting
    said = {(r["doc_id"], r["text"] is None): (r["lang_pred"], r["score"], r["sure"]) for r in got.filter("doc_id >= 1000").collect()}
    assert said[1000, True] == said[1001, False] == said[1002, False] == ("und", 0.0, False)
    assert said[1004, False][0] == rows[1][2]
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert langid.classify(documents(spark, rows), {}).filter("lang_pred <> 'und'").count() == 0
    assert langid.fit(documents(spark, [(1, None, "en"), (2, "x", None)])) == {}
    assert langid.classify(documents(spark, []), known).count() == 0


def test_language_learns_from_distinct_texts(spark):
    rows = [(k, f"{text} {' '.join(words(k, 30))}", lang) for k, (_, text, lang) in enumerate(language_rows())]
    hot = [(1000 + k, "boilerplate", "en") for k in range(20_000)]
    hot += [(30_000 + k, text, lang) for _, text, lang in rows[:120] if lang == "de" for k in range(100)]
    alone = langid.fit(documents(spark, [*rows, (1000, "boilerplate", "en")]), samples=8)
    known = langid.fit(documents(spark, rows + hot), samples=8)
    assert known == alone
    for lang, content in known.items():
        assert sum(langid.letters(t) in content.decode() for _, t, name in rows + hot[:1] if name == lang) == 8


def test_language_learns_beyond_a_common_header(spark):
    header = " ".join(words(3, 600))
    long = [(k, f"{header} {text} " * (k < 120) + " ".join([text] * 12), lang) for k, text, lang in language_rows()]
    known = langid.fit(documents(spark, long[:120]), samples=20)
    got = langid.classify(documents(spark, long[120:]), known)
    assert got.filter("lang_pred = lang AND sure").count() >= 118
    book = " ".join(words(4, 4000))
    one = langid.fit(documents(spark, [(1, book, "xx"), (2, book, "xx")]), samples=64)["xx"].decode()
    assert len(set(book.split()) - set(one.split())) <= len(book) // 2048  # words that blocks divide
    some = langid.fit(documents(spark, [(1, book, "xx")]), samples=3)["xx"].decode()
    assert len(some) <= 3 * 2049 and len(set(some.split()) - set(book[:3 * 2048].split())) > 100


def test_equal_code_lengths_go_to_the_first_language():
    same = " ".join(words(3, 300)).encode()
    model = langid.Classifier({"zz": same, "aa": same, "mm": " ".join(words(4, 300)).encode()})
    assert model.judge(" ".join(words(3, 40))) == ("aa", 0.0)
    lang, score = langid.Classifier({"aa": same, "mm": " ".join(words(4, 300)).encode()}).judge(" ".join(words(4, 60)))
    assert lang == "mm" and 0 < score < 1


def test_lookup_and_spread_join(spark):
    rows = spark.createDataFrame([(k % 7 if k > 400 else 1, k) for k in range(600)] + [(None, -1)], "k int, v int")
    dim = rows.filter("k IS NOT NULL AND k <> 3").groupBy("k").agg(F.count("*").alias("n"))
    for parts in (1, 3, 10_000):
        got = lookup(rows, dim, ["k"], "n", ["v"], parts=parts)
        want = rows.join(dim, "k", "left").select("k", "v", "n")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for parts in (2, 10, 1000):
        got = spread_join(rows, rows, dim, "k", "v", parts=parts)
        assert got.count() == rows.join(dim, "k").count() == got.distinct().count()
