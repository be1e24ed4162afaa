"""Lexical search, hard negatives and repeated strings, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import documents, hard_rows, words
from pyspark.sql import functions as F

from sealstream.llm import lexical, negatives, suffixes
from sealstream.operators.plan import staged

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_ranking(docs, items, k):
    held = [(i, terms(t)) for i, t in docs if i is not None]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(text))
    out = set()
    for i, own in asked.items():
        scored = []
        for d, t in held:
            m = 50 + (50 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10 ** 9 * t.count(x)) // (1000 * t.count(x) + 20 * m))
                    for x in own if x in t)
            if s > 0:
                scored.append((-s, d))
        out |= {(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("shard", [300, 4000, 1 << 20])
def test_search_equals_brute_force(spark, shard):
    rng = random.Random(5)
    vocabulary = words(4, 60) + ["É", "éa", "日本", "x1"]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(i, " ".join(rng.choices(vocabulary, weight, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(250)]
    rows += [(i, rows[7][1]) for i in range(300, 360)] + [r for r in hard_rows() if r[0] != 5]
    items = [(k, " ".join(rng.choices(vocabulary, weight, k=6)).upper() + "-" + rng.choice(vocabulary)) for k in range(20)]
    items += [(40, None), (41, ""), (42, "nothinglikeit"), (None, rows[0][1]), (3, "one"), (43, " ".join(vocabulary))]
    index = staged(lexical.build_index(documents(spark, rows).repartition(3), shard_bytes=shard))
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit("own"))
    got = lexical.search(index, asked, k=10, lot_terms=40, first=2)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute_ranking(rows, items, 10)


def test_search_of_nothing(spark):
    none = documents(spark, [(1, None), (None, "word"), (2, "-.-")])
    items = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    assert lexical.search(staged(lexical.build_index(none)), items).count() == 0
    some = staged(lexical.build_index(documents(spark, [(1, "word"), (2, "other"), (3, "other")])))
    assert lexical.search(some, items.limit(0)).count() == 0
    assert [r["doc_id"] for r in lexical.search(some, items).collect()] == [1]


def test_blocks_round_trip_and_are_rejected_unread():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) + 5])
    data, at = lexical.packed(values)
    assert lexical.unpacked(data).tolist() == values.tolist() and at[-1] == len(data)
    texts = pa.array(["rare common"] + ["common"] * 2000 + ["filler"] * 100)
    rows = pa.Table.from_batches([lexical._shard_rows(0, np.arange(len(texts)), texts)])
    rows = rows.filter(pa.compute.is_in(rows["term"], pa.array([b"rare", b"common", b""])))
    shard = lexical._Shard(rows, len(texts), 2102)
    names = rows["term"].to_pylist()
    read = []
    decoded = shard._decoded
    shard._decoded = lambda k, a, b: (read.append((names[k], b - a)), decoded(k, a, b))[1]
    ids, _ = shard.best([(names.index(b"rare"), 7000), (names.index(b"common"), 50)], 1, 1)
    assert ids.tolist() == [0] and read == [(b"rare", 1), (b"common", 1)]  # one block of sixteen


def brute_negatives(rows, positives=5, negatives_=10):
    good = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or None in v or not np.isfinite(v).all():
            continue
        if i not in good or (label, v) < good[i]:
            good[i] = (label, v)
    q = {i: (label, [math.floor(256 * c) for c in v]) for i, (label, v) in good.items()}
    out = set()
    for a, (label, x) in q.items():
        if a % 100:
            continue
        score = {i: sum(s * t for s, t in zip(x, y)) for i, (_, y) in q.items() if i != a}
        own = sorted((-s, i) for i, s in score.items() if q[i][0] == label)[:positives]
        for s, p in own:
            ps = -s
            fits = sorted((-t, i) for i, t in score.items() if q[i][0] != label and 30 * ps <= 100 * t <= 90 * ps)
            out |= {(a, p, r + 1, i, ps, -t) for r, (t, i) in enumerate(fits[:negatives_])}
    return out


@pytest.mark.parametrize("kind", ["unit", "lengths", "sparse", "large"])
def test_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.lognormal(size=(700, 1))
    if kind == "sparse":
        x *= rng.random(size=x.shape) < 0.2
    if kind == "large":
        x *= 1e6
    rows = [(i, int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)]
    rows[200:260] = [(i, 1, rows[100][2]) for i in range(200, 260)]  # copies, an anchor among them
    rows[300:330] = [(i, 2, rows[100][2]) for i in range(300, 330)]
    rows += [(1000, None, rows[0][2]), (1100, 1, None), (1200, 1, [None] * 24), (1300, 1, [float("nan")] * 24), (None, 1, rows[0][2]),
             (1400, 9, rows[5][2]), (1500, 3, [0.0] * 24), (1600, 2, rows[6][2][:7]), (1700, 2, [float("inf")] * 24), (1800, 1, []),
             (100, 0, rows[100][2]), (100, 3, rows[100][2])]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("win", F.lit("own"))
    got = negatives.mine(table, F.col("vec_id") % 100 == 0, block=128, lot=4)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == names
    found = [tuple(r) for r in got.collect()]
    want = brute_negatives(rows)
    assert len(found) == len(want) and set(found) == want


def test_negatives_of_none(spark):
    schema = "vec_id bigint, label int, embedding array<float>"
    one = spark.createDataFrame([(0, 1, [1.0, 0.0])], schema)
    assert negatives.mine(one, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(one.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    far = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0]), (2, 2, [1.0])], schema)
    assert negatives.mine(far, F.col("vec_id") % 100 == 0).count() == 0


def test_index_omits_what_norms_cover():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 32)) * np.linspace(1, 40, 32)).astype(np.int64)
    q = x[:10]
    norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    least = (0.6 * norms[:10] * norms.max()).astype(np.int64)
    index = negatives.ThresholdIndex(x, float((least / norms[:10]).min()), np.float64)
    assert index.begin.max() > 0
    row, col, score = index.matches(q, least)
    full = q @ x.T
    assert {(int(a), int(b)) for a, b in zip(row, col)} == {(a, b) for a, b in zip(*map(list, np.nonzero(full >= least[:, None])))}
    assert (full[row, col] == score).all()


def brute_spans(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    times = {}
    for t in texts:
        for a in range(len(t) - length + 1):
            times[t[a:a + length]] = times.get(t[a:a + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if times[t[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most, batch_bytes", [(50_000, 8 << 20), (3, 4000)])
@pytest.mark.parametrize("length", [40, 200])
def test_repeated_spans_equal_brute_force(spark, length, most, batch_bytes):
    rng = random.Random(length)
    vocabulary = words(9, 400) + ["é", "日本語", "𝒳y"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = [text(60) for _ in range(6)]
    rows = [(i, text(rng.choice([0, 3, 30, 120]))) for i in range(60)]
    for i in range(60, 140):
        parts = [text(rng.choice([0, 2, 20]))]
        for _ in range(rng.randint(1, 3)):
            passage = rng.choice(shared)
            if rng.random() < 0.6:  # edited copies: edges at any place
                k = rng.randrange(len(passage))
                passage = passage[:k] + rng.choice(["", "#", "zz"]) + passage[k + 1:]
            parts += [passage[rng.randint(0, 30):], text(rng.choice([0, 1, 15]))]
        rows.append((i, " ".join(parts)))
    rows += [(200, "a" * 700), (201, "a" * 199), (202, "b" + "a" * 230), (203, "ab" * 300), (204, "x" + "ab" * 90), (205, "abc" * 150),
             (206, rows[80][1]), (207, rows[80][1]), (207, rows[80][1]), (208, rows[81][1] * 2), (209, "\0" * 450 + "\0a" * 40),
             (210, None), (None, rows[81][1]), (None, None), (211, ""), (212, "q" * length), (213, "q" * length),
             (214, shared[0] + shared[0][:260]), (215, "tail " + shared[1][-length:]), (216, shared[1][:length] + " head")]
    got = suffixes.repeated_spans(documents(spark, rows).repartition(4), length=length, most=most, together=100,
                                  batch_bytes=batch_bytes)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute_spans(rows, length)))


def test_repeated_spans_of_none_and_long_texts(spark):
    assert suffixes.repeated_spans(documents(spark, [(1, "x")]).limit(0)).count() == 0
    rows = [r for r in hard_rows()] + [(50, "before " + hard_rows()[4][1][1000:3000] + " after")]
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.repeated_spans(documents(spark, rows)).collect()}
    assert got[50] == 2000 and got[5] == 2000 and got[3] == 0 and got[11] == 0
