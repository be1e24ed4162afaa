"""Nearest vectors, near duplicates, components, URLs and the pipeline, against brute force."""

import random
import re

import numpy as np
import pytest
from llm_cases import CLASHES, documents, expected_lines, hard_rows, words
from pyspark.sql import functions as F

import corpus_pipeline
from sealstream.llm import ann, components, minhash, urls


def brute_nearest(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v
              and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            scored = sorted((-float((q * x).sum()), j) for j, x in usable if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_nearest_vectors(spark, unit):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.2, 3, size=(500, 1)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    rows[100:180] = [(i, rows[40][1]) for i in range(100, 180)]  # many copies: ties, among them queries
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [None] + [1.0] * 15), (1060, [float("nan")] * 16), (1080, [1.0] * 3),
             (1100, [float("inf")] * 16), (None, rows[3][1]), (20, rows[20][1])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("own"))
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, k=5, tables=12, probes=12, block=32).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute_nearest(rows[:-1], 5)
    assert got.keys() == want.keys()
    hits = 0
    for i, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        hits += len({j for j, _ in found.values()} & {j for j, _ in want[i]})
        order = [(-s, j) for _, (j, s) in sorted(found.items())]
        assert order == sorted(order)
        vectors = dict(rows[:500])
        assert all(abs(s - np.dot(vectors[i], vectors[j])) < 1e-12 * (1 + abs(s)) for j, s in found.values())
    assert hits >= 0.95 * 5 * len(want)
    assert not unit or [j for _, (j, _) in sorted(got[40].items())] == [100, 101, 102, 103, 104]


def test_nearest_vectors_of_few_or_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0])], schema)
    got = ann.search(few, F.col("vec_id") % 20 == 0, k=20, probes=8).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert ann.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("lengths", ["outlier", "lognormal", "uniform", "long ones"])
def test_nearest_vectors_of_differing_lengths(spark, lengths):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "long ones":  # the nearest are all among 1,100 of one range
        scale = np.where(np.arange(2400) % 24 < 11, 10, 1)
    else:
        scale = {"outlier": np.r_[100, np.ones(2399)], "lognormal": np.exp(rng.normal(size=2400)),
                 "uniform": rng.uniform(0.5, 1.5, size=2400)}[lengths]
    x = (x * scale[:, None]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x[::20].astype(float) @ x.astype(float).T
    scores[np.arange(120), np.arange(0, 2400, 20)] = -np.inf
    want = {i * 20: set(np.argsort(-s)[:20].tolist()) for i, s in enumerate(scores)}
    assert all(len(got[i]) == 20 for i in want)
    assert sum(len(got[i] & want[i]) for i in want) >= 0.95 * 20 * len(want)


def test_nearest_vectors_beyond_the_probes(spark):
    def search(x):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
        got = {}
        for r in ann.search(rows, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        return got

    def want(x, i):
        scores = x.astype(float) @ x[i].astype(float)
        return [j for j in np.argsort(-scores, kind="stable").tolist() if j != i][:20]

    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    few = {i: want(x, i) for i in (0, 20)}
    assert search(x) == few
    x = rng.normal(size=(1500, 64)).astype(np.float32) * np.float32(0.02)
    x[:, 0] += 1
    x[[0, 700]] *= -1  # queries turned away from all others
    got = search(x)
    assert len(got) == 75 and all(len(found) == 20 for found in got.values())
    assert all(got[i] == want(x, i) for i in (0, 700))


@pytest.mark.parametrize("dimensions, lengths", [(64, "unit"), (256, "unit"), (64, "lognormal"), (256, "lognormal")])
def test_hashing_finds_the_nearest_and_scores_few(spark, dimensions, lengths):
    """Recall as measured against brute force, and how much of the table was looked at for it, at 64 dimensions."""
    n = 12_000
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, dimensions))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = (x * (np.exp(0.3 * rng.normal(size=(n, 1))) if lengths == "lognormal" else 1)).astype(np.float32)
    x[5000:5400] = x[7] + rng.normal(size=(400, dimensions)).astype(np.float32) * 0.02  # a full bucket
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 400 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x[::400].astype(float) @ x.astype(float).T
    scores[np.arange(30), np.arange(0, n, 400)] = -np.inf
    want = [set(np.argsort(-s)[:20].tolist()) for s in scores]
    assert sum(len(got[400 * i] & w) for i, w in enumerate(want)) >= 0.9 * 20 * 30
    if (dimensions, lengths) == (64, "unit"):
        hasher = ann.CrossPolytope(64, 10)
        near = np.array([sorted(w) for w in want]).ravel()
        limit = int(np.quantile(hasher.ranks(x[np.repeat(np.arange(0, n, 400), 20)], x[near]), 0.97)) + 1
        codes, seen = hasher.codes(x), np.zeros((30, n), bool)
        for t, probes in enumerate(hasher.probes(x[::400], limit)):
            for i, own in enumerate(probes):
                seen[i] |= np.isin(codes[:, t], own)
        assert seen.mean() < 0.4


def test_probes_come_in_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 16)).astype(np.float32)
    hasher = ann.CrossPolytope(16, 3)
    for (a, b), found in zip(hasher.rotated(x), hasher.probes(x, 200)):
        sums = (a[:, :, None] + b[:, None, :]).reshape(6, -1)
        taken = np.take_along_axis(sums, found, 1)
        assert (np.diff(taken, axis=1) <= 0).all() and np.allclose(np.sort(taken, 1), np.sort(sums, 1)[:, -200:])
    ranks = hasher.ranks(x, x)
    assert (ranks == 0).all()


def test_hadamard_keeps_length():
    x = np.random.default_rng(1).normal(size=(5, 32)).astype(np.float32)
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x, atol=1e-5)


def brute_components(rows, size, percent):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        n = min(size, len(w))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and (rows[a][0] == rows[b][0] or sets[a] and sets[b] and 100 * len(
                    sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows)]


def near_rows(seed=8):
    """Families of near copies around the threshold, chains, copies, and a passage that many texts share."""
    rng, rows, i = random.Random(seed), [], 0
    passage = words(77, 40)
    for family in range(8):
        base = words(seed * 100 + family, rng.randint(30, 120))
        last = base
        for _ in range(rng.randint(2, 22)):
            text = list(last if family % 3 == 0 else base)
            for _ in range(rng.randint(0, max(1, len(text) // 9))):
                text[rng.randrange(len(text))] = words(rng.random(), 1)[0]
            last = text
            rows.append((i := i + 1, " ".join(text if rng.random() < 0.8 else [t.upper() for t in text])))
    for k in range(40):
        rows.append((i := i + 1, " ".join(words(9000 + k, rng.randint(5, 60)) + passage)))
    rows += [(i + 1 + k, rows[5][1]) for k in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = near_rows() + [(5000 + (i or 0), t) for i, t in hard_rows() if i not in (7, None)]
    rows += [(None, rows[0][1]), (None, None), (6000, rows[1][1]), (6000, "another text of the same document id")]
    got = minhash.near_duplicates(documents(spark, rows), size=size)
    want = brute_components(rows, size, 80)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    found = got.select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert got.filter("kept <> (doc_id <=> component_id)").count() == 0


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    got = minhash.near_duplicates(documents(spark, [(1, None), (2, ""), (2, ""), (3, "a")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2 ** 63, 1200).astype(np.uint64)
    for share in (200, 800):
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - share:1200])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        said = (minhash.signature(a, 2048) == minhash.signature(b, 2048)).mean()
        assert abs(said - exact) < 0.04


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 120)] + [(1000, k) for k in range(2000, 2300)] + [(7000, 7000)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    rng.shuffle(edges)
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block")]


def brute_rule(url):
    match = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (match[1], match[2]) if match else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_filter(spark):
    given = ["http://a.example.com/en/1?x#y", "https://www.example.com/en/2", "HTTP://M.WWW.Example.COM/en/", "http://example.com",
             "http://x.net/es/1", "http://notnet/es/", "a://b://c/d", "nothing", "", None, "http://h?q=/en/", "ftp://É.com/ü"]
    given += [f"http://blog.green{w}.org/en/{k}" for k, w in enumerate(["garden", "meadow", "river", "forest"] * 10)]
    given += [f"http://{w}.info/de/{k}" for k, w in enumerate(["cheappills", "casinowin", "spamfarm"] * 5)]
    html = "<html><script>var porn=1</script><p>the green garden meadow river forest farm win cheap</p></html>"
    rows = [(k, u, html if k % 3 else None) for k, u in enumerate(given)] + [(3, given[3], html), (None, given[0], html)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("own"))
    got = urls.filter_urls(table, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        if verdict:
            assert r["verdict"] == verdict
        elif "green" in host or host.endswith(".info"):
            assert r["verdict"] == ("block" if host.endswith(".info") else "allow"), r
    words_of = {r["host"]: r["tokens"] for r in got}
    assert words_of["cheappills.info"][:2] == ["h:cheap", "h:pills"]
    assert words_of["blog.greengarden.org"][1:3] == ["h:green", "h:garden"]
    assert urls.filter_urls(table.limit(0), RULES).count() == 0


def test_vocabulary_is_bounded(spark):
    rows = spark.createDataFrame([("aa " * 5 + "bb " * 3 + "cc " * 3 + "dd " * 2 + "e éé <b>xx</b>",)], "html string")
    everything = {"aa": 5, "bb": 3, "cc": 3, "dd": 2, "xx": 1}
    assert urls.word_counts(F.col("html"), rows) == everything
    assert urls.word_counts(F.col("html"), rows, most=3) == {"aa": 5, "bb": 3, "cc": 3}
    assert urls.word_counts(F.col("html"), rows, most=2) == {"aa": 5}


def test_segmenter_against_all_cuts():
    cutter = urls.Segmenter({"a": 5, "ab": 9, "abc": 2, "c": 7, "bca": 3, "ca": 1})

    def cost(parts):
        return sum(cutter.cost.get(p, cutter.unknown + np.log(10) * len(p)) for p in parts)

    for text in ("abca", "abcabc", "xabx", "ccab", "bcaab"):
        cuts = [[text[a:b] for a, b in zip((0, *at), (*at, len(text)))] for at in (
            [k + 1 for k in range(len(text) - 1) if bits >> k & 1] for bits in range(1 << len(text) - 1))]
        assert np.isclose(cost(cutter.cut(text)), min(map(cost, cuts)))


def pipeline_tables(spark, folder):
    """Good texts of three languages, junk, texts without letters, shared lines, copies and near copies."""
    rng = random.Random(11)
    vocabulary = {"en": words(1, 150), "de": [w + "ß" for w in words(2, 150)], "fr": ["é" + w for w in words(3, 150)]}
    shared = " ".join(words(4, 12))
    rows, labels = [], []
    for i in range(210):
        lang = sorted(vocabulary)[i % 3]
        text = ". ".join(" ".join(rng.choice(vocabulary[lang]) for _ in range(9)) for _ in range(rng.randint(4, 14)))
        if i % 7 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 10 == 1:
            text += "\n" + shared
        rows.append((i, text, lang))
        if i % 2 == 0:
            labels.append((i, int(i % 7 != 0), 0))
    near = [(300 + k, rows[2 + k][1] + " " + words(k, 1)[0], rows[2 + k][2]) for k in range(20) if (2 + k) % 7 and (2 + k) % 10 != 1]
    copies = [(400 + k, rows[4][1], rows[4][2]) for k in range(6)]
    rows += near + copies + [(500, None, "en"), (501, "", None), (502, "12 34", None), (503, rows[8][1], None)]
    docs = documents(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, shared


def test_pipeline(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, shared = pipeline_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, folder).write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        assert at.columns == docs.columns and at.schema == docs.schema
        assert at.filter("key <> 'own key' OR kept <> 'own kept' OR c_0 <> 'own c_0'").count() == 0
        seen[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    good = [(i, t) for i, t, _ in rows if i >= 210 or i % 7]
    text_of = dict(good)
    assert seen["quality_classifier"] == text_of
    clear = {i: t for i, t in good if re.search("[a-z]", t or "")}
    assert seen["language_id"] == clear
    lines_gone = {i: t for i, _, _, t in expected_lines(sorted(clear.items()))}
    assert sum(shared in t for t in lines_gone.values()) == 1
    assert seen["line_dedup"] == lines_gone
    assert spark.read.parquet(f"{folder}/line_dedup").filter("n_chars <> length(text)").count() == 0
    linked = brute_components(sorted(lines_gone.items()), 5, 80)
    assert seen["near_dedup"] == {i: lines_gone[i] for i, _, c in linked if i == c}
    want = {r["doc_id"]: 0 for r in at.collect()}
    for r in corpus_pipeline.run(spark, folder).collect():
        want[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 1024
    assert all(want.values()) and len(want) == len(seen["near_dedup"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert set(CLASHES) <= set(spark.read.parquet(f"{folder}/documents.parquet").columns)
