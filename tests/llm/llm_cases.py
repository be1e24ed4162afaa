"""Small tables with the hard cases: NULLs, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("digest", "kept", "score", "_text", "_id", "key", "keep_id", "n_lines", "file", "row", "host", "c_0")


def documents(spark, rows):
    """Documents from (doc_id, text[, lang]) with some further columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def words(seed, n):
    """Invented words of three letters and more."""
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def hard_rows():
    base = " ".join(words(1, 300))
    long = " ".join(words(2, 40_000))
    return [(1, base), (2, base), (3, None), (4, ""), (5, long), (6, " \t\n"), (7, "one"), (7, "one"), (8, "One"),
            (9, base + " tail"), (None, base), (None, None), (10, "ünï ✓ 日本 𝒳"), (11, "a\n\nb\n"), (12, "0"), (-5, "!!")]


def strip(line):
    return line.strip("\t\n\x0b\x0c\r ").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def expected_lines(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(strip(line)) >= min_chars:
                holders.setdefault(strip(line), set()).add(i)
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        stay = [p for p in parts if len(holders.get(strip(p), ())) < min_docs or len(strip(p)) < min_chars
                or i is not None and i == max(x for x in holders[strip(p)] if x is not None)]
        out.append((i, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return out
