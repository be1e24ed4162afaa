"""Registered queries over the given tables, and their DuckDB texts where SQL can say the same."""

from __future__ import annotations

import uuid
import zlib
from functools import wraps

import pyarrow as pa
from pyspark.sql import functions as F

from sealstream import ship
from sealstream.llm import ann, exact, langid, lexical, lines, minhash, negatives, packing, pieces, quality, suffixes, tokens, urls
from sealstream.llm.common import table, vocabulary
from sealstream.operators.plan import shared_folder, staged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op5_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op5_exact_dedup(spark, sf_dir):
    groups = exact.exact_dedup(table(spark, sf_dir, "documents"))
    return groups.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line),
frequent AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.k IS NOT NULL AND doc_id <> keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL OR doc_id = keep), ''))
         AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id"""


@query("op6_line_dedup", LINES_SQL)
def op6_line_dedup(spark, sf_dir):
    rows = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    pieces = packing.document_pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2,
                                     keep_ids=False)
    return packing.pack(pieces, capacity=1024)


def ids_crc32(batches):
    """Digest of each row's ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        lists = batch["ids"]
        flat, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["n_tokens"], pa.array(crc, pa.int64()), batch["file"], batch["row"]],
            ["doc_id", "n_tokens", "ids_crc32", "file", "row"])


@query("op7_token_output")
def op7_token_output(spark, sf_dir):
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = tokens.in_order(table(spark, sf_dir, "documents"))
    tokens.write_tokens(tokens.encode_documents(rows, vocabulary("word_bpe_49k.json"), end_id=1), path)
    read = tokens.read_tokens(spark, path)
    digests = read.mapInArrow(ids_crc32, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string, row bigint")
    return tokens.with_starts(digests, read).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"),
                                   emit=pieces.digests, schema=pieces.DIGESTS)


@query("op2_quality_resampling")
def op2_quality_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.resample(docs.withColumnRenamed("doc_id", "id"), table(spark, sf_dir, "labels"), id_col="id")
    return rows.select(F.col("id").alias("doc_id"), "n_grams", "log_weight", "key", "kept")


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = langid.fit(docs.filter(rest != 1).select("text", "lang"))
    rows = langid.classify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "sure")


@query("op10_minhash")
def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query("op1_nearest_vectors")
def op1_nearest_vectors(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op8_url_filter")
def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


LEXICAL_SQL = r"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
posting AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY doc_id, term),
sized AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM posting GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
weighted AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM posting, whole GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weighted USING (term) JOIN posting USING (term) JOIN sized USING (doc_id), whole
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""


@query("op13_lexical_search", LEXICAL_SQL)
def op13_lexical_search(spark, sf_dir):
    index = staged(lexical.build_index(table(spark, sf_dir, "documents")))
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=50)


NEGATIVES_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND vec_id NOT IN (SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)
                       WHERE x IS NULL OR NOT isfinite(x))),
part AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos,
         floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM good),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS score
  FROM part a JOIN part b ON a.pos = b.pos AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
  GROUP BY a.vec_id, b.vec_id, a.label, b.label),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positive JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM ranked WHERE rank <= 10"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark, sf_dir):
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"), length=200)
