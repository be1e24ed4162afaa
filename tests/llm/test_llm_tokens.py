"""Token ids, packing, SentencePiece and token files, against the libraries and by round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from llm_cases import documents, hard_rows
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from sealstream.llm import encoding, packing, pieces, tokens
from sealstream.llm.queries import ids_crc32

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b", "a \n b", "x\n\ny", " lead", "trail  ", "a\u0085 b", "tab\t x", "<|endoftext|> hi<|endoftext|>", "", "  ",
       "a\x1c b", "x\xa0y", "İstanbul ΑΣ ΣΑΣ b", "don't 've  's", "1 2  33\n4", "é ́x", "\r\n x", "²³ x½", "ªº µ Ĳ ĳ ŉ ſ",
       "“Q” – x… €5", "\xad soft", "A_b__c", "ÀÖØÞßÿ × ÷", "a" * 30 + " aaa", "\0 nul", "日本語 text", "▁a ▁", "鿐 ﬁ ①"]


def odd_texts(n=1500):
    rng = random.Random(4)
    letters = "ab \n'st1ÉéßŒ–́ ▁日ﬁ①𝒳"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(name):
    model, library = encoding.encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    assert model.merger is not None
    texts = odd_texts()
    for text, ids in zip(texts, model.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_unknown_tokenizer_goes_to_the_library(tmp_path):
    rules = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    rules.enable_truncation(3)
    rules.save(str(tmp_path / "t.json"))
    model = encoding.TextEncoder(str(tmp_path / "t.json"))
    assert model.merger is None
    assert len(model.encode(["one two three four five six"])[0]) == 3


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_document_pieces_and_packing(spark):
    rows = hard_rows()
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    found = packing.document_pieces(documents(spark, rows), public_tokenizers.path(FILES[0]), end_id=2, capacity=64)
    placed = packing.pack(found, capacity=64)
    got = placed.collect()
    whole = {}
    for r in got:
        assert r["length"] == len(r["ids"]) <= 64 and (r["piece"] == 0 or r["length"] == 64)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4"))
        whole.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, text in rows:
        if i not in (7, None):  # ids that repeat
            ids = library.encode(text or "", add_special_tokens=False).ids + [2]
            assert [x for _, part in sorted(whole[i]) for x in part] == ids
    assert check_places(got, 64) <= sum(r["length"] for r in got) / 64 + 2
    joined = packing.sequences(placed).collect()
    assert sum(len(r["ids"]) for r in joined) == sum(r["length"] for r in got)
    assert packing.pack(packing.document_pieces(documents(spark, []), public_tokenizers.path(FILES[0]), 2)).count() == 0


def test_packing_is_close_to_the_bound(spark):
    rng = random.Random(6)
    lengths = [min(1024, max(1, int(rng.lognormvariate(5.5, 1)))) for _ in range(20_000)] + [1024, 0, 0]
    rows = spark.createDataFrame(list(enumerate(lengths)), "sequence_id int, length int").withColumnRenamed("sequence_id", "n")
    rows = rows.withColumn("offset", F.lit("own"))
    got = packing.pack(rows, open_bins=512).collect()
    assert sorted(r["n"] for r in got) == list(range(len(lengths)))
    assert check_places(got, 1024) <= 1.01 * sum(lengths) / 1024 + 1
    assert got[0].asDict().keys() == {"n", "length", "sequence_id", "offset"}


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(7) == (0, 0) and bins.place(4) == (1, 0) and bins.place(6) == (1, 4)  # bin 1 is full now
    assert bins.place(5) == (2, 0) and bins.place(9) == (3, 0)  # the fullest open one, bin 0, closes
    assert bins.place(3) == (2, 5) and bins.place(1) == (3, 9) and bins.left_open() == [(2, 8)]


def changed_model(tmp_path, rule, trim, **other):
    model = proto.ModelProto.FromString(open(PIECES, "rb").read())
    if rule:
        rules = proto.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = trim
    for k, v in other.items():
        setattr(model.normalizer_spec, k, v)
    path = tmp_path / f"{rule}{trim}.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("rule, trim, other", [
    (None, False, {}), ("nmt_nfkc", True, {}), ("nmt_nfkc", False, {}), ("nfkc_cf", True, {}),
    ("nfkc", True, {"add_dummy_prefix": False})])
def test_pieces_and_offsets_equal_the_library(tmp_path, rule, trim, other):
    path = changed_model(tmp_path, rule, trim, **other) if rule else PIECES
    model, library = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts()
    for text, found in zip(texts, model.encode(texts)):
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        got = list(zip(found.ids.tolist(), found.begins.tolist(), found.ends.tolist()))
        assert got[:-1] == want and got[-1][0] == library.eos_id(), repr(text)


def test_sentencepiece_documents(spark):
    rows = hard_rows()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark, rows)
    full = pieces.encode_documents(docs, PIECES)
    short = pieces.encode_documents(docs, PIECES, emit=pieces.digests, schema=pieces.DIGESTS)
    text_of = {}
    for r in short.collect():
        text_of.setdefault(r["doc_id"], set()).add((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["spans_tile"]))
    for i, text in rows:
        ids = library.encode(text or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True) in text_of[i]
    decoded = pieces.decode_documents(full, PIECES)
    assert sorted(decoded.select(F.coalesce("doc_id", F.lit(-1)), "text").collect()) == sorted(
        (i or -1 if i is None else i, library.decode(library.encode(t or ""))) for i, t in rows)
    assert pieces.encode_documents(documents(spark, []), PIECES).count() == 0


def test_token_files(spark, tmp_path):
    rows = hard_rows()
    path = public_tokenizers.path(FILES[1])
    library = Tokenizer.from_file(path)
    ordered = tokens.in_order(documents(spark, rows))
    tokens.write_tokens(tokens.encode_documents(ordered, path, end_id=1), f"file://{tmp_path}/t")
    read = tokens.read_tokens(spark, f"file://{tmp_path}/t")
    got = tokens.with_starts(read, read).orderBy("start").collect()
    ids = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in ids]
    start = 0
    want = sorted((str(i), tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in got) == want
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    crc = read.mapInArrow(ids_crc32, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string, row bigint")
    assert {r["ids_crc32"] for r in crc.collect()} == {zlib.crc32(np.array(i, "<u4")) for _, i in want}
    file = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    empty = tokens.encode_documents(tokens.in_order(documents(spark, [])), path, end_id=1)
    tokens.write_tokens(empty, f"file://{tmp_path}/e")
    assert tokens.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_files_follow_their_numbers(spark):
    rows = [(f"part-{n:05d}-x.c000.zstd.parquet", k, 10 * n + k) for n in (7, 99_999, 100_000) for k in range(2)]
    table = spark.createDataFrame(rows, "file string, row bigint, n_tokens bigint")
    got = [r["n_tokens"] for r in tokens.with_starts(table, table).orderBy("start").collect()]
    assert got == [r[2] for r in rows]
