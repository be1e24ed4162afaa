"""SentencePiece encoding that keeps source offsets, and decoding.

The normaliser is written out here: it replaces the longest prefixes found in the model's compiled
character map and records, for every byte it writes, the source byte it stands for. The
library then cuts the normalised text (its own normaliser off), and each piece is projected back through the
record to the bytes of the original text that it covers.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealstream.llm.common import slices, whole_text

SPACE = "▁".encode()  # what stands for a space inside pieces


class CharMap:
    """The compiled character map of a model: a double-array trie and the replacements it points to.

    Format (public): a 32-bit size, the trie's 32-bit units, then replacements ended by NUL. Of a
    unit, bits 0-7 are its label, bit 8 says that the key may end here, bits 10-30 are the offset to
    its children, shifted by 8 if bit 9 is set; a value unit has bit 31 set and holds a position.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size:]
        self.starts = np.zeros(256, dtype=bool)
        if self.units:
            root = self._children(self.units[0])
            for label in range(256):
                at = root ^ label
                self.starts[label] = at < len(self.units) and self.units[at] & 0x800000FF == label

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 0x200 else 0)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key that begins at ``at`` (0: none) and its replacement."""
        units, node = self.units, self._children(self.units[0])
        found, where = 0, 0
        for n in range(at, len(data)):
            label = data[n]
            node ^= label
            if node >= len(units) or units[node] & 0x800000FF != label:
                break
            unit = units[node]
            node ^= self._children(unit)
            if unit & 0x100:
                found, where = n + 1 - at, units[node] & 0x7FFFFFFF
        return found, self.texts[where:self.texts.index(b"\0", where)] if found else b""

    def apply(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bytes written, and for each of them the source byte where its unit begins."""
        source = np.frombuffer(data, dtype=np.uint8)
        place = np.arange(len(source))
        place = np.maximum.accumulate(np.where(source & 0xC0 != 0x80, place, 0))
        if not self.units:
            return source, place
        done, texts, places = 0, [], []
        for at in np.flatnonzero(self.starts[source]).tolist():
            if at < done or place[at] != at:
                continue
            length, text = self.longest(data, at)
            if length:
                texts += [source[done:at], np.frombuffer(text, dtype=np.uint8)]
                places += [place[done:at], np.full(len(text), at)]
                done = at + length
        return np.concatenate([*texts, source[done:]]), np.concatenate([*places, place[done:]])


class Encoded(NamedTuple):
    """Piece ids, and the bytes [begin, end) of the original text that each piece covers."""
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class PieceModel:
    """One SentencePiece model: ``encode`` with offsets and ``decode``."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            model = proto.ModelProto.FromString(file.read())
        if any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        rules = model.normalizer_spec
        self.prefix = rules.add_dummy_prefix
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.trim = rules.remove_extra_whitespaces
        self.escape = rules.escape_whitespaces
        self.map = CharMap(rules.precompiled_charsmap)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces = b"", False, False
        rules.escape_whitespaces = False
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN}
        self.lengths = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces])
        self.end_id = self.library.eos_id()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, a place in the source bytes."""
        data = text.encode()
        out, place = self.map.apply(data)
        end = len(data)
        if self.trim:
            shown, last = out.tobytes(), len(out)
            while shown.endswith((b" ", SPACE) if self.escape else b" ", 0, last):
                last -= 1 if shown.endswith(b" ", 0, last) else len(SPACE)
            if last < len(out):
                end = place[last]
                out, place = out[:last], place[:last]
            space = out == 0x20
            keep = ~(space & np.concatenate([[True], space[:-1]])[:len(space)])
            out, place = out[keep], place[keep]
        if len(out) == 0:
            return "", np.array([end])
        if self.prefix:
            at = len(out) if self.suffix else 0
            out, place = np.insert(out, at, 0x20), np.insert(place, at, end if self.suffix else place[0])
        if self.escape:
            times = np.where(out == 0x20, len(SPACE), 1)
            place = np.repeat(place, times)
            return out.tobytes().replace(b" ", SPACE).decode(), np.append(place, end)
        return out.tobytes().decode(), np.append(place, end)

    def encode(self, texts: list[str]) -> list[Encoded]:
        """Pieces of whole texts, each followed by the end id, which covers nothing."""
        normal = [self.normalise(t) for t in texts]
        out = []
        for (text, place), ids in zip(normal, self.cutter.encode([t for t, _ in normal], num_threads=1)):
            if self.unknown.isdisjoint(ids):
                ids = np.array(ids, dtype=np.int32)
                ends = np.cumsum(self.lengths[ids])
                begins = ends - self.lengths[ids]
            else:
                parts = self.cutter.encode(text, return_type="proto").pieces
                ids = np.array([p.id for p in parts], dtype=np.int32)
                begins, ends = np.array([p.begin for p in parts]), np.array([p.end for p in parts])
            last = place[-1]
            out.append(Encoded(np.append(ids, np.int32(self.end_id)), np.append(place[begins], last),
                               np.append(place[ends], last)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model per worker and file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def lists(model: PieceModel, found: list[Encoded]) -> list[pa.Array]:
    """Columns ids, begins and ends."""
    ends = pa.array(np.cumsum([0, *[len(e.ids) for e in found]], dtype=np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).astype(np.int32))) for c in zip(*found)]


def digests(model: PieceModel, found: list[Encoded]) -> list[pa.Array]:
    """Columns n_tokens, ids_sha256, decoded_sha256 and spans_tile: pieces cover the text without gaps or overlaps."""
    rows = []
    for e in found:
        shown = hashlib.sha256(" ".join(map(str, e.ids.tolist())).encode()).hexdigest()
        decoded = hashlib.sha256(model.decode(e.ids).encode()).hexdigest()
        tile = bool(e.begins[0] == 0 and (e.begins[1:] == e.ends[:-1]).all())
        rows.append((len(e.ids), shown, decoded, tile))
    return [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.bool_()))]


LISTS = "ids array<int>, begins array<int>, ends array<int>"
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_tile boolean"


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                     emit: Callable = lists, schema: str = LISTS) -> DataFrame:
    """doc_id, and what ``emit`` makes of each whole text's pieces in the same task: by default the piece
    ids and the original byte span of each.

    NULL text counts as empty: the end id alone. Rows map one to one, so repeated ids and rows stay,
    a NULL id stays NULL, an empty table gives no rows. Other columns are ignored. A text of any
    length is encoded whole, in memory of a few times its size. ``model`` is a path that
    every executor has.
    """
    names = ["doc_id", *[part.split()[0] for part in schema.split(", ")]]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in slices(batches, 64):
            found = pieces.encode(batch["_text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["_id"], *emit(pieces, found)], names)

    return docs.select(F.col(f"`{id_col}`").alias("_id"), whole_text(text_col).alias("_text")).mapInArrow(
        run, f"doc_id {id_type}, {schema}")


def decode_documents(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text the library's decode gives for its ids; NULL ids give empty text."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            texts = [pieces.library.decode(i) if i else "" for i in batch["_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").alias("_ids")).mapInArrow(
        run, f"doc_id {id_type}, text string")
