"""Token ids of whole texts, as the tokenizers library gives them for a tokenizer file.

The library decides. Texts written in Latin letters alone, the bulk of most corpora, take a shorter
way to the same ids: a byte-pair merger over the same file's vocabulary, without
the library's normalised strings and offsets. A file whose rules are not known here, a text with
any other character and a text that holds a special token all go to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The split rules of the two known kinds of tokenizer file.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters that normalisation leaves alone and that every Unicode version classes alike: ASCII, Latin letters of
#: the first two blocks without those of special lower case, digits other than 0-9, and common punctuation.
_LATIN = re.compile("[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ž"
                    "–—‘’“”…€]*")
#: WORD_PATTERN for those characters.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


class TextEncoder:
    """``encode(texts)`` gives one array of unsigned 32-bit ids per text, no special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.words = False
        self.merger = self._merger(rules)

    def _merger(self, rules: dict):
        """The short way, or None if the file's rules are not one of the two known kinds."""
        model, before = rules["model"], rules.get("pre_tokenizer") or {}
        usual = model.get("type", "BPE") == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        usual &= not (rules.get("truncation") or rules.get("padding"))
        vocab, ending = model["vocab"], model.get("end_of_word_suffix") or ""
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        merged = [vocab.get(m.replace(ending, "", m.count(ending) - 1) if ending else m, -1) for m in merged]
        usual &= all(a < b for a, b in zip([-1, *merged], merged))  # ids in the order of the merges
        if not rules.get("normalizer") and not ending:
            usual &= before.get("type") == "ByteLevel" and before.get("use_regex") is True
            usual &= not before.get("add_prefix_space")
            pattern = BYTE_PATTERN
        else:
            steps = [s.get("type") for s in (rules.get("normalizer") or {}).get("normalizers", [])]
            parts = before.get("pretokenizers") or [{}, {}]
            usual &= steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("behavior") == "Removed"
            usual &= parts[0].get("pattern") == {"Regex": WORD_PATTERN} and parts[-1].get("type") == "ByteLevel"
            pattern, self.words = r"[^\x00]+\x00", True  # a word's end is a byte that no text here holds
        if not usual:
            return None
        import tiktoken

        byte_of = _byte_letters()
        ranks = {}
        for token, i in vocab.items():
            if token in self.special:
                continue
            end = bool(ending) and token.endswith(ending)
            stem = token[:-len(ending)] if end else token
            ranks[bytes(byte_of[c] for c in stem) + b"\0" * end] = i
        if len(ranks) != len([t for t in vocab if t not in self.special]):
            return None
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if self.merger is None or not _LATIN.fullmatch(text) or any(s in text for s in self.special):
                rest.append(k)
                continue
            if self.words:
                text = "\0".join([*_WORDS.findall(text.lower()), ""])
            out[k] = self.merger.encode_to_numpy(text, disallowed_special=())
        for k, found in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(found.ids, dtype=np.uint32)
        return out


def _byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable Latin-1 bytes are themselves, the
    others follow each other from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
