"""Token ids of whole texts, as little-endian 32-bit bytes, by a tokenizer file of the tokenizers library.

The file's own normalisation and splitting pattern give the words of a text; the library's model encodes each different
word once, and a bounded table keeps its ids.  Files of another kind, texts with a special token's string and texts with
characters whose lower case depends on their neighbours are encoded whole by the library.  The ids are the library's always.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex

END_ID = 1
# Fixed value: the pattern that a byte-level pre-tokenizer of the library splits by.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class _Words(dict):
    """Ids of words.  When `most` are held, those not asked for since the last time go, so memory is bounded."""

    def __init__(self, model, most: int):
        super().__init__()
        self.model, self.most, self.old = model, most, {}
        self.letters = byte_letters()
        self.ascii = {b: c for b, c in enumerate(self.letters[:128])}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            spelt = word.translate(self.ascii) if word.isascii() else "".join([self.letters[b] for b in word.encode("utf-8")])
            ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str, most: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [spec["normalizer"]] if spec.get("normalizer") else [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])
        self.pattern, self.lower = None, "Lowercase" in normal
        if not normal and len(before) == 1 and before[0].get("use_regex") and not before[0].get("add_prefix_space"):
            self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        elif (normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in before] == ["Split", "ByteLevel"] and before[0]["invert"]
              and before[0]["behavior"] == "Removed" and not before[1]["use_regex"] and not before[1]["add_prefix_space"]):
            self.pattern = regex.compile(before[0]["pattern"]["Regex"])
        self.words = _Words(self.tokenizer.model, most)
        self.odd = regex.compile("[\x1c-\x1fΣ]" if self.lower else "[\x1c-\x1f]")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """Ids of a text and the end id, four bytes each."""
        text, end = text or "", END_ID.to_bytes(4, "little")
        if self.pattern is None or self.odd.search(text) or any(s in text for s in self.special):
            return self._whole(text) + end
        if self.lower:
            text = unicodedata.normalize("NFC", text).lower()
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text))) + end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    return Encoder(path)
