"""Distinct 5-word shingles of many texts at once, as 64-bit numbers, by whole-array arithmetic."""

from __future__ import annotations

import numpy as np

WORDS = 5
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(8)
_LETTERS = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_PLACES = _RANDOM.integers(1, 2**63, WORDS, dtype=np.uint64) * 2 + 1
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)])) for base in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all texts, and the index of its text.  A-Z are lower-cased; only ASCII white space separates."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded).translate(_LOWER) + b" ", np.uint8)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    power, inverse = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * power[:len(data)], dtype=np.uint64)])
    return mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)), np.searchsorted(ends, begin, "right")


def shingles(texts: list[str | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle), distinct and sorted by both.  A text of fewer words has its whole sequence as its only one."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    n = max(0, len(words) - size + 1)
    hashes, same = np.zeros(n, np.uint64), owner[:n] == owner[size - 1:] if n else np.zeros(0, bool)
    for j in range(size):
        hashes += words[j:j + n] * _PLACES[j]
    out_owner, out = [owner[:n][same]], [hashes[same]]
    starts = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        w = words[starts[i]:starts[i] + counts[i]]
        out.append(np.array([np.sum(w * _PLACES[:len(w)], dtype=np.uint64) + np.uint64(len(w))], np.uint64))
        out_owner.append(np.array([i]))
    who, what = np.concatenate(out_owner), mixed(np.concatenate(out))
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    return who[new], what[new]
