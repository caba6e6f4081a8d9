"""Vectorised word splitting and word n-gram hashing for one chunk of texts.

Texts are joined into one byte buffer with a blank between them. A byte table
says which bytes belong to words (bytes of 0x80 and up are part of multi-byte
code points), so words are found with array operations and never become Python
strings. Words get 64-bit hashes; n-grams get a multilinear hash of those.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z were lower-cased: digits, a-z and all of 0x80 up.
ALNUM = np.zeros(256, bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
#: Bytes of `[^\x20\x09-\x0D]`.
NON_BLANK = np.ones(256, bool)
NON_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_MULT = 0x9E3779B97F4A7C13  # odd
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_COEF = np.random.default_rng(21).integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NO_HASH = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(_MULT), row(_INV)


class Words:
    """Words of a chunk: ``hash``, byte range ``start``/``end`` in ``buf``; words of text i are ``ptr[i]:ptr[i+1]``."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool, hashes: bool = True):
        joined = b" " + b" ".join(texts) + b" "
        self.raw = joined.translate(LOWER) if lower else joined
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.plain = np.frombuffer(joined, np.uint8) if lower else self.buf
        inside = table[self.buf].view(np.int8)
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1) + 1
        self.end = np.flatnonzero(edge == -1) + 1
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))  # first byte of each text
        self.ptr = np.searchsorted(self.start, self.base)
        self.n = np.diff(self.ptr)
        if hashes:
            size = 1 << max(20, int(len(self.buf)).bit_length())
            up, down = _powers(size)
            total = np.cumsum(_BYTE[self.buf] * up[: len(self.buf)])
            self.hash = mix((total[self.end - 1] - total[self.start - 1]) * down[self.start])

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.ptr[1:], self.n) - np.arange(len(self.start))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def text(self, lo: int, hi: int) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


def ngrams(word_hash: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions wrap and must be masked by the caller."""
    out = np.full(len(word_hash), int(_COEF[salt, 63]) * k & (2**64 - 1), np.uint64)
    n = len(word_hash)
    for j in range(min(k, n)):
        c = _COEF[salt, j]
        out[: n - j] += word_hash[j:] * c
    return mix(out)


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over ``values[i : i + width]``, by doubling; shorter at the end."""
    out, have = values.copy(), 1
    while have < width and min(have, width - have) < len(out):
        step = min(have, width - have)
        out[:-step] = op(out[:-step], out[step:])
        have += step
    return out
