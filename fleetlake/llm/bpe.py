"""Byte-level BPE ids of many texts at once, equal to those of the tokenizers library.

The library is fast on words but slow on whole texts, because each text is cut
by a backtracking pattern. Here the cuts come from array operations on
character classes, each different word of a chunk is encoded once by the
library, and ids are gathered back into texts. Texts with characters from
U+0250 up, or with the name of a special token, go to the library whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from fleetlake.llm.words import mix

LIMIT = 0x250
_BREAK = chr(LIMIT)
_LETTER, _NUMBER, _SPACE, _OTHER, _STOP = range(5)
_CLASS = np.full(LIMIT + 1, _OTHER, np.int8)
_CLASS[[c for c in range(LIMIT) if unicodedata.category(chr(c))[0] == "L"]] = _LETTER
_CLASS[[c for c in range(LIMIT) if unicodedata.category(chr(c))[0] == "N"]] = _NUMBER
_CLASS[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE
_CLASS[LIMIT] = _STOP
_CHAR = np.random.default_rng(22).integers(0, 2**64, LIMIT + 1, dtype=np.uint64)
_MULT = 0x9E3779B97F4A7C13
#: Endings that the vocabulary's pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Different words remembered by a worker, about 50 bytes each; then it starts anew.
KNOWN_WORDS = 500_000


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(_MULT), row(pow(_MULT, -1, 1 << 64))


def word_starts(chars: np.ndarray, text: str) -> np.ndarray:
    """Where the words of the byte-level pattern begin; ``_BREAK`` separates texts and is a word of its own."""
    kind = _CLASS[chars]
    n = len(chars)
    runs = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    starts = np.zeros(n + 1, bool)
    starts[runs] = True
    stops = np.append(runs[1:], n)
    blank = (kind[runs] == _SPACE) & (stops < n)
    ends = stops[blank]
    ends = ends[kind[ends] != _STOP]
    starts[ends - 1] = True  # the last blank of a run stands alone, or leads the next word if it is U+0020
    joined = ends[chars[ends - 1] == 0x20]
    starts[joined] = False
    quote = runs[(chars[runs] == 0x27) & (stops - runs == 1)]
    quote = quote[starts[quote] & (quote + 1 < n)]
    for at in quote[kind[np.minimum(quote + 1, n - 1)] == _LETTER].tolist():
        for ending in ENDINGS:
            if text.startswith(ending, at + 1):
                starts[at + 1] = False
                if kind[min(at + 1 + len(ending), n - 1)] == _LETTER:
                    starts[at + 1 + len(ending)] = True
                break
    return np.flatnonzero(starts[:n])


def _byte_of(letter: str) -> list[int]:
    """The byte that a letter of the byte-level alphabet stands for: itself if printable, else in order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    if ord(letter) < 0x100:
        return [ord(letter)]
    return [[b for b in range(0x100) if b not in printable][ord(letter) - 0x100]]


class Bpe:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        alphabet = {b: c for c in pre_tokenizers.ByteLevel.alphabet() for b in _byte_of(c)}
        self.letters = str.maketrans({chr(b): c for b, c in alphabet.items()})
        self._forget()

    def _forget(self) -> None:
        # known words as sorted keys, each with its place in the flat ids
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _places(self, keys: np.ndarray, word) -> np.ndarray:
        """Index into begin and size of each of the sorted ``keys``; ``word(i)`` is the text of the i-th."""
        if len(self.keys) + len(keys) > KNOWN_WORDS:
            self._forget()
        slot = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        inside = slot < len(self.keys)
        old[inside] = self.keys[slot[inside]] == keys[inside]
        out = np.empty(len(keys), np.int64)
        out[old] = self.at[slot[old]]
        new = np.flatnonzero(~old)
        if len(new):
            tokenize, letters = self.whole.model.tokenize, self.letters
            # a run of breaks (empty texts) has no ids
            ids = [
                [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] if w[0] != _BREAK else []
                for w in map(word, new.tolist())
            ]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            out[new] = np.arange(len(new)) + len(self.begin)
            self.begin = np.concatenate((self.begin, np.cumsum(size) - size + len(self.flat)))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), "<u4", int(size.sum()))))
            self.at = np.insert(self.at, slot[new], out[new])
            self.keys = np.insert(self.keys, slot[new], keys[new])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """``<u4`` ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        easy = [i for i, t in enumerate(texts) if self._easy(t)]
        hard = [i for i in range(len(texts)) if i not in set(easy)] if len(easy) < len(texts) else []
        for i, e in zip(hard, self.whole.encode_batch([texts[i] for i in hard], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4")
        for i, ids in zip(easy, self._encode_easy([texts[i] for i in easy]), strict=True):
            out[i] = ids
        return out

    def _easy(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        return text.isascii() or max(text) < _BREAK

    def _encode_easy(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        text = _BREAK.join(texts) + _BREAK
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        starts = word_starts(chars, text)
        ends = np.append(starts[1:], len(chars))
        up, down = _powers(1 << max(19, len(chars).bit_length()))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CHAR[chars] * up[: len(chars)])))
        keys = mix((total[ends] - total[starts]) * down[starts]) + (ends - starts).astype(np.uint64)
        known, first, which = np.unique(keys, return_index=True, return_inverse=True)
        place = self._places(known, lambda i: text[starts[first[i]] : ends[first[i]]])[which]
        size = self.size[place]
        done = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[place] - (done - size), size) + np.arange(int(done[-1]))]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        close = np.cumsum(lengths + 1) - 1  # the break after each text
        upto = np.concatenate(([0], done))[np.searchsorted(starts, close, side="left")]
        # a break inside a run of breaks starts no word; nothing lies between, so the count is the same
        return np.split(ids, upto[:-1])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder for each Python worker."""
    return Bpe(path)
