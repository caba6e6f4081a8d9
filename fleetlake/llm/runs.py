"""Periodic runs of words in each text, by an enhanced suffix array.

A run is a stretch of words in which words ``q`` apart are equal, ``q`` its
smallest period, that no neighbour extends. Texts are handled in chunks of
Arrow batches; the suffix arrays of a chunk's texts are built together, as
their first key is the text.

1. Suffixes are sorted by prefix doubling, on arrays; only groups that are
   still tied are sorted again. The ranks of every doubling are kept: they
   compare any two stretches of words in a few steps, exactly.
2. LCP intervals (suffixes that share ``depth`` words) come from the nearest
   smaller values of the LCP array, no tree nodes are made. Intervals of fewer
   than ``exponent`` suffixes cannot hold the repeats of a long run and are
   left out beforehand.
3. Branching tandem test: a boundary of depth ``d`` splits its interval in two;
   for each suffix ``i`` of the smaller side, ``ISA[i + d]`` and ``ISA[i - d]``
   are looked up in the other side. A hit is a square of period ``d`` that ends
   where its run ends. The smaller sides of all boundaries hold at most
   n log n suffixes.
4. A square rotates to the left as long as the words ``d`` apart are equal; the
   number of rotations is found by the kept ranks rather than one by one. All
   rotations of a square lie in one run, and squares of a multiple of the
   period give the same stretch, so equal stretches merge to the least period.

Word identities are 64-bit hashes while sorting. Equal hashes of different
words could only make runs too long or false, so the words of every run are
compared in the end, and a chunk with such a pair starts again with exact
identities.

One task holds a chunk of 512 KB, or one longer text; memory is some 150 bytes
a word, and 4 more for each doubling of the longest repeat.

Cases: null and empty texts have no words and no runs; repeated rows are rows
of their own; an empty table gives no rows; other columns are kept when named
in ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlake.llm.common import importable, narrow, text_chunks
from fleetlake.llm.words import NON_BLANK, Words, mix

#: A run has at least this many periods, and this many words.
EXPONENT = 4
MIN_WORDS = 6


#: Suffixes tested at once.
_SLICE = 1 << 22
_TEXT = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``keys`` and the ranks of each doubling: equal in level m iff the first 2^m keys are.

    Every text must end in a key of its own, so that no suffix is a prefix of
    another. The last level is the inverse suffix array.
    """
    n = len(keys)
    sa = np.argsort(keys)
    slot = np.arange(n)
    act, key = sa, keys[sa]
    rank = np.empty(n, np.int32)
    levels: list[np.ndarray] = []
    step = 1
    while True:
        head = np.ones(len(act), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(act)))
        rank[act] = np.repeat(slot[first], size)
        levels.append(rank.copy())
        tied = np.repeat(size > 1, size)
        act, slot = act[tied], slot[tied]
        if not len(act):
            return sa, levels
        key = rank[act].astype(np.int64) * n + rank[act + step]
        order = np.argsort(key)
        act, key = act[order], key[order]
        sa[slot] = act
        step *= 2


def lcp_array(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that suffix r shares with suffix r - 1; 0 at r = 0."""
    lcp = np.zeros(len(sa), np.int64)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[at - 1], sa[at]
    shared = np.zeros(len(at), np.int64)
    for m in range(len(levels) - 1, -1, -1):
        shared += (levels[m][a + shared] == levels[m][b + shared]).astype(np.int64) << m
    lcp[at] = shared
    return lcp


def shared_before(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that end just before positions a < b and are equal, going left."""
    left = np.zeros(len(a), np.int64)
    for m in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero(a - left >= 1 << m)
        x, y = (a - left)[ok] - (1 << m), (b - left)[ok] - (1 << m)
        left[ok[levels[m][x] == levels[m][y]]] += 1 << m
    return left


def _wide(lcp: np.ndarray, least: int) -> np.ndarray:
    """Boundaries in an interval of at least ``least`` suffixes: least - 1 neighbours in a row at their depth or above.

    An interval around such a boundary's interval is larger still, so the
    boundaries that end the interval of a kept one are kept, or 0.
    """
    n, width = len(lcp), least - 1
    if n < width:
        return np.zeros(0, np.int64)
    lowest = lcp[: n - width + 1].copy()
    for j in range(1, width):
        np.minimum(lowest, lcp[j : n - width + 1 + j], out=lowest)
    best = np.zeros(n, np.int64)
    for j in range(width):
        part = best[j : n - width + 1 + j]
        np.maximum(part, lowest, out=part)
    return np.flatnonzero((lcp > 0) & (best >= lcp))


def intervals(lcp: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at``, ``lo``, ``hi``: boundary ``at`` splits the suffixes lo..hi, which share lcp[at] words, in two.

    The boundaries of one LCP interval split off its children one after the
    other from the left, so a pair of suffixes with LCP d is split by exactly
    one boundary of depth d. Intervals of fewer than ``least`` are left out.
    """
    at = _wide(lcp, least)
    zeros = np.flatnonzero(lcp == 0)
    block = np.searchsorted(zeros, at)  # a boundary of depth 0 ends every interval
    lo = zeros[block - 1]
    hi = np.append(zeros, len(lcp))[block] - 1
    depths, places, blocks = lcp[at].tolist(), at.tolist(), block.tolist()
    los, his = lo.tolist(), hi.tolist()
    stack: list[int] = []
    last = -1
    for i, d in enumerate(depths):
        if blocks[i] != last:
            last = blocks[i]
            stack.clear()
        while stack and depths[stack[-1]] > d:
            his[stack.pop()] = places[i] - 1
        if stack:
            los[i] = places[stack[-1]]
        stack.append(i)
    return at, np.array(los, np.int64), np.array(his, np.int64)


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares whose next word differs from the one a period before."""
    at, lo, hi = intervals(lcp, least)
    lower = at - lo <= hi - at + 1  # the smaller side is the left one
    begin, count = np.where(lower, lo, at), np.where(lower, at - lo, hi - at + 1)
    other_lo, other_hi = np.where(lower, at, lo), np.where(lower, hi, at - 1)
    depth = lcp[at]
    total = np.concatenate(([0], np.cumsum(count)))
    starts, periods = [], []
    n, a = len(sa), 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, total[a] + _SLICE, side="right")) - 1)
        size = count[a:b]
        node = np.repeat(np.arange(a, b), size)
        suffix = sa[np.arange(total[b] - total[a]) + np.repeat(begin[a:b] - (total[a:b] - total[a]), size)]
        d = depth[node]
        for there, first in ((suffix + d, suffix), (suffix - d, suffix - d)):
            inside = np.flatnonzero((there >= 0) & (there < n))
            found = isa[there[inside]]
            x = node[inside]
            hit = inside[(found >= other_lo[x]) & (found <= other_hi[x])]
            starts.append(first[hit])
            periods.append(d[hit])
        a = b
    if not starts:
        return at, at
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(keys: np.ndarray, exponent: int = EXPONENT, min_words: int = MIN_WORDS) -> np.ndarray:
    """Columns start, end, period of all runs in ``keys``, by start and period."""
    sa, levels = suffix_array(keys)
    lcp = lcp_array(sa, levels)
    start, period = branching_squares(sa, levels[-1], lcp, exponent)
    end = start + 2 * period
    start = start - shared_before(start, start + period, levels)
    order = np.lexsort((period, end, start))
    runs = np.column_stack((start, end, period))[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # the least period of a stretch comes first
    runs = runs[new]
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(min_words, exponent * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _exact(w: Words, doc: np.ndarray) -> np.ndarray:
    """Identities of (text, word), by the words themselves."""
    known: dict[tuple[int, bytes], int] = {}
    words = zip(doc.tolist(), w.text(0, len(w.start)), strict=True)
    return np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, len(w.start)).view(np.uint64)


def _differs(w: Words, key: np.ndarray, covered: np.ndarray) -> bool:
    """Whether two covered words have one key and are different."""
    seen: dict[int, bytes] = {}
    raw = w.raw
    at = np.flatnonzero(covered)
    for k, a, b in zip(key[at].tolist(), w.start[at].tolist(), w.end[at].tolist(), strict=True):
        word = raw[a:b]
        if seen.setdefault(k, word) != word:
            return True
    return False


def chunk_runs(w: Words, exponent: int = EXPONENT, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text index and (start, end, period), in words of the chunk, of every run of a chunk's texts."""
    doc = w.doc()
    texts = len(w.n)
    place = np.arange(len(doc)) + doc  # every text is followed by an end of its own
    ends = w.ptr[1:] + np.arange(texts)
    key = mix(w.hash + doc.astype(np.uint64) * _TEXT) >> np.uint64(1)
    for exact in (False, True):
        if exact:
            key = _exact(w, doc)
        keys = np.empty(len(doc) + texts, np.uint64)
        keys[place] = key
        # all different and above all others
        keys[ends] = np.uint64(2**64 - 1) - np.arange(texts, dtype=np.uint64)
        runs = find_runs(keys, exponent, min_words)
        owner = np.searchsorted(ends, runs[:, 0])
        runs[:, :2] -= owner[:, None]
        edge = np.zeros(len(doc) + 1, np.int64)
        np.add.at(edge, runs[:, 0], 1)
        np.add.at(edge, np.minimum(runs[:, 1], len(doc)), -1)
        if exact or not _differs(w, key, np.cumsum(edge[:-1]) > 0):
            break
    return owner, runs


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    exponent: int = EXPONENT,
    min_words: int = MIN_WORDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key``, ``keep``, ``n_words``, ``runs`` and ``collapsed`` of every text.

    ``runs`` are structs of start, length and period in words, by start and
    period. ``collapsed`` has the words that no run contains after its first
    period, joined by one blank.
    """
    importable(docs.sparkSession)
    rows = narrow(docs, text, key, *keep)

    def run(batches):
        for batch, texts in text_chunks(batches, text):
            w = Words(texts, NON_BLANK, lower=False)
            owner, runs = chunk_runs(w, exponent, min_words)
            step = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(step, runs[:, 0] + runs[:, 2], 1)
            np.add.at(step, runs[:, 1], -1)
            stay = np.cumsum(step[:-1]) == 0
            # the bytes of kept words, each with the byte after it turned into a blank
            byte = np.zeros(len(w.buf) + 1, np.int8)
            byte[w.start[stay]] = 1
            byte[w.end[stay] + 1] -= 1
            plain = w.buf.copy()
            plain[w.end] = 0x20
            kept = plain[np.cumsum(byte[:-1], dtype=np.int8) > 0].tobytes()
            size = np.concatenate(([0], np.cumsum((w.end - w.start + 1) * stay)))[w.ptr]
            collapsed = [kept[a : max(a, b - 1)] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            fields = [runs[:, 0] - w.ptr[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
            found = pa.StructArray.from_arrays([pa.array(x) for x in fields], ["start", "length", "period"])
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(1 + i) for i in range(1 + len(keep))],
                    pa.array(w.n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), found),
                    pa.array(collapsed, pa.binary()),
                ],
                names=[key, *keep, "n_words", "runs", "collapsed"],
            )

    kinds = dict(rows.dtypes)
    columns = [f"`{c}` {kinds[c]}" for c in (key, *keep)]
    out = rows.mapInArrow(
        run,
        ", ".join(columns)
        + ", n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary",
    )
    return out.withColumn("collapsed", out["collapsed"].cast("string"))
