"""Exact removal of repeated word spans by de Bruijn path compaction.

Windows of ``span`` words are the edges of a de Bruijn graph. Each window has
one seed, the smallest k-word gram in it (the rightmost of equals), which only
depends on the window's words. Windows of one text around the same seed
occurrence form a path without branches; a path is known by its seed and the
hash of all its words.

Paths and windows meet by two 64-bit hashes that share nothing: one of the
words' hashes (the seed; the window) and one of the bytes of the words
themselves, by other numbers. What they find is then verified by the words at
the source coordinates. Minimiser runs stand in for the graph's nonbranching
paths: they are found in each text alone, so no table of k-mers or degrees is
made.

1. Seeds that occur once cannot lie in a repeated window; a join with the
   counted seeds leaves the paths around repeated ones.
2. Equal paths are compacted: the first by source coordinates (``doc_id``,
   start) stays, every later one is covered by removable windows.
3. Seeds with several different paths are the graph's branchings: there, and
   only for the first occurrence of each path, single windows are compared,
   and again all but the first by coordinates are removable.
4. Overlapping finds at one distance from one source are one long span. The
   source's words come in blocks of 64, each only to the spans that repeat it.
5. Where a span's words are the source's, in runs of ``span`` or more, they are
   removed; where both hashes collided, words are kept.

Texts travel to their stretches compressed. A row is known by its id and a
64-bit hash of its text, which also orders repeated ids; of equal rows the first
stays and the others count as later.

Cases: null text has no words; a text under ``span`` words has no window and
keeps everything; a null id counts as the smallest; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import discard, importable, materialise, narrow, shuffles_released, text_chunks
from fleetlake.llm.words import NON_BLANK, Words, mix, ngrams, sliding

SPAN = 20
GRAM = 6
#: Words a chunk (512 KB, or one longer text) may have; the other 36 bits order the grams.
POSITION_BITS = 28
#: Words of a source that travel together to the spans that repeat them.
BLOCK = 64

_MULT = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(22).integers(0, 2**64, 256, dtype=np.uint64)
_KEY = ["doc_id", "text_key"]


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(_MULT), row(pow(_MULT, -1, 1 << 64))


def side_by_side(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words of a chunk, one blank behind each, and the place of every word in them."""
    edge = np.zeros(len(w.buf) + 1, np.int8)
    edge[w.start] = 1
    edge[w.end + 1] -= 1
    plain = w.buf.copy()
    plain[w.end] = 0x20
    flat = plain[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    return flat, np.concatenate(([0], np.cumsum(w.end - w.start + 1)))


def byte_hashes(w: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the bytes of words ``first:last``, joined by one blank, of each stretch."""
    flat, place = side_by_side(w)
    up, down = _powers(1 << max(20, int(len(flat) + 1).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * up[: len(flat)])))
    begin, end = place[first], place[last]
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def paths(w: Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, path hash, first word and number of windows of every path of a chunk."""
    n = len(w.start)
    if n >= 1 << POSITION_BITS:
        raise ValueError(f"a text of {n} words: positions are kept in {POSITION_BITS} bits")
    starts = np.flatnonzero(w.left() >= span)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), starts, starts
    grams = ngrams(w.hash, gram)
    # the smallest gram, of equal ones the rightmost: position in the low bits, from the right
    bits = np.uint64(POSITION_BITS)
    packed = (grams >> bits << bits) | (np.uint64(n) - np.arange(n, dtype=np.uint64))
    lowest = sliding(packed, span - gram + 1, np.minimum)[starts]
    seed = n - (lowest & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    head = np.ones(len(starts), bool)
    head[1:] = (seed[1:] != seed[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(starts)))
    at = starts[first]
    return ngrams(w.hash, gram, 1)[seed[first]], byte_hashes(w, at, at + count + span - 1), at, count


def document_paths(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``seed``, ``path``, ``doc_id``, ``text_key``, ``start``, ``windows``: one row for each path of each text."""

    def run(batches):
        for batch, texts in text_chunks(batches):
            w = Words(texts, NON_BLANK, lower=False)
            seed, path, at, count = paths(w, span, gram)
            owner = np.searchsorted(w.ptr, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seed.view(np.int64)),
                    pa.array(path.view(np.int64)),
                    batch.column(0).take(pa.array(owner)),
                    batch.column(2).take(pa.array(owner)),
                    pa.array((at - w.ptr[owner]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                names=["seed", "path", *_KEY, "start", "windows"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(
        run, f"seed bigint, path bigint, doc_id {kind}, text_key bigint, start int, windows int"
    )


def _with_key(docs: DataFrame) -> DataFrame:
    return narrow(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))


def _compressed(docs: DataFrame) -> DataFrame:
    """Texts as zstd frames, so that shuffles move fewer bytes."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch, texts in text_chunks(batches):
            frames = pa.array([pack(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), frames], names=[*_KEY, "frame"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key bigint, frame binary")


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the document key, null ids included; columns of the key come from the left."""
    on = left["doc_id"].eqNullSafe(right["doc_id"]) & left["text_key"].eqNullSafe(right["text_key"])
    return left.join(right, on, how).drop(right["doc_id"], right["text_key"])


def _frame_chunks(batches, max_bytes: int = 1 << 19):
    """Slices of batches whose third column is a zstd frame, with the texts in it, by about ``max_bytes``."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        lo, texts, size = 0, [], 0
        for i, frame in enumerate(batch.column(2).to_pylist()):
            text = unpack(frame)
            if texts and size + len(text) > max_bytes:
                yield batch.slice(lo, i - lo), texts
                lo, texts, size = i, [], 0
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(lo), texts


def _flat(lists: pa.ListArray, *fields: str) -> list[np.ndarray]:
    """Row number and each field of all structs of a list column; null lists are empty."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    values = pc.list_flatten(lists)
    out = [np.repeat(np.arange(len(lists)), size)]
    return out + [pc.struct_field(values, f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


def branch_windows(texts: DataFrame, span: int, kind: str) -> DataFrame:
    """Both hashes and the coordinates of every window of the paths listed in ``paths``."""

    def run(batches):
        for batch, chunk in _frame_chunks(batches):
            w = Words(chunk, NON_BLANK, lower=False)
            row, start, count = _flat(batch.column(3), "start", "windows")
            own = np.repeat(row, count)
            at = np.repeat(start, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            first = w.ptr[own] + at
            hashes = [x.view(np.int64) for x in (ngrams(w.hash, span)[first], byte_hashes(w, first, first + span))]
            yield pa.RecordBatch.from_arrays(
                [
                    *map(pa.array, hashes),
                    batch.column(0).take(pa.array(own)),
                    batch.column(1).take(pa.array(own)),
                    pa.array(at.astype(np.int32)),
                ],
                names=["h1", "h2", *_KEY, "start"],
            )

    return texts.mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {kind}, text_key bigint, start int")


def removable(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Word ranges ``lo:hi`` of rows (``doc_id``, ``text_key``) whose windows start earlier, by their hashes, at a source.

    The source is the row ``from_id``, ``from_key``; its words are ``shift``
    before those of the range. What is joined by seed, path or window is
    written first, so that both sides of each join are plain shuffles and Spark
    can split hot keys; these tables are deleted when the ranges are written.
    """
    keyed = _with_key(docs)
    kind = dict(docs.dtypes)["doc_id"]
    found = document_paths(keyed, span, gram)
    repeated = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    seeds = materialise(repeated, "seeds")
    found = materialise(found.join(seeds, "seed", "left_semi"), "paths")
    discard(seeds)
    place = F.struct(*_KEY, "start", "windows")
    firsts = materialise(
        found.groupBy("seed", "path").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "path-firsts"
    )
    later = found.join(firsts.filter("n > 1").select("seed", "path", "first"), ["seed", "path"]).filter(place != F.col("first"))
    source = [
        F.col("first.doc_id").alias("from_id"),
        F.col("first.text_key").alias("from_key"),
        (F.col("start") - F.col("first.start")).alias("shift"),
    ]
    spans = materialise(
        later.select(*_KEY, F.col("start").alias("lo"), (F.col("start") + F.col("windows") + span - 1).alias("hi"), *source),
        "path-spans",
    )
    discard(found)
    branching = firsts.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    branching = materialise(branching, "branchings")
    by_text = (
        firsts.join(branching, "seed", "left_semi")
        .select("first.*")
        .groupBy(*_KEY)
        .agg(F.collect_list(F.struct("start", "windows")).alias("paths"))
    )
    texts = _joined(_compressed(keyed), by_text, "inner")
    windows = materialise(branch_windows(texts, span, kind), "branch-windows")
    discard(branching, firsts)
    place = F.struct(*_KEY, "start")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialise(firsts.filter("n > 1").drop("n"), "window-firsts")
    single = windows.join(firsts, ["h1", "h2"]).filter(place != F.col("first"))
    single = single.select(*_KEY, F.col("start").alias("lo"), (F.col("start") + F.lit(span)).alias("hi"), *source)
    ranges = materialise(long_spans(spans.unionByName(single)), "ranges")
    discard(spans, windows, firsts)
    return ranges


def long_spans(spans: DataFrame) -> DataFrame:
    """Overlapping ranges of a row at one distance from one source, as one range."""
    line = [*_KEY, "from_id", "from_key", "shift"]
    order = Window.partitionBy(*line).orderBy("lo")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("lo") > reached, F.lit(True)).cast("int")
    part = F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = spans.withColumn("apart", apart).withColumn("part", part).groupBy(*line, "part")
    return parts.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")


def source_blocks(texts: DataFrame, kind: str) -> DataFrame:
    """``words`` of each block of 64 listed in ``blocks``, one blank behind each word."""

    def run(batches):
        for batch, chunk in _frame_chunks(batches):
            w = Words(chunk, NON_BLANK, lower=False, hashes=False)
            flat, place = side_by_side(w)
            flat = flat.tobytes()
            row, block = _flat(batch.column(3), "block")
            first = w.ptr[row] + block * BLOCK
            begin, end = place[first], place[np.minimum(first + BLOCK, w.ptr[row + 1])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array(block),
                    pa.array([flat[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
                ],
                names=["from_id", "from_key", "block", "words"],
            )

    return texts.mapInArrow(run, f"from_id {kind}, from_key bigint, block bigint, words binary")


def with_source_words(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row for each block of a source that a range repeats, with the words there.

    A source that a third of all rows repeat is one row a block; the ranges'
    side of the join is a plain shuffle that Spark can split.
    """
    kind = dict(docs.dtypes)["doc_id"]
    at = F.sequence(
        F.expr(f"(lo - shift) div {BLOCK}").cast("bigint"), F.expr(f"(hi - shift - 1) div {BLOCK}").cast("bigint")
    )
    pieces = ranges.withColumn("block", F.explode(at))
    wanted = (
        pieces.groupBy("from_id", "from_key")
        .agg(F.collect_set(F.struct("block")).alias("blocks"))
        .select(F.col("from_id").alias("doc_id"), F.col("from_key").alias("text_key"), "blocks")
    )
    copy = Window.partitionBy(*_KEY).orderBy(F.lit(0))
    texts = _compressed(_with_key(docs)).withColumn("copy", F.row_number().over(copy)).filter("copy = 1").drop("copy")
    blocks = materialise(source_blocks(_joined(texts, wanted, "inner"), kind), "source-blocks")
    on = (
        pieces["from_id"].eqNullSafe(blocks["from_id"])
        & (pieces["from_key"] == blocks["from_key"])
        & (pieces["block"] == blocks["block"])
    )
    out = pieces.join(blocks, on).drop(blocks["from_id"], blocks["from_key"], blocks["block"])
    out = materialise(out, "source-words")
    discard(blocks)
    return out


def verified(w: Words, pieces: pa.ListArray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word in the chunk of what repeats its source word by word, ``span`` words or more."""
    row, lo, hi, shift, block, key = _flat(pieces, "lo", "hi", "shift", "block", "from_key")
    words = pc.struct_field(pc.list_flatten(pieces), "words").to_pylist()
    if not len(row):
        return row, row
    source = Words(words, NON_BLANK, lower=False, hashes=False)
    (mine, place), (other, spot) = side_by_side(w), side_by_side(source)
    mine, other = mine.tobytes(), other.tobytes()
    first = np.maximum(lo - shift, block * BLOCK)
    size = np.minimum(hi - shift, (block + 1) * BLOCK) - first
    at, there = w.ptr[row] + first + shift, source.ptr[:-1] + first - block * BLOCK
    bounds = (place[at], place[at + size], spot[there], spot[there + size])
    same = np.array([mine[a:b] == other[c:d] for a, b, c, d in zip(*(x.tolist() for x in bounds), strict=True)])
    begin, end = w.ptr[row] + lo, w.ptr[row] + hi
    if same.all():
        return begin, end
    # ranges with a piece that differs are compared word by word
    _, which = np.unique(np.stack([row, lo, hi, shift, key]), axis=1, return_inverse=True)
    which = which.reshape(-1)
    wrong = np.unique(which[~same])
    sure = ~np.isin(which, wrong)
    begins, ends = [begin[sure]], [end[sure]]
    for g in wrong:
        members = np.flatnonzero(which == g)
        base = int(begin[members[0]])
        equal = np.zeros(int(end[members[0]]) - base + 2, np.int8)
        for i in members:
            for j in range(int(size[i])):
                a, b = at[i] + j, there[i] + j
                equal[a - base + 1] = mine[place[a] : place[a + 1]] == other[spot[b] : spot[b + 1]]
        edge = np.diff(equal)
        lows, highs = np.flatnonzero(edge == 1) + base, np.flatnonzero(edge == -1) + base
        long = highs - lows >= span
        begins.append(lows[long])
        ends.append(highs[long])
    return np.concatenate(begins), np.concatenate(ends)


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (compressed kept words) and ``kept_sha256`` of each row."""
    importable(docs.sparkSession)
    with shuffles_released(docs.sparkSession):
        ranges = removable(docs, span, gram)
    return remove_ranges(docs, ranges, span)


def remove_ranges(docs: DataFrame, ranges: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows of ``remove_repeats``, without the words of ``ranges`` that are those of their sources."""
    kind = dict(docs.dtypes)["doc_id"]
    with shuffles_released(docs.sparkSession):
        pieces = with_source_words(docs, ranges)
    by_text = pieces.groupBy(*_KEY).agg(
        F.collect_list(F.struct("lo", "hi", "shift", "block", "from_key", "words")).alias("pieces")
    )
    copy = Window.partitionBy(*_KEY).orderBy(F.lit(0))
    texts = _compressed(_with_key(docs)).withColumn("copy", F.row_number().over(copy))
    joined = _joined(texts, by_text, "left").select(*_KEY, "frame", "copy", "pieces")

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch, chunk in _frame_chunks(batches):
            w = Words(chunk, NON_BLANK, lower=False, hashes=False)
            begin, end = verified(w, batch.column(4), span)
            step = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, end, -1)
            again = (batch.column(3).to_numpy() > 1) & (w.n >= span)  # equal rows start earlier
            keep = (np.cumsum(step[:-1]) == 0) & ~np.repeat(again, w.n)
            # the bytes of kept words, each with the byte after it turned into a blank
            byte = np.zeros(len(w.buf) + 1, np.int8)
            byte[w.start[keep]] = 1
            byte[w.end[keep] + 1] -= 1
            plain = w.buf.copy()
            plain[w.end] = 0x20
            kept = plain[np.cumsum(byte[:-1], dtype=np.int8) > 0].tobytes()
            size = np.concatenate(([0], np.cumsum((w.end - w.start + 1) * keep)))[w.ptr]
            left = np.concatenate(([0], np.cumsum(keep)))[w.ptr]
            texts_ = [kept[a : max(a, b - 1)] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(w.n.astype(np.int64)),
                    pa.array((w.n - np.diff(left)).astype(np.int64)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts_]),
                    pa.array([pack(t) for t in texts_], pa.binary()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return joined.mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept binary"
    )
