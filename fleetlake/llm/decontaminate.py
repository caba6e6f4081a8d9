"""Benchmark decontamination by winnowing.

Every window of ``span`` words is represented by the smallest hash of its
k-word grams; neighbouring windows mostly share it, so a text keeps about
``2 / (span - k + 2)`` fingerprints a word. A shared span of ``span`` words is
the same window in both texts, so its fingerprint is the same too: no shared
span can be missed.

1. The benchmark's windows and their fingerprints are listed once.
2. Documents are fingerprinted where they lie. A Bloom filter of the benchmark
   fingerprints (a fixed number of bits, so a broadcast of fixed size) drops
   nearly all others before anything is shuffled. A larger benchmark lets
   more of them through and changes no result.
3. The surviving fingerprints, extended to the windows around them, are joined
   with the benchmark's by fingerprint and exact words.

Cases: null or wordless text has no words and no hits; an item of fewer than
``span`` words is one window of its own length; wordless or null items have no
window; equal windows count once per item; repeated rows keep one result row
each; items without an id can be hit but are not listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import importable, materialise, narrow, text_chunks
from fleetlake.llm.words import ALNUM, Words, ngrams, sliding

SPAN = 13
GRAM = 7
BLOOM_BITS = 1 << 23

_WINDOWS = "array<struct<start:int,len:int,fp:bigint,words:string>>"
_WINDOW_TYPE = pa.list_(
    pa.struct([("start", pa.int32()), ("len", pa.int32()), ("fp", pa.int64()), ("words", pa.string())])
)


def _window_column(w: Words, found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.Array:
    """found: (word positions, fingerprints, window length); one list of windows per text."""
    pos = np.concatenate([f[0] for f in found])
    fps = np.concatenate([f[1] for f in found])
    size = np.concatenate([np.full(len(f[0]), f[2], np.int32) for f in found])
    order = np.argsort(pos, kind="stable")
    pos, fps, size = pos[order], fps[order], size[order]
    words = [b" ".join(w.text(p, p + n)).decode() for p, n in zip(pos.tolist(), size.tolist(), strict=True)]
    owner = np.searchsorted(w.ptr, pos, side="right") - 1
    struct = pa.StructArray.from_arrays(
        [
            pa.array((pos - w.ptr[owner]).astype(np.int32)),
            pa.array(size),
            pa.array(fps.view(np.int64)),
            pa.array(words, pa.string()),
        ],
        names=["start", "len", "fp", "words"],
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pos, w.ptr).astype(np.int32)), struct)


def _fingerprints(w: Words, span: int, gram: int) -> np.ndarray:
    """The smallest gram hash of the window that starts at each word."""
    return sliding(ngrams(w.hash, gram), span - gram + 1, np.minimum)


def benchmark_windows(bench: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``item_id``, ``len``, ``fp``, ``words``: each different window of each item."""

    def run(batches):
        for batch, texts in text_chunks(batches):
            w = Words(texts, ALNUM, lower=True)
            left, n = w.left(), np.repeat(w.n, w.n)
            whole = np.flatnonzero(left >= span)
            found = [(whole, _fingerprints(w, span, gram)[whole], span)]
            for size in np.unique(w.n[(w.n > 0) & (w.n < span)]).tolist():
                at = np.flatnonzero((left == size) & (n == size))
                found.append((at, ngrams(w.hash, size, 1)[at], size))
            yield pa.RecordBatch.from_arrays([batch.column(0), _window_column(w, found)], names=["item_id", "windows"])

    kind = dict(bench.dtypes)["item_id"]
    return (
        narrow(bench, "item_id", "text")
        .mapInArrow(run, f"item_id {kind}, windows {_WINDOWS}")
        .select("item_id", F.explode("windows").alias("w"))
        .select("item_id", "w.len", "w.fp", "w.words")
        .distinct()
    )


def _bloom(windows: DataFrame, bits: int) -> np.ndarray:
    """At most ``bits / 64`` numbers reach the driver, whatever the benchmark's size."""
    slot = F.explode(
        F.array(F.col("fp").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(bits - 1)))
    )
    rows = (
        windows.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask"))
        .collect()
    )
    table = np.zeros(bits >> 6, np.int64)
    for r in rows:
        table[r.word] = r.mask
    return table.view(np.uint64)


def _may_contain(table: np.ndarray, fps: np.ndarray) -> np.ndarray:
    last = np.uint64(len(table) * 64 - 1)
    out = np.ones(len(fps), bool)
    for slot in (fps & last, (fps >> np.uint64(32)) & last):
        out &= (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return out


def document_windows(
    docs: DataFrame, windows: DataFrame, span: int = SPAN, gram: int = GRAM, bloom_bits: int = BLOOM_BITS
) -> DataFrame:
    """Per row: ``doc_id``, ``text_key``, ``n_words`` and the windows around fingerprints the benchmark may have."""
    spark = docs.sparkSession
    importable(spark)
    table = spark.sparkContext.broadcast(_bloom(windows, bloom_bits))
    short = sorted(r.len for r in windows.filter(F.col("len") < span).select("len").distinct().collect())

    def run(batches):
        for batch, texts in text_chunks(batches):
            w = Words(texts, ALNUM, lower=True)
            left = w.left()
            fps = _fingerprints(w, span, gram)
            whole = np.flatnonzero(left >= span)
            kept = fps[whole]
            # one test per fingerprint: neighbouring windows that share it form a run
            head = np.ones(len(whole), bool)
            head[1:] = (kept[1:] != kept[:-1]) | (whole[1:] != whole[:-1] + 1)
            hit = _may_contain(table.value, kept[head])[np.cumsum(head) - 1]
            found = [(whole[hit], kept[hit], span)]
            for size in short:
                at = np.flatnonzero(left >= size)
                grams = ngrams(w.hash, size, 1)[at]
                hit = _may_contain(table.value, grams)
                found.append((at[hit], grams[hit], size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(w.n.astype(np.int64)), _window_column(w, found)],
                names=["doc_id", "text_key", "n_words", "windows"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return (
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
        .mapInArrow(run, f"doc_id {kind}, text_key bigint, n_words bigint, windows {_WINDOWS}")
        .withColumn("row", F.monotonically_increasing_id())
    )


def contamination(
    docs: DataFrame, bench: DataFrame, span: int = SPAN, gram: int = GRAM, bloom_bits: int = BLOOM_BITS
) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, ``n_words``, ``n_hit``, ``items`` (ids as sorted strings)."""
    importable(docs.sparkSession)
    windows = materialise(benchmark_windows(bench, span, gram), "bench-windows")
    found = materialise(document_windows(docs, windows, span, gram, bloom_bits), "doc-windows")
    candidate = found.select("row", F.explode("windows").alias("w")).select("row", "w.start", "w.len", "w.fp", "w.words")
    hits = candidate.join(windows.select("fp", "words").distinct(), ["fp", "words"], "left_semi")
    before = Window.partitionBy("row").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    n_hit = (
        hits.withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "covered"))).alias("n_hit"))
    )
    items = (
        candidate.select("row", "fp", "words")
        .distinct()
        .join(windows.select("fp", "words", "item_id"), ["fp", "words"])
        .select("row", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    return (
        found.drop("windows")
        .join(n_hit.join(items, "row"), "row", "left")
        .select(
            "doc_id",
            "text_key",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least one word in twenty lies in a benchmark window."""
    return (F.col(n_hit) > 0) & (F.lit(20) * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = contamination(docs, bench).filter(contaminated()).select("doc_id", "text_key").distinct()
    key = F.xxhash64(docs["text"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (key == bad["text_key"]), "left_anti")
