"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashed words, word pairs and pairs with one word
between them that occur in it. Each weight has its own learning rate, and the
L1 term keeps most weights at exactly 0, so the model is a short list of slots
that is broadcast for scoring.

The model is fitted on at most ``MAX_ROWS`` labelled texts, taken by the order
of a hash of their ids: a bounded sample, one task. That task streams the
sample's slots in pieces of ``PIECE``, once an epoch in the same order (Spark
sorts them, on disk where need be), and holds two numbers a slot of the table
and the slots of one text. Scoring covers every text.

Cases: null or wordless text has the bias alone; a text longer than a chunk is
scored whole; labels of unknown ids and null labels are left out; with no label
at all every score is 0.5; repeated rows are scored as rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import importable, labelled_sample, narrow, text_chunks
from fleetlake.llm.words import ALNUM, Words, mix, ngrams

MAX_ROWS = 20_000
BITS = 20
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 16.0, 0.0
#: Weight of a toxic text's gradient: they are few, and the score is cut well above one half.
POSITIVE = 4.0
BIAS = 0  # its slot
PIECE = 1 << 12


def feature_slots(w: Words, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word position, slot) of each feature: words, pairs, and pairs around one word."""
    left, mask = w.left(), np.uint64((1 << bits) - 1)
    apart = w.hash.copy()
    apart[:-2] = mix(w.hash[:-2] * np.uint64(3) + np.uint64(1) + mix(w.hash[2:]))
    out = []
    for reach, hashes in ((1, w.hash), (2, ngrams(w.hash, 2)), (3, apart)):
        at = np.flatnonzero(left >= reach)
        out.append((at, (hashes[at] & mask).astype(np.int64)))
    return out


def _features(texts: list[bytes], bits: int) -> list[np.ndarray]:
    """Different slots of each text."""
    w = Words(texts, ALNUM, lower=True)
    parts = feature_slots(w, bits)
    doc = w.doc()
    pairs = np.unique(np.concatenate([(doc[at] << bits) | slot for at, slot in parts]))
    cut = np.searchsorted(pairs, np.arange(len(texts) + 1) << bits)
    slots = (pairs & ((1 << bits) - 1)).astype(np.int32)
    return [slots[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Ftrl:
    """FTRL-proximal state: a gradient sum and a squared-gradient sum for each slot."""

    def __init__(self, bits: int):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, slots: np.ndarray, label: int) -> None:
        """One step for a text with these different slots."""
        w, n = self.weights(slots), self.n[slots]
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        g *= POSITIVE if label else 1.0
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> dict:
    """Slot and weight of every weight that is not 0, from ``doc_id``, ``label`` rows."""
    importable(docs.sparkSession)

    def featurise(batches):
        for batch, texts in text_chunks(batches):
            at, piece, last, slots = [], [], [], []
            for i, found in enumerate(_features(texts, bits)):
                found = np.append(found[found != BIAS], BIAS).astype(np.int32)
                cuts = range(0, len(found), PIECE)
                at += [i] * len(cuts)
                piece += range(len(cuts))
                last += [False] * (len(cuts) - 1) + [True]
                slots += [found[c : c + PIECE] for c in cuts]
            own = batch.select(["order", "content", "row", "label"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(piece, pa.int32()), pa.array(last), pa.array(slots, pa.list_(pa.int32()))],
                names=[*own.schema.names, "piece", "last", "slots"],
            )

    def train(batches):
        model, held = Ftrl(bits), []
        for batch in batches:
            for label, last, slots in zip(*(batch.column(i) for i in range(3)), strict=True):
                held.append(slots.values.to_numpy())
                if last.as_py():
                    model.update(np.concatenate(held), label.as_py())
                    held = []
        weights = model.weights()
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(weights[used])], names=["slot", "weight"]
        )

    sample = labelled_sample(docs, labels, max_rows)
    # rows of one id may tie; pieces of a row stay together, and rows that tie in full are equal
    rows = sample.select(
        "order", F.xxhash64("text").alias("content"), F.monotonically_increasing_id().alias("row"), "label", "text"
    )
    pieces = rows.mapInArrow(
        featurise, "order bigint, content bigint, row bigint, label int, piece int, last boolean, slots array<int>"
    )
    passes = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")
    stream = (
        pieces.repartition(1)
        .select("*", passes)  # after the shuffle, which moves the sample once
        .sortWithinPartitions("epoch", "order", "content", "row", "piece")
        .select("label", "last", "slots")
    )
    # at most 2**bits weights, by L1 a few thousand
    return {r.slot: r.weight for r in stream.mapInArrow(train, "slot int, weight double").collect()}


def score(docs: DataFrame, weights: dict, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``score`` of every text."""
    importable(docs.sparkSession)
    table = np.zeros(1 << bits, np.float32)
    table[list(weights)] = list(weights.values())
    bias, table[BIAS] = float(table[BIAS]), 0.0
    model = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch, texts in text_chunks(batches):
            w = Words(texts, ALNUM, lower=True)
            doc = w.doc()
            found = []
            for at, slot in feature_slots(w, bits):
                hit = model.value[slot] != 0
                found.append((doc[at[hit]] << bits) | slot[hit])
            pairs = np.unique(np.concatenate(found))
            total = bias + np.bincount(
                pairs >> bits, model.value[pairs & ((1 << bits) - 1)].astype(np.float64), len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept away from fitting: one in three by the crc32 of the id's text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
