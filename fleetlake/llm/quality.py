"""Quality by importance resampling: target against raw generative models of hashed n-grams, Gumbel top-k.

Two families of n-grams make up the models. A token's form is its case, its
closing punctuation and whether it repeats the token before it; runs of one,
two and three forms are hashed into ``2**FORM_BITS`` slots. Lower-cased words
and pairs of them are hashed into ``2**WORD_BITS`` slots. In each family the
target model is the slot frequencies of texts labelled good, the raw model
those of all documents. The target's counts are drawn towards the raw model by
a prior of ``FORM_PRIOR`` or ``WORD_PRIOR`` counts a slot, so that n-grams the
target texts are too few to know count neither for nor against a text. A text's log weight is the sum of ``log target - log raw`` over its
n-grams of both families: how much likelier the target models make it. Texts
are drawn without replacement by weight: the ``take`` largest of log weight
plus Gumbel noise. By default ``take`` is the number of texts that the target
models favour, so noise only decides between texts near 0.

The target model is fitted on at most ``MAX_ROWS`` labelled texts; everything
else covers all rows.

Cases: null or empty text has no n-grams and weight 0 (it is not favoured);
repeated rows get equal keys and enter together; without a good label every
weight is 0 and every row is taken; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import importable, labelled_sample, materialise, narrow, text_chunks
from fleetlake.llm.words import ALNUM, NON_BLANK, Words, mix, ngrams
from fleetlake.operators.position import with_global_position

MAX_ROWS = 20_000
FORM_BITS, FORM_ORDER, FORM_PRIOR = 14, 3, 10.0
WORD_BITS, WORD_ORDER, WORD_PRIOR = 18, 2, 100.0
SLOTS = (1 << FORM_BITS) + (1 << WORD_BITS)  # forms first
SEED = 6

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = ~(_UPPER | _LOWER | _DIGIT)
_MARK[0x80:] = False


def form_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every n-gram of forms."""
    w = Words(texts, NON_BLANK, lower=True)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain, first, last = w.plain, w.start, w.end - 1
    upper = np.concatenate(([0], np.cumsum(_UPPER[plain])))
    lower = np.concatenate(([0], np.cumsum(_LOWER[plain])))
    n_upper, n_lower = upper[w.end] - upper[first], lower[w.end] - lower[first]
    case = np.where(
        _DIGIT[plain[first]], 3, np.where((n_upper > 0) & (n_lower == 0) & (w.end - first > 1), 2, _UPPER[plain[first]])
    ).astype(np.uint64)
    mark = np.where(_MARK[plain[last]], plain[last], 0).astype(np.uint64)
    before = plain[np.maximum(last - 1, first)]
    second = np.where((mark > 0) & _MARK[before], before, 0).astype(np.uint64)
    again = np.zeros(len(first), np.uint64)
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.ptr[:-1][w.n > 0]] = 0
    form = mix(case | mark << np.uint64(8) | second << np.uint64(16) | again << np.uint64(24))
    return _runs(w, form, FORM_ORDER, FORM_BITS)


def word_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every word and pair of words."""
    w = Words(texts, ALNUM, lower=True)
    return _runs(w, w.hash, WORD_ORDER, WORD_BITS)


def _runs(w: Words, hashes: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every run of up to ``order`` tokens."""
    left, doc = w.left(), w.doc()
    parts = [(np.flatnonzero(left >= n), n) for n in range(1, order + 1)]
    slots = [(ngrams(hashes, n)[at] & np.uint64((1 << bits) - 1)).astype(np.int64) for at, n in parts]
    return np.concatenate([doc[at] for at, _ in parts]), np.concatenate(slots)


def all_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every n-gram; word slots follow those of forms."""
    (form_doc, form), (word_doc, word) = form_slots(texts), word_slots(texts)
    return np.concatenate([form_doc, word_doc]), np.concatenate([form, word + (1 << FORM_BITS)])


def log_ratios(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """``log target - log raw`` of each slot; ``labels`` has ``doc_id`` and ``label`` (1: target). Zeros without target."""
    importable(docs.sparkSession)

    def count(batches):
        table = np.zeros(SLOTS, np.int64)
        for _, texts in text_chunks(batches):
            table += np.bincount(all_slots(texts)[1], minlength=SLOTS)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], names=["slot", "n"])

    def counts(texts: DataFrame) -> np.ndarray:
        # at most SLOTS numbers reach the driver
        found = texts.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
        rows = found.toArrow()
        table = np.zeros(SLOTS, np.int64)
        table[rows["slot"].to_numpy()] = rows["n"].to_numpy()
        return table

    target = counts(labelled_sample(docs, labels.filter("label = 1"), max_rows))
    raw = counts(narrow(docs, "text"))
    if not target.sum():
        return np.zeros(SLOTS)
    cut = 1 << FORM_BITS
    families = [(target[:cut], raw[:cut], FORM_PRIOR), (target[cut:], raw[cut:], WORD_PRIOR)]
    return np.concatenate([_log_ratio(*f) for f in families])


def _log_ratio(target: np.ndarray, raw: np.ndarray, prior: float) -> np.ndarray:
    """Counts of the target against those expected of as many n-grams of the raw texts."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log(target + prior) - np.log(expected + prior)


def _weighted(docs: DataFrame, ratios, at_least: float | None, narrowed: bool) -> DataFrame:
    """``docs`` with ``log_weight`` and ``sample_key``; or only its own columns, of rows with key ``at_least``."""
    columns = ["doc_id"] if narrowed else docs.columns
    schema = docs.select(*columns).schema
    names = [f"c{i}" for i in range(len(columns))]
    # own names, so that no other column can clash
    noise = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), F.col("text"))
    plain = docs.select(F.col("text").alias("text"), noise.alias("noise"), *[
        F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)
    ])

    def run(batches):
        for batch, texts in text_chunks(batches):
            doc, slot = all_slots(texts)
            weight = np.bincount(doc, ratios.value[slot], len(texts)).astype(np.float64)  # int without n-grams
            u = (mix(batch.column(1).to_numpy().view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5
            key = weight - np.log(-np.log(u * 2.0**-53))
            own = batch.columns[2:]
            if at_least is None:
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(weight), pa.array(key)], names=[*names, "log_weight", "sample_key"]
                )
            else:
                took = pa.RecordBatch.from_arrays(own, names=names)
                yield took.filter(pa.array(key >= at_least))

    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema.fields, strict=True)]
    more = ["log_weight double", "sample_key double"] if at_least is None else []
    made = plain.mapInArrow(run, ", ".join([*kinds, *more]))
    own = [F.col(n).alias(c) for n, c in zip(names, columns, strict=True)]
    return made.select(*own, *[m.split()[0] for m in more])


def _least_key(scored: DataFrame, take: int | None) -> float:
    """The smallest sample key among the ``take`` largest."""
    if take is None:
        told = scored.agg(F.count_if(F.col("log_weight") > 0), F.count_if(F.col("log_weight") < 0), F.count("*")).first()
        # texts without n-grams weigh 0 and are not favoured; only without a target, where all weigh 0, all are taken
        take = told[0] if told[0] or told[1] else told[2]
    if not take:
        return float("inf")
    keys = with_global_position(scored.select("sample_key"), [F.col("sample_key").desc()])
    found = keys.filter(F.col("position") == take - 1).first()
    return found.sample_key if found else float("-inf")


def resample(docs: DataFrame, labels: DataFrame, take: int | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id``, ``log_weight``, ``sample_key``, ``selected`` of every row."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, max_rows))
    scored = materialise(_weighted(docs, ratios, None, True), "quality")
    return scored.withColumn("selected", F.col("sample_key") >= F.lit(_least_key(scored, take)))


def select_documents(docs: DataFrame, labels: DataFrame, take: int | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """The selected rows of ``docs``; texts are scored where they lie and never shuffled."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, max_rows))
    scored = materialise(_weighted(docs, ratios, None, True), "quality")
    return _weighted(docs, ratios, _least_key(scored, take), False)
