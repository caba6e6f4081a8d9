"""Threshold-scaled document sketches.

A sketch holds every shingle hash (five words) below a fixed fraction of the
hash range, so its size follows the text's, sketches of parts merge into the
sketch of the whole, and containment can be estimated between very unequal
texts. A text of fewer than ``WHOLE`` different shingles (or with none below
the threshold) keeps them all, flagged by ``FLAG`` at the end: two such sketches
are compared exactly, and against a scaled one only the hashes below the
threshold count. Hashes are stored as 48 bits.

Cases: a text of one to four words is one shingle; a text without words is
one shingle of its bytes; null and empty text has the empty sketch. Two empty
sketches are alike (1), one empty and one not are unlike (0). Equal texts have
equal sketches. Neighbours are taken in descending ``doc_id``, nulls last,
repeated ids by text hash; the last one's neighbour is the first, so a single
row is its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fleetlake.llm.common import importable, materialise, narrow, text_chunks
from fleetlake.llm.words import ALNUM, Words, ngrams

SHINGLE = 5
FRACTION = 1 / 4
WHOLE = 64
#: Last of a sketch that holds all shingles.
FLAG = (1 << 48) - 1


def sketches(texts: list[bytes], fraction: float = FRACTION, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 48-bit hashes of each text's sketch."""
    w = Words(texts, ALNUM, lower=True)
    left, n = w.left(), np.repeat(w.n, w.n)
    limit = np.uint64(int(fraction * 2**48))
    flag = np.array([FLAG], np.uint64)
    whole = left >= shingle
    hashes = ngrams(w.hash, shingle)
    for size in np.unique(w.n[(w.n > 0) & (w.n < shingle)]).tolist():
        at = (left == size) & (n == size)
        hashes[at] = ngrams(w.hash, size, 1)[at]
        whole |= at
    at = np.flatnonzero(whole)
    kept, cut = hashes[at] >> np.uint64(16), np.searchsorted(at, w.ptr)
    out = []
    for i, text in enumerate(texts):
        x = np.unique(kept[cut[i] : cut[i + 1]])
        if not len(x) and text:
            x = np.array([int.from_bytes(hashlib.sha256(text).digest()[:6], "big")], np.uint64)
        if len(x) and (len(x) < WHOLE or x[0] >= limit):
            x = np.concatenate([x, flag])
        else:
            x = x[: np.searchsorted(x, limit)]
        out.append(x)
    return out


def _comparable(a: np.ndarray, b: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of two whole sets, else of both those below the threshold."""
    if len(a) and len(b) and a[-1] == b[-1] == FLAG:
        return a[:-1], b[:-1]
    limit = np.uint64(int(fraction * 2**48))
    return tuple(x[: min(np.searchsorted(x, limit), len(x) - (x[-1:] == FLAG).sum())] for x in (a, b))


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Jaccard similarity of two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = _comparable(a, b, fraction)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimated share of a that b holds; not a number when no hash of a can be compared with b's."""
    if not len(a) or not len(b):
        return float(not len(a))
    a, b = _comparable(a, b, fraction)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else float("nan")


def packed(sketch: np.ndarray) -> bytes:
    """Six bytes a hash, big-endian, ascending."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """``doc_id``, ``fingerprint``: the sketch in hex, twelve digits a hash."""
    importable(docs.sparkSession)

    def run(batches):
        for batch, texts in text_chunks(batches):
            made = pa.array([packed(x) for x in sketches(texts, fraction)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "sketch"])

    kind = dict(docs.dtypes)["doc_id"]
    made = narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, sketch binary")
    return made.select("doc_id", F.lower(F.hex("sketch")).alias("fingerprint"))


def _hashes(prints: DataFrame, key: str) -> DataFrame:
    """``key``, ``whole`` and each ``hash`` of ``fingerprint`` (flags left out)."""
    flag = f"{FLAG:012x}"
    listed = F.filter(F.regexp_extract_all("fingerprint", F.lit("(.{12})"), F.lit(1)), lambda h: h != flag)
    return prints.select(key, F.endswith("fingerprint", F.lit(flag)).alias("whole"), F.explode(listed).alias("hash"))


def merge(prints: DataFrame, key: str, fraction: float = FRACTION) -> DataFrame:
    """``key`` and the ``fingerprint`` of all shingles of its rows, as the sketch of their union."""
    limit = F.lit(f"{int(fraction * 2**48):012x}")
    below = F.col("hash") < limit if fraction < 1 else F.lit(True)
    all_whole = F.min(F.when(F.col("fingerprint") != "", F.endswith("fingerprint", F.lit(f"{FLAG:012x}"))))
    groups = prints.groupBy(key).agg(all_whole.alias("all_whole")).withColumnRenamed(key, "k")
    each = _hashes(prints, key).select(F.col(key).alias("g"), "hash").distinct()
    union = each.groupBy("g").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list("hash")).alias("all"),
        F.array_sort(F.collect_list(F.when(below, F.col("hash")))).alias("low"),
    )
    short = F.col("all_whole") & ((F.col("n") < WHOLE) | (F.size("low") == 0))
    made = F.when(short, F.concat(F.array_join("all", ""), F.lit(f"{FLAG:012x}"))).otherwise(F.array_join("low", ""))
    joined = groups.join(union, F.col("k").eqNullSafe(F.col("g")), "left")
    return joined.select(F.col("k").alias(key), F.coalesce(made, F.lit("")).alias("fingerprint"))


def containments(pairs: DataFrame, prints: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """``a``, ``b`` of ``pairs`` (ids, each with one print) and the ``share`` of a's shingles that b holds; null if unknown."""
    limit = F.lit(f"{int(fraction * 2**48):012x}")
    flag = F.lit(f"{FLAG:012x}")
    info = prints.select("doc_id", F.endswith("fingerprint", flag).alias("whole"), (F.col("fingerprint") == "").alias("empty"))
    a, b = (info.select(*[F.col(c).alias(f"{x}_{c}") for c in info.columns]) for x in "ab")
    told = pairs.select("a", "b").distinct()
    told = told.join(a, F.col("a") == F.col("a_doc_id")).join(b, F.col("b") == F.col("b_doc_id"))
    held = _hashes(prints, "doc_id")
    own = held.select(F.col("doc_id").alias("a"), "hash")
    other = held.select(F.col("doc_id").alias("b"), "hash", F.lit(1).alias("hit"))
    usable = (F.col("a_whole") & F.col("b_whole")) | (F.col("hash") < limit) | F.lit(fraction >= 1)
    counted = (
        told.join(own, "a").filter(usable).join(other, ["b", "hash"], "left").groupBy("a", "b")
        .agg((F.count("hit") / F.count("*")).alias("share"))
    )
    share = F.when(F.col("a_empty"), 1.0).when(F.col("b_empty"), 0.0).otherwise(F.col("share"))
    return told.join(counted, ["a", "b"], "left").select("a", "b", share.alias("share"))


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by as many from the head of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compare(texts: list[bytes], others: list[bytes] | None, fraction: float) -> list[tuple]:
    """Results of each text with its neighbour; without ``others`` that is the text behind it, and the last has none."""
    chain = others is None
    heads, others = (texts[:-1], texts[1:]) if chain else (texts, others)
    changed = [edited(a.decode(), b.decode()).encode() for a, b in zip(heads, others, strict=True)]
    own, new = sketches(texts, fraction), sketches(changed, fraction)
    next_ = own[1:] if chain else sketches(others, fraction)
    return [
        (
            len(t.decode()),
            hashlib.sha256(c).hexdigest(),
            packed(a),
            *_difference(a, e),
            likeness(a, e, fraction),
            likeness(a, b, fraction),
        )
        for t, c, a, b, e in zip(heads, changed, own[: len(heads)], next_, new, strict=True)
    ]


def _difference(base: np.ndarray, other: np.ndarray) -> tuple[bytes, bytes]:
    """``other`` as a bit for each hash of ``base`` that it has, and the packed hashes that only it has."""
    return np.packbits(np.isin(base, other)).tobytes(), packed(np.setdiff1d(other, base, assume_unique=True))


def _unpacked(sketch: bytes) -> np.ndarray:
    wide = np.zeros((len(sketch) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(sketch, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def _restored(sketch: bytes, shared: bytes, more: bytes) -> bytes:
    base = _unpacked(sketch)
    same = np.unpackbits(np.frombuffer(shared, np.uint8), count=len(base)).astype(bool)
    return packed(np.sort(np.concatenate([base[same], _unpacked(more)])))


_RESULT = (
    "n_chars bigint, edited_sha256 string, sketch binary, shared binary, more binary, near_edited double, near_next double"
)
_RESULT_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_FIELDS = len(_RESULT_TYPES)


def compare_neighbours(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Each text's sketch against its edited text's and the next document's.

    The texts are range-partitioned by descending id, compressed, so neighbours
    lie side by side; only the first and last text of each task are kept aside
    and joined with those of the tasks around it. Of the edited text's sketch,
    half of which is the text's own, only the difference is stored in between.
    """
    importable(docs.sparkSession)
    kind, arrow = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", *[c.split()[0] for c in _RESULT.split(", ")], "part", "head", "tail"]
    final = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [arrow, *_RESULT_TYPES, pa.int32(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

    def compressed(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch, texts in text_chunks(batches):
            frames = pa.array(map(pack, texts), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], frames], names=["doc_id", "text_key", "row", "frame"])

    def frame_chunks(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            lo, texts, size = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(unpack(batch.column(1)[i].as_py()))
                size += len(texts[-1])
                if size > 1 << 19:
                    yield batch.slice(lo, i + 1 - lo), texts
                    lo, texts, size = i + 1, [], 0
            if texts:
                yield batch.slice(lo), texts

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for batch, texts in frame_chunks(batches):
            ids = batch.column(0).to_pylist()
            rows = []
            if last is None:
                rows.append((*[None] * (1 + _FIELDS), part, texts[0], None))
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = (ids[-1], texts[-1])
            made = _compare(texts, None, fraction)
            rows += [(i, *m, None, None, None) for i, m in zip(ids[:-1], made, strict=True)]
            yield table(rows)
        if last is not None:
            yield table([(last[0], *[None] * _FIELDS, part, None, last[1])])

    def finish(batches):
        for batch, texts in text_chunks(batches):
            others = batch.column(2).to_pylist()
            made = list(zip(*_compare(texts, others, fraction), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(made, _RESULT_TYPES, strict=True)]],
                names=names[: 1 + _FIELDS],
            )

    def restored(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sketch, *rest = (part.column(3 + i).to_pylist() for i in range(3))
                prints = [pa.array(x, pa.string()) for x in (
                    [x.hex() for x in sketch],
                    [_restored(*x).hex() for x in zip(sketch, *rest, strict=True)],
                )]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *prints, *part.columns[6:]], names=final)

    order = [F.col("doc_id").desc_nulls_last(), F.col("text_key"), F.col("row")]
    keyed = narrow(docs, "text", "doc_id").select(
        "text", "doc_id", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row")
    )
    sorted_ = (
        keyed.mapInArrow(compressed, f"doc_id {kind}, text_key bigint, row bigint, frame binary")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "frame")
    )
    made = materialise(
        sorted_.mapInArrow(run, f"doc_id {kind}, {_RESULT}, part int, head binary, tail binary"), "neighbours"
    )
    ring = Window.orderBy("part")  # one row for each task
    heads = made.filter("head IS NOT NULL").select("part", "head")
    links = heads.select("part").withColumn(
        "next_part", F.coalesce(F.lead("part").over(ring), F.min("part").over(ring))
    )
    tails = (
        made.filter("tail IS NOT NULL")
        .select("doc_id", F.col("tail").alias("text"), "part")
        .join(links, "part")
        .join(heads.select(F.col("part").alias("next_part"), F.col("head").alias("next")), "next_part")
        .select("doc_id", "text", "next")
    )
    inner = made.filter("part IS NULL").select(*names[: 1 + _FIELDS])
    out = inner.unionByName(tails.mapInArrow(finish, f"doc_id {kind}, {_RESULT}"))
    return out.mapInArrow(
        restored,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
