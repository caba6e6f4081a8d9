"""Near-duplicate classes by improved consistent weighted sampling.

1. Equal word sequences share a ``content`` hash and are one text from then on.
2. Document frequencies of five-word shingles are counted over all documents
   in a hashed table of fixed size. Its error is a fixed share of the number
   of documents, so shingles in fewer than ``RARE`` of the documents count as
   equally rare, at any corpus size. A shingle's weight is its count times an
   idf between 1 (in every document) and 2 (rare); the bound keeps a few
   edited words from outweighing the text that copies share.
3. Every text takes ``BANDS * ROWS`` samples whose collision probability is
   the weighted Jaccard similarity; ``ROWS`` samples make a band. Texts of
   similarity 0.8 share none of the bands with probability 1e-5.
4. Texts that share a band are compared by exact weighted Jaccard similarity,
   never all pairs of a band: first each text with the most central text of
   its bands, then with that of each band. Similar pairs join classes, whose
   components are found by joins.
5. What is left are bands that still hold several classes. Their texts get a
   longer signature and are dealt, compressed, into blocks; a task holds two
   blocks and compares signatures across classes. Pairs whose estimate is within
   ``SLACK`` of the threshold (a similar pair is missed with probability below
   1e-5, less than by the bands) are compared exactly in the task. A similar
   pair joins its two classes there and then, and only such pairs leave the
   task: fewer than it has texts, however alike they are.

Cases: texts of one to four words are one shingle; texts without words are
compared by their bytes only; null is empty; equal texts are always one class;
an empty table gives no rows; repeated rows keep a row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import importable, materialise, narrow, text_chunks
from fleetlake.llm.words import ALNUM, Words, mix, ngrams

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
#: Samples of the longer signature, and how far its estimate may lie below the similarity (five deviations).
LONG_SAMPLES = 512
SLACK = 0.09
#: Texts and bytes of text that a block aims at.
BLOCK, BLOCK_BYTES = 512, 1 << 21
#: Contents of a class whose members do not meet in one task, and how many such classes there can be at most.
LARGE, MAX_LARGE = 1000, 1 << 20
TABLE_BITS = 18
RARE = 1 / 256


class Shingles:
    """Different shingles of each text of a chunk with their counts, sorted by text and hash."""

    def __init__(self, texts: list[bytes], shingle: int = SHINGLE):
        self.words = w = Words(texts, ALNUM, lower=True)
        left, n = w.left(), np.repeat(w.n, w.n)
        hashes = ngrams(w.hash, shingle)
        whole = left >= shingle
        for size in np.unique(w.n[(w.n > 0) & (w.n < shingle)]).tolist():
            at = (left == size) & (n == size)
            hashes[at] = ngrams(w.hash, size, 1)[at]
            whole |= at
        doc, hashes = w.doc()[whole], hashes[whole]
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        self.doc, self.hash = doc[at], hashes[at]
        self.count = np.diff(np.append(at, len(doc))).astype(np.float32)
        self.ptr = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def content(self, texts: list[bytes]) -> list[bytes]:
        """128 bits of each text's word sequence; of its bytes where it has no words."""
        w, out = self.words, []
        for i, t in enumerate(texts):
            lo, hi = w.ptr[i], w.ptr[i + 1]
            seen = w.hash[lo:hi].tobytes() if lo < hi else b"bytes " + t
            out.append(hashlib.blake2b(seen, digest_size=16).digest())
        return out


def document_frequencies(docs: DataFrame, bits: int = TABLE_BITS) -> tuple[np.ndarray, int]:
    """Documents per slot of the hashed table, at most ``2**bits`` numbers, and documents in all."""
    importable(docs.sparkSession)
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        table, rows = np.zeros(1 << bits, np.int64), 0
        for _, texts in text_chunks(batches):
            s = Shingles(texts)
            # a slot counts once for each document
            slots = np.unique((s.doc.astype(np.uint64) << np.uint64(bits)) | (s.hash & mask)) & mask
            table += np.bincount(slots.astype(np.int64), minlength=1 << bits)
            rows += len(texts)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(table[used], rows))],
            names=["slot", "n"],
        )

    counted = narrow(docs, "text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    frame = counted.toArrow()
    slot, n = frame["slot"].to_numpy(), frame["n"].to_numpy()
    table = np.zeros((1 << bits) + 1, np.int64)
    table[slot] = n  # slot -1 is the last place: all rows
    return table[:-1], int(table[-1])


def idf_table(table: np.ndarray, rows: int, rare: float = RARE) -> np.ndarray:
    """Weight 1 to 2 of each slot."""
    share = np.clip(table / max(1, rows), rare, 1.0)
    return (1.0 + np.log(share) / np.log(rare)).astype(np.float32)


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at 4096 and its logarithm at 65536 middle quantiles, by bisection of its distribution function."""

    def inverse(n: int) -> np.ndarray:
        p = (np.arange(n) + 0.5) / n
        lo, hi = np.zeros(n), np.full(n, 50.0)
        for _ in range(60):
            mid = (lo + hi) / 2
            low = 1 - (1 + mid) * np.exp(-mid) < p
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        return (lo + hi) / 2

    return inverse(1 << 12).astype(np.float32), np.log(inverse(1 << 16)).astype(np.float32)


_GAMMA, _LOG_GAMMA = _quantiles()
_SEEDS = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C13))


def consistent_samples(s: Shingles, idf: np.ndarray, samples: int) -> np.ndarray:
    """One 64-bit sample per text and hash function; texts without shingles have zeros."""
    docs = len(s.ptr) - 1
    out = np.zeros((docs, samples), np.uint64)
    some = np.flatnonzero(np.diff(s.ptr))
    if not len(some):
        return out
    begin = s.ptr[some]
    own = np.repeat(np.arange(len(some)), np.diff(s.ptr)[some])
    log_weight = np.log(s.count * idf[(s.hash & np.uint64(len(idf) - 1)).astype(np.int64)])
    for k in range(samples):
        # one mixed number gives the three variates of an element: r, ln c and beta
        x = mix(s.hash ^ _SEEDS[k])
        r = _GAMMA[(x & np.uint64(0xFFF)).astype(np.int64)]
        log_c = _LOG_GAMMA[((x >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (x >> np.uint64(28)).astype(np.float32) * np.float32(2.0**-36)
        t = np.floor(log_weight / r + beta)
        log_a = log_c - r * (t - beta + np.float32(1))
        low = np.minimum.reduceat(log_a, begin)
        at = np.flatnonzero(log_a == low[own])
        at = at[np.append(True, own[at][1:] != own[at][:-1])]  # equal minima: the smaller hash
        out[some, k] = mix(x[at] + (t[at].astype(np.int64)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C13))
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per text and band, different for different bands."""
    return np.stack([ngrams_of(samples[:, b * rows : (b + 1) * rows], b) for b in range(bands)], axis=1)


def ngrams_of(columns: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(columns), _SEEDS[1000 - salt], np.uint64)
    for j in range(columns.shape[1]):
        out = mix(out ^ columns[:, j])
    return out


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """a and b: sorted hashes and weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum()) + float(b[1].sum()) - low
    return low / total if total else 0.0


def _weighted(text: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = Shingles([text])
    return s.hash, s.count.astype(np.float64) * idf[(s.hash & np.uint64(len(idf) - 1)).astype(np.int64)]


def signatures(docs: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``content``, ``keys`` (one per band; none for wordless texts), ``centre``, ``bytes``."""

    def run(batches):
        for batch, texts in text_chunks(batches):
            s = Shingles(texts)
            keys = band_keys(consistent_samples(s, idf.value, bands * rows), bands, rows).view(np.int64)
            has = np.diff(s.ptr) > 0
            # mean weight of a shingle: low where a text has little that few others have
            weight = s.count * idf.value[(s.hash & np.uint64(len(idf.value) - 1)).astype(np.int64)]
            centre = np.bincount(s.doc, weight, len(texts)) / np.maximum(1, np.bincount(s.doc, s.count, len(texts)))
            offsets = np.concatenate(([0], np.cumsum(has * bands))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(s.content(texts), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel())),
                    pa.array(centre),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                names=["doc_id", "text_key", "content", "keys", "centre", "bytes"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    keyed = narrow(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(
        run, f"doc_id {kind}, text_key bigint, content binary, keys array<bigint>, centre double, bytes bigint"
    )


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``node``, ``root`` (smallest node of its component) of an undirected graph ``a``, ``b``, by two-step stars.

    Each round joins every node's larger neighbours, then its smaller ones, to
    its smallest neighbour; rounds grow as the logarithm of the longest path.
    """
    links = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialise(large, tag)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        links = materialise(small.filter("a > b").distinct(), tag)
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs ``a``, ``b`` of contents whose weighted Jaccard similarity is at least ``least``."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            left, right = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            known: tuple = (None, None)
            good = []
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                if known[0] != y:
                    known = (y, _weighted(y, idf.value))
                if weighted_jaccard(_weighted(x, idf.value), known[1]) >= least:
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``doc_id``, ``text_key``, ``content``, ``group_id`` (smallest id of its class) of every row."""
    spark = docs.sparkSession
    table, total = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(table, total))
    signed = materialise(signatures(docs, idf, bands, rows), "signatures")
    contents = signed.groupBy("content").agg(
        F.first("keys").alias("keys"), F.min("centre").alias("centre"), F.min("bytes").alias("bytes")
    )
    band = contents.select("content", "centre", "bytes", F.explode("keys").alias("key"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES)))
    shared = (
        band.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("size"),
            blocks.cast("int").alias("blocks"),
            F.min(F.struct("centre", "content")).alias("first"),
        )
        .filter("size > 1")
    )
    shared = materialise(shared.select("key", "blocks", "first"), "shared-bands")
    # members of bands that hold different texts, with the most central text of the band
    members = materialise(band.select("key", "content").join(shared, "key"), "bands")
    involved = members.select("content").distinct()
    firsts = signed.join(involved, "content").groupBy("content").agg(F.min(F.struct("doc_id", "text_key")).alias("d"))
    keyed = narrow(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    texts = materialise(
        keyed.join(firsts.select("content", F.col("d.doc_id").alias("i"), F.col("d.text_key").alias("k")), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("text_key").eqNullSafe(F.col("k")))
        .select("content", F.coalesce("text", F.lit("")).alias("text"))
        .dropDuplicates(["content"]),
        "near-texts",
    )
    # each text with the most central of its bands' first texts, then with the first texts of all its bands
    stars = members.filter("content != first.content").select(F.col("content").alias("a"), "first").distinct()
    tested = materialise(stars.groupBy("a").agg(F.min("first").alias("f")).select("a", F.col("f.content").alias("b")), "pairs")
    links = materialise(_verified(tested, texts, idf, similarity), "links")
    roots = components(links)
    rest = _unlinked(stars.select("a", F.col("first.content").alias("b")), roots).join(tested, ["a", "b"], "left_anti")
    links = links.unionByName(materialise(_verified(materialise(rest, "pairs"), texts, idf, similarity), "links"))
    roots = components(links)
    # bands that still hold several classes
    links = links.unionByName(materialise(_across(members, roots, texts, idf, similarity), "links"))
    roots = components(links)
    own = signed.groupBy("content").agg(F.min("doc_id").alias("least"))
    met = own.join(roots, own["content"] == roots["node"], "left").withColumn("root", F.coalesce("root", "content"))
    named = _named(materialise(met.drop("node"), "contents"))
    return signed.select("doc_id", "text_key", "content").join(named, "content")


def _named(contents: DataFrame) -> DataFrame:
    """``content``, ``group_id`` and ``class`` from ``content``, the ``root`` of its class and its ``least`` id.

    The join by class would bring a large class into one task. Classes of more
    than ``t`` contents are therefore broadcast, with ``t`` so large that there
    are fewer than ``MAX_LARGE`` of them whatever the input.
    """
    classes = materialise(
        contents.groupBy("root").agg(F.min("least").alias("group_id"), F.count(F.lit(1)).alias("n")), "classes"
    )
    large = F.col("n") > max(LARGE, contents.count() // MAX_LARGE)
    hot = F.broadcast(classes.filter(large).drop("n"))
    small = classes.filter(~large).drop("n")
    met = contents.join(hot, "root").unionByName(contents.join(hot, "root", "left_anti").join(small, "root"))
    return met.select("content", "group_id", F.hex("root").alias("class"))


def _rooted(frame: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    own = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return frame.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def _unlinked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    return _rooted(_rooted(pairs, roots, "a", "ra"), roots, "b", "rb").filter("ra != rb").select("a", "b")


def _long_signatures(texts: DataFrame, idf) -> DataFrame:
    """``content``, ``long`` (one byte of each of ``LONG_SAMPLES`` samples, equal by chance once in 256), ``frame``."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch, chunk in text_chunks(batches):
            samples = consistent_samples(Shingles(chunk), idf.value, LONG_SAMPLES).astype(np.uint8)
            columns = [pa.array([x.tobytes() for x in samples], pa.binary()), pa.array(map(pack, chunk), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["content", "long", "frame"])

    return texts.select("content", "text").mapInArrow(run, "content binary, long binary, frame binary")


class Weighted:
    """Shingle weights of several texts, to compare one with many exactly."""

    def __init__(self, texts: list[bytes], idf: np.ndarray):
        s = Shingles(texts)
        self.ptr = s.ptr
        self.weight = s.count.astype(np.float64) * idf[(s.hash & np.uint64(len(idf) - 1)).astype(np.int64)]
        different, self.place = np.unique(s.hash, return_inverse=True)
        self.own = np.zeros(len(different))
        self.total = np.bincount(s.doc, self.weight, len(texts))

    def similarity(self, one: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of text ``one`` with each of ``others``, none of which is without shingles."""
        mine = slice(self.ptr[one], self.ptr[one + 1])
        self.own[self.place[mine]] = self.weight[mine]
        size = self.ptr[others + 1] - self.ptr[others]
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.ptr[others] - begin, size)
        low = np.add.reduceat(np.minimum(self.weight[at], self.own[self.place[at]]), begin)
        self.own[self.place[mine]] = 0
        return low / (self.total[one] + self.total[others] - low)


def class_links(
    contents: pa.Array, groups: np.ndarray, pairs_of, weighted, similarity: float
) -> list[tuple]:
    """Pairs of similar texts that join different classes, one for each time two become one.

    ``pairs_of(at, groups)`` gives the texts of other classes that text ``at``
    may be similar to; ``weighted()`` makes the exact weights when first needed.
    """
    groups, exact, out = groups.copy(), None, []
    for at in range(len(groups)):
        others = pairs_of(at, groups)
        if not len(others):
            continue
        exact = exact or weighted()
        for b in others[exact.similarity(at, others) >= similarity].tolist():
            if groups[b] != groups[at]:
                groups[groups == groups[b]] = groups[at]
                x, y = contents[at].as_py(), contents[b].as_py()
                out.append((max(x, y), min(x, y)))
    return out


def _across(members: DataFrame, roots: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` that join different classes with a common band."""
    rooted = _rooted(members.select("key", "blocks", "content"), roots, "content", "r")
    split = rooted.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo != hi").select("key")
    rooted = materialise(rooted.join(materialise(split, "open-bands"), "key", "left_semi"), "open-members")
    involved = rooted.select("content").distinct()
    long = materialise(_long_signatures(texts.join(involved, "content", "left_semi"), idf), "long-signatures")
    own = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    # a text meets every block of its band, in the task of the two blocks
    dealt = (
        rooted.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(long, "content")
        .select(
            "key",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            "own",
            "content",
            F.xxhash64("r").alias("r"),
            "long",
            "frame",
        )
    )
    place = ["key", "i", "j"]
    dealt = dealt.repartition(*place).sortWithinPartitions(*place)
    least = int(np.ceil((similarity - SLACK) * LONG_SAMPLES))

    def close(rows: pa.RecordBatch) -> list[tuple]:
        own, groups = rows.column(3).to_numpy(), rows.column(5).to_numpy()
        if len(own) < 2 or (groups == groups[0]).all():
            return []
        sig = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint8).reshape(len(own), -1)
        i, j = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        left, right = own == i, np.flatnonzero(own == j)

        def pairs_of(at: int, now: np.ndarray) -> np.ndarray:
            if not left[at]:
                return right[:0]
            others = right[right > at] if i == j else right
            others = others[now[others] != now[at]]
            return others[(sig[others] == sig[at]).sum(axis=1) >= least]

        def weighted() -> Weighted:
            unpack = zstandard.ZstdDecompressor().decompress
            return Weighted([unpack(f) for f in rows.column(7).to_pylist()], idf.value)

        return class_links(rows.column(4), groups, pairs_of, weighted, similarity)

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([kept, batch] if kept is not None else [batch]).combine_chunks()
            batch = table.to_batches()[0] if len(table) else batch
            keys = [batch.column(c).to_numpy() for c in range(3)]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cuts = [0, *new.tolist()]
            found = [p for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for p in close(batch.slice(lo, hi - lo))]
            kept = batch.slice(cuts[-1])
            yield _pairs(found)
        if kept is not None and len(kept):
            yield _pairs(close(kept))

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"]
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the smallest id (null last), then text hash."""
    found = near_duplicates(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    kept = found.groupBy("class").agg(first.alias("d")).select("d.*").distinct()
    kept = kept.select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"))
    key = F.xxhash64(docs["text"])
    copy = Window.partitionBy(docs["doc_id"], key).orderBy(F.lit(0))
    return (
        docs.join(kept, docs["doc_id"].eqNullSafe(F.col("i")) & key.eqNullSafe(F.col("k")), "left_semi")
        .withColumn("_copy", F.row_number().over(copy))
        .filter("_copy = 1")
        .drop("_copy")
    )
