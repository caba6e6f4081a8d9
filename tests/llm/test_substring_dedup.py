import hashlib
import random
import re

import duckdb

from fleetlake.llm.queries import ORACLE, op10_substring_dedup
from fleetlake.llm.substring_dedup import long_spans, remove_ranges, remove_repeats
from tests.conftest import SF_SMALL


def expected(docs, span):
    """Rows (n_words, n_removed, kept_sha256); docs in the order of their ids."""
    seen, out = set(), []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - span + 1):
            window = tuple(words[i : i + span])
            if window in seen:
                gone |= set(range(i, i + span))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    rel = con.sql(ORACLE["op10_substring_dedup"])
    got = op10_substring_dedup(spark, SF_SMALL)
    assert got.columns == rel.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_small_alphabets_match_brute_force(spark):
    rng = random.Random(1)
    for span, gram, letters in ((5, 2, "ab"), (4, 4, "abc"), (6, 3, ["x", "é😀", "yy"])):
        docs = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(60)]
        docs += [(60, None), (61, ""), (62, "a\t b\n" * 3000), (63, docs[0][1]), (64, " \x0b ")]
        df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, start int, seed int")
        rows = {r.doc_id: r for r in remove_repeats(df.repartition(7), span, gram).collect()}
        assert [(rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) for i, _ in docs] == expected(docs, span)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + " more"), (2, "short")], "doc_id int, text string")
    rows = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert rows == [("1", 30, 30), ("1", 30, 30), ("2", 1, 0), ("None", 31, 0)]
    assert remove_repeats(df.limit(0)).collect() == []
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_rows_of_one_id_whose_short_text_hashes_meet(spark):
    """Two different texts without id and with one 32-bit hash: neither loses words that stand nowhere else."""
    seen = {}
    for start in range(0, 10**6, 50000):
        df = spark.range(start, start + 50000).selectExpr("concat('only ', id, ' here') t").selectExpr("t", "hash(t) h")
        for t, h in df.collect():
            seen.setdefault(h, []).append(t)
        pair = next((x for x in seen.values() if len(x) > 1), None)
        if pair:
            break
    assert len(pair) == 2
    df = spark.createDataFrame([(None, t) for t in pair] + [(1, "one two")], "doc_id bigint, text string")
    rows = remove_repeats(df, 2, 2).collect()
    assert sum(r.n_removed for r in rows) == 0 and sum(r.n_words for r in rows) == 8


def test_words_with_equal_hashes_are_told_apart_by_their_bytes():
    import numpy as np

    from fleetlake.llm.substring_dedup import byte_hashes, paths
    from fleetlake.llm.words import NON_BLANK, Words

    texts = [" ".join(f"a{i}" for i in range(30)).encode(), "\n".join(f"b{i}" for i in range(30)).encode()]
    w = Words(texts, NON_BLANK, lower=False)
    w.hash = np.tile(w.hash[:30], 2)  # as if every word of one text collided with one of the other
    seed, path, at, count = paths(w, 20, 6)
    half = len(at) // 2
    assert (seed[:half] == seed[half:]).all() and (path[:half] != path[half:]).all()
    # the same words behind other blanks have the same bytes
    again = Words([b"x  y\tz", b"q x y z"], NON_BLANK, lower=False)
    assert byte_hashes(again, np.array([0]), np.array([3])) == byte_hashes(again, np.array([4]), np.array([7]))


def test_ranges_are_verified_by_the_words_at_the_source(spark):
    """Ranges as colliding hashes would give them: only runs that are the source's words go."""
    from pyspark.sql import functions as F

    first = [f"w{i}" for i in range(200)]
    later = ["q"] * 3 + first[10:190]
    later[3 + 100] = "other"  # word 110 of the source
    later[3 + 108] = "other"  # between them 7 equal words, too few
    docs = [(None, " ".join(first)), (7, "\n".join(later)), (8, " ".join(f"u{i}" for i in range(50))), (9, " ".join(first[60:130]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    key = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    rows = [
        (7, key[7], 3, 183, None, key[None], -7),
        (8, key[8], 5, 45, None, key[None], 5),  # not one word is the source's
        (9, key[9], 0, 70, None, key[None], -60),
    ]
    ranges = spark.createDataFrame(
        rows, "doc_id bigint, text_key bigint, lo int, hi int, from_id bigint, from_key bigint, shift int"
    )
    got = {r.doc_id: r for r in remove_ranges(df, ranges).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {None: 0, 7: 100 + 71, 8: 0, 9: 70}
    kept = " ".join([*later[:3], *later[103:112]])
    assert got[7].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_finds_at_one_distance_from_one_source_are_one_span(spark):
    rows = [(1, 5, lo, lo + 20, 0, 4, shift) for lo, shift in ((0, 3), (7, 3), (27, 3), (48, 3), (7, 2))]
    spans = spark.createDataFrame(
        rows, "doc_id int, text_key bigint, lo int, hi int, from_id int, from_key bigint, shift int"
    )
    got = sorted((r["shift"], r.lo, r.hi) for r in long_spans(spans).collect())
    assert got == [(2, 7, 27), (3, 0, 47), (3, 48, 68)]


def test_too_many_words_in_one_text_stop_the_job(monkeypatch):
    import pytest

    from fleetlake.llm import substring_dedup as module
    from fleetlake.llm.words import NON_BLANK, Words

    monkeypatch.setattr(module, "POSITION_BITS", 5)
    with pytest.raises(ValueError, match="positions"):
        module.paths(Words([b"w " * 40], NON_BLANK, lower=False), 20, 6)
