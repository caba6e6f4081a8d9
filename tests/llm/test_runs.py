import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np

from fleetlake.llm import runs as module
from fleetlake.llm.queries import ORACLE, op13_runs
from fleetlake.llm.runs import chunk_runs, periodic_runs
from fleetlake.llm.words import NON_BLANK, Words
from tests.conftest import SF_SMALL


def brute_force(words, exponent=4, min_words=6):
    """(start, length, period) of all runs, by start and period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    rows = [(s, e - s, q) for (s, e), q in found.items() if e - s >= max(min_words, exponent * q)]
    return sorted(rows, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng, size):
    words = [rng.choice(rng.choice(["ab", "abc", "a", "abcd"])) for _ in range(size)]
    for _ in range(rng.randint(0, 2)):
        if words:
            s, p = rng.randrange(len(words)), rng.randint(1, 6)
            e = rng.randint(s, len(words))
            words[s:e] = [words[s + i % p] if s + i % p < len(words) else "a" for i in range(e - s)]
    return words


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    rel = con.sql(ORACLE["op13_runs"])
    got = op13_runs(spark, SF_SMALL)
    assert got.columns == rel.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(rel.fetchall())
    assert any(r[1] for r in rows) and not all(r[1] for r in rows)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in op13_runs(spark, SF_SMALL).collect()}
    for i, text in [(d.doc_id, d.text) for d in docs if len(d.text) < 4000]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = brute_force(words)
        r = rows[i]
        assert r.n_runs == len(runs)
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)


def test_random_texts_match_brute_force():
    rng = random.Random(13)
    for _ in range(150):
        texts = [random_words(rng, rng.randint(0, 60)) for _ in range(rng.randint(1, 6))]
        w = Words([" ".join(t).encode() for t in texts], NON_BLANK, lower=False)
        for exponent, least in ((4, 6), (2, 2), (3, 4)):
            owner, runs = chunk_runs(w, exponent, least)
            got = [[] for _ in texts]
            for o, (s, e, q) in zip(owner.tolist(), runs.tolist(), strict=True):
                got[o].append((s - int(w.ptr[o]), e - s, q))
            assert got == [brute_force(t, exponent, least) for t in texts]


def test_equal_hashes_of_different_words_make_no_runs(spark, monkeypatch):
    monkeypatch.setattr(module, "mix", lambda x: np.full_like(x, 5))
    texts = [["a", "b", "c", "d", "e", "f", "g"], ["x"] * 8, ["a", "b"] * 5 + ["b"]]
    w = Words([" ".join(t).encode() for t in texts], NON_BLANK, lower=False)
    owner, runs = chunk_runs(w)
    assert list(zip(owner.tolist(), runs.tolist(), strict=True)) == [(1, [7, 15, 1]), (2, [15, 25, 2])]


def test_operator_rows_and_odd_cases(spark):
    rng = random.Random(5)
    texts = [" ".join(random_words(rng, 80)) for _ in range(40)]
    texts += [None, "", " \t\n\x0b ", "é😀 " * 9, "one", "a\tb\n" * 50 + "c", texts[0], "x " * 20000]
    df = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in enumerate(texts)], "id int, body string, text string, runs int, n_words int")
    found = periodic_runs(df.repartition(5), "id", "body", keep=["text"])
    assert found.columns == ["id", "text", "n_words", "runs", "collapsed"]
    rows = {r.id: r for r in found.collect()}
    for i, text in enumerate(texts[:-1]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute_force(words)
        assert rows[i].n_words == len(words) and [tuple(r) for r in rows[i].runs] == runs
        assert rows[i].collapsed == collapse(words, runs)
    assert [tuple(r) for r in rows[len(texts) - 1].runs] == [(0, 20000, 1)] and rows[len(texts) - 1].collapsed == "x"
    assert periodic_runs(df.limit(0), "id", "body").collect() == []


def test_very_long_text_is_quick():
    text = b"a b a c " * 60000 + " ".join(f"w{i}" for i in range(100000)).encode()
    begin = time.monotonic()
    _, runs = chunk_runs(Words([text], NON_BLANK, lower=False))
    assert runs.tolist() == [[0, 240000, 4]] and time.monotonic() - begin < 30
