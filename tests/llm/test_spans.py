import random
import re
import time

from pyspark.sql import functions as F

from fleetlake.llm.personal_data import find_matches, personal_data, redact
from fleetlake.llm.secret_scan import scan
from fleetlake.llm.spans import CONTEXT, MARK, apart, counts_at, matches, outside, replaced, running_max, running_sum


def expected_matches(text, pattern):
    out, tail, at = [], "", 0
    for m in re.finditer(pattern, text):
        gap = text[at : m.start()]
        near = gap[-CONTEXT:]
        before = (tail + near)[-CONTEXT:]
        out.append((m.start(), m.end(), m[0], before))
        listed = len(gap) <= CONTEXT and tail.endswith(MARK) and not re.search(r"\w", near)
        tail = tail if listed else before + MARK
        at = m.end()
    return out


def test_positions_and_contexts_match_a_sequential_scan(spark):
    rng = random.Random(9)
    parts = ["12", "345", ", ", " ", "a", "bc é", "😀", "; ", "x" * 90, "\n", "-" * 30, "w " * 7]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(150)] + ["", "7", "none", "1 " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", matches(F.col("text"), r"[0-9]+", F.lit(True)).alias("m")).collect()
    for r in rows:
        assert [tuple(m) for m in r.m] == expected_matches(texts[r.i], r"[0-9]+"), texts[r.i]


def test_array_scans(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        n = rng.choice([0, 1, 2, 3, 7, 8, 9, 64, 65, 200])
        rows.append((i, [rng.randint(0, 50) for _ in range(n)], sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 40)))))
    df = spark.createDataFrame(rows, "i int, v array<bigint>, q array<bigint>")
    got = df.select(
        "i", running_sum(F.col("v")), running_max(F.col("v"), F.lit(0).cast("bigint")),
        counts_at(F.col("q"), F.col("v"), False), counts_at(F.col("q"), F.col("v"), True),
    ).collect()
    for (_, v, q), (_, sums, tops, below, upto) in zip(rows, got, strict=True):
        assert sums == [sum(v[: k + 1]) for k in range(len(v))] and tops == [max(v[: k + 1]) for k in range(len(v))]
        assert below == [sum(x < y for x in v) for y in q] and upto == [sum(x <= y for x in v) for y in q]


def _spans(rng, n, size, separate):
    out, at = [], 0
    for _ in range(n):
        start = at + rng.randint(0, 9) if separate else rng.randint(0, size)
        out.append((start, start + rng.randint(1, 12), rng.choice("ab")))
        at = out[-1][1]
    return sorted(out)


def test_span_sets_match_brute_force(spark):
    rng, kind = random.Random(3), "array<struct<start:int,end:int,kind:string>>"
    rows = [(i, _spans(rng, rng.randint(0, 25), 0, True), _spans(rng, rng.randint(0, 20), 150, False)) for i in range(80)]
    text = "".join(chr(97 + i % 26) if i % 9 else "é" for i in range(400)) * 30
    df = spark.createDataFrame([(*r, text) for r in rows], f"i int, a {kind}, b {kind}, text string")
    got = df.select(
        apart(F.col("a"), F.col("b")).alias("apart"),
        outside(F.col("b"), F.col("a")).alias("outside"),
        replaced(F.col("text"), F.col("b"), lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))).alias("new"),
    ).collect()
    for (_, a, b), r in zip(rows, got, strict=True):
        assert [tuple(x) for x in r.apart] == [s for s in a if not any(o[0] < s[1] and s[0] < o[1] for o in b)]
        assert sorted(map(tuple, r.outside)) == sorted(s for s in b if not any(o[0] <= s[0] and s[1] <= o[1] for o in a))
        out, at = "", 0
        for s, e, k in b:
            if s >= at:
                out += text[at:s] + f"[{k}]"
            at = max(at, e)
        assert r.new == out + text[at:]


def test_a_hundred_thousand_matches_in_one_text(spark):
    n = 100_000
    numbers = " ".join(f"id {10000 + i}x" for i in range(n))
    mails = " ".join(f"u{i}@example.org" for i in range(n // 4))
    keys = " ".join(f"user=person{i} password=secret{i}" for i in range(n // 4))
    df = spark.createDataFrame([(1, numbers), (2, mails), (3, keys), (4, "one 12345x")], "doc_id bigint, text string")
    begin = time.monotonic()
    found = {r.doc_id: r for r in find_matches(df).select("doc_id", F.size("tokens").alias("t"), F.size("email").alias("e")).collect()}
    assert found[1].t == n and found[2].e == n // 4
    spans = {r.doc_id: r.n for r in personal_data(df).select("doc_id", F.size("base").alias("n")).collect()}
    assert spans == {1: 0, 2: n // 4, 3: 0, 4: 0}
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[2] == " ".join(["[EMAIL]"] * (n // 4)) and clean[3] == keys and clean[4] == "one 12345x"
    secrets = {r.doc_id: r for r in scan(df).select("doc_id", "n_assign", F.size("spans").alias("n")).collect()}
    assert secrets[3].n_assign == n // 4 and secrets[3].n == n // 2
    assert time.monotonic() - begin < 240
