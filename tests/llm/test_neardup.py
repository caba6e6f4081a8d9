import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetlake.llm.neardup import (
    Shingles,
    components,
    consistent_samples,
    document_frequencies,
    idf_table,
    keep_one,
    near_duplicates,
    weighted_jaccard,
)
from fleetlake.llm.queries import op4_near_dedup
from tests.conftest import SF_SMALL


def classes(spark, df):
    """Smallest id of each document's class, by comparing all pairs."""
    docs = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
    table, total = document_frequencies(df)
    assert total == len(docs)
    idf = idf_table(table, total)
    s = Shingles([t for _, t in docs])
    content = s.content([t for _, t in docs])
    sets = []
    for a, b in zip(s.ptr[:-1], s.ptr[1:]):
        weight = s.count[a:b] * idf[(s.hash[a:b] & np.uint64(len(idf) - 1)).astype(int)]
        sets.append((s.hash[a:b], weight.astype(float)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if content[a] == content[b] or weighted_jaccard(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc_id)
    return Counter((i, min((x for x in g if x is not None), default=None)) for g in groups.values() for i in g)


def edited(rng, words, share):
    return " ".join(rng.choice(["zz", "qq", "new"]) + str(rng.randint(0, 999)) if rng.random() < share else w for w in words)


def test_query_matches_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert Counter(map(tuple, op4_near_dedup(spark, SF_SMALL).collect())) == classes(spark, docs)


def test_hot_groups_and_odd_rows_match_all_pairs(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 300)}" for _ in range(200)]
    docs = [(i, edited(rng, base, rng.choice([0.004, 0.01, 0.03, 0.06]))) for i in range(150)]
    docs += [(200 + i, " ".join(base)) for i in range(40)]
    docs += [(300 + i, edited(rng, docs[5][1].split(), 0.005)) for i in range(10)]
    docs += [(400, None), (401, ""), (402, "a b"), (403, "A, b!"), (404, "!!!"), (405, "x " * 30000), (406, "x " * 29000)]
    docs += [(407, "one two three four five"), (407, "one two three four five"), (None, "a b")]
    df = spark.createDataFrame([(*d, 1, 0.5) for d in docs], "doc_id bigint, text string, key int, centre double")
    want = classes(spark, df)
    found = near_duplicates(df.repartition(5))
    assert Counter((r.doc_id, r.group_id) for r in found.collect()) == want
    kept = keep_one(df)
    assert kept.dtypes == df.dtypes
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({g for _, g in want})


def test_samples_collide_with_the_weighted_similarity():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    a = " ".join(words)
    b = re.sub(r"w(\d*7)\b", r"v\1", a) + " " + " ".join(words[:60])
    s = Shingles([a.encode(), b.encode()])
    idf = (1 + np.random.default_rng(rng.randint(0, 9)).random(1 << 10)).astype(np.float32)
    samples = consistent_samples(s, idf, 256)
    sets = [(s.hash[x:y], s.count[x:y] * idf[(s.hash[x:y] & np.uint64(1023)).astype(int)]) for x, y in zip(s.ptr, s.ptr[1:])]
    assert (samples[0] == samples[1]).mean() == pytest.approx(weighted_jaccard(*sets), abs=0.09)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(300, 200), (200, 300)]
    rows = components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert {(r.node, r.root) for r in rows} == (
        {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 120)} | {(300, 200)}
    )
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(df).collect() == [] and keep_one(df).collect() == []


def test_signature_cut_misses_less_than_the_bands():
    from math import ceil, comb

    from fleetlake.llm import neardup as nd

    least = ceil((nd.SIMILARITY - nd.SLACK) * nd.LONG_SAMPLES)
    p, n = nd.SIMILARITY, nd.LONG_SAMPLES
    below = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least))
    assert below < (1 - p**nd.ROWS) ** nd.BANDS


def test_exact_weights_of_many_texts_and_links_that_join_classes():
    import pyarrow as pa

    from fleetlake.llm.neardup import Weighted, _weighted, class_links

    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = []
    for i in range(90):
        words = list(base) if i % 3 else [f"v{i}{rng.randint(0, 99)}" for _ in range(60)]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(words).encode())
    idf = np.linspace(1, 2, 1 << 10, dtype=np.float32)
    w = Weighted(texts, idf)
    each = [_weighted(t, idf) for t in texts]
    others = np.arange(90)
    true = np.array([[weighted_jaccard(a, b) for b in each] for a in each])
    for i in range(90):
        assert np.allclose(w.similarity(i, others), true[i])
    contents = pa.array([f"{i:03d}".encode() for i in range(90)])
    calls = []

    def pairs_of(at, groups):
        return others[(others > at) & (groups != groups[at])]

    links = class_links(contents, np.arange(90), pairs_of, lambda: calls.append(1) or w, 0.7)
    assert len(calls) == 1 and len(links) < 90 and all(true[int(a), int(b)] >= 0.7 for a, b in links)
    # the links' components are those of all similar pairs
    parent = list(range(90))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert root(int(a)) != root(int(b))
        parent[root(int(a))] = root(int(b))
    assert all((root(a) == root(b)) for a in range(90) for b in range(90) if true[a, b] >= 0.7)


@pytest.mark.parametrize("n", [150, 450])
def test_alike_texts_that_are_no_duplicates_leave_few_rows(spark, n):
    """Copies of one text, each with so many edits of its own that hardly two are similar enough."""
    from fleetlake.llm import neardup as nd

    rng = random.Random(n)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(200), 5):
            words[at] = f"e{i}x{at}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows, across = [], nd._across

    def counted(*args):
        found = across(*args)
        rows.append(found.count())
        return found

    nd._across = counted
    try:
        classes = near_duplicates(df).select("doc_id", "class").collect()
    finally:
        nd._across = across
    # of all pairs that share a band and have near signatures, only those leave a task that join classes
    assert len(classes) == n and rows[0] < n


def test_large_classes_are_named_without_a_common_task(spark, monkeypatch):
    from fleetlake.llm import neardup as nd

    monkeypatch.setattr(nd, "LARGE", 2)
    docs = [(i, "one two three four five six " * 9 + f"end{i % 6}") for i in range(10, 40)] + [(1, "alone " * 8), (None, "no id " * 7)]
    found = near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted({(r.group_id, r["class"]) for r in found if (r.doc_id or 0) >= 10}) == [(10, found_class(found, 10))]
    assert [r.group_id for r in found if r.doc_id == 1] == [1] and len(found) == len(docs)


def found_class(rows, doc_id):
    return next(r["class"] for r in rows if r.doc_id == doc_id)
