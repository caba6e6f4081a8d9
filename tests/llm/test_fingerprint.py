import hashlib

from fleetlake.llm.fingerprint import (
    compare_neighbours,
    containment,
    containments,
    fingerprints,
    likeness,
    merge,
    sketches,
)
from fleetlake.llm.queries import op5_fingerprint
from tests.conftest import SF_SMALL


def check_neighbours(rows, docs):
    """docs: (doc_id, text) in descending order."""
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) == len(got)
    own = {i: sketches([(t or "").encode()])[0] for i, t in docs}
    for at, (i, text) in enumerate(docs):
        text, (j, other) = text or "", docs[(at + 1) % len(docs)]
        half = len(text) // 2
        new = text[: len(text) - half] + (other or "")[:half]
        r = got[i]
        sketch = sketches([new.encode()])[0]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{int(x):012x}" for x in own[i])
        assert r.edited_fingerprint == "".join(f"{int(x):012x}" for x in sketch)
        assert (r.near_edited, r.near_next) == (likeness(own[i], sketch), likeness(own[i], own[j]))


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    check_neighbours(op5_fingerprint(spark, SF_SMALL).collect(), sorted(map(tuple, docs), reverse=True))


def test_edge_cases_and_clashing_columns(spark):
    docs = [(9, "a b c d e f g"), (7, None), (6, ""), (5, "!!!"), (4, "one two"), (3, "ñ😀é x"), (1, "a b c d e f g")]
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id bigint, text string, part int, tail string")
    check_neighbours(compare_neighbours(df.repartition(5)).collect(), docs)
    made = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    assert made[9] == made[1] != "" and made[7] == made[6] == "" and made[5] != ""
    one = compare_neighbours(df.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert compare_neighbours(df.limit(0)).collect() == []


def test_containment_of_unequal_texts():
    words = [f"w{i}" for i in range(40000)]
    part, whole = sketches([" ".join(words[:4000]).encode(), " ".join(words).encode()])
    assert containment(part, whole) > 0.98
    assert 0.05 < containment(whole, part) < 0.15


def test_short_texts_are_compared_exactly_and_found_in_long_ones():
    for n in (6, 20, 60):
        one, two = [f"w{i}" for i in range(n)], [f"w{i}" for i in range(n // 2 + 2)] + [f"v{i}" for i in range(n // 3)]
        a, b = sketches([" ".join(one).encode(), " ".join(two).encode()])
        of = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert likeness(a, b) == len(of(one) & of(two)) / len(of(one) | of(two))
    long = [f"w{i}" for i in range(4000)]
    for at in range(0, 3900, 100):
        part, whole = sketches([" ".join(long[at : at + 40]).encode(), " ".join(long).encode()])
        assert containment(part, whole) == 1.0


def test_merge_and_containments_as_tables(spark):
    words = [f"w{i}" for i in range(3000)]
    docs = [(1, " ".join(words[:1504])), (2, " ".join(words[1500:])), (3, " ".join(words)), (4, " ".join(words[:30])),
            (5, " ".join(words[26:50])), (6, " ".join(words[:50])), (7, "")]
    prints = fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string")).localCheckpoint()
    own = {r.doc_id: r.fingerprint for r in prints.collect()}
    group = "CASE WHEN doc_id IN (1, 2) THEN 3 WHEN doc_id IN (4, 5) THEN 6 ELSE 7 END AS part_of"
    got = {r.part_of: r.fingerprint for r in merge(prints.filter("doc_id NOT IN (3, 6)").selectExpr("*", group), "part_of").collect()}
    assert got == {3: own[3], 6: own[6], 7: ""}
    pairs = spark.createDataFrame([(a, b) for a in own for b in own], "a bigint, b bigint")
    array = dict(zip([i for i, _ in docs], sketches([t.encode() for _, t in docs]), strict=True))
    shares = {(r.a, r.b): r.share for r in containments(pairs, prints).collect()}
    assert shares == {(a, b): containment(array[a], array[b]) for a in own for b in own}
    assert shares[4, 3] == shares[4, 6] == 1.0
