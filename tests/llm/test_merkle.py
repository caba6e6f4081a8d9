import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from fleetlake.llm.merkle import fold, framed, manifest, siblings
from fleetlake.llm.queries import ORACLE, op11_manifest
from tests.conftest import SF_SMALL


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout):
    """Root, and for each leaf the list of its siblings' digests upwards."""
    proofs, where = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + fanout] for i in range(0, len(digests), fanout)]
        for i, at in enumerate(where):
            run = runs[at // fanout]
            proofs[i] += run[: at % fanout] + run[at % fanout + 1 :]
            where[i] = at // fanout
        digests = [sha("".join(r)) for r in runs]
    return digests[0], proofs


def expected(rows, fanout):
    """(leaf, subroot, root, proof text) of rows (key, group, text), sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, parts = [], []
    for g in ordered:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        digests = [leaf(r) for r in members]
        root, proofs = tree(digests, fanout)
        subroots.append(root)
        parts.append((digests, proofs))
    root, above = tree(subroots, fanout)
    return sorted(
        (d, s, root, "".join(p + up))
        for (digests, proofs), s, up in zip(parts, subroots, above, strict=True)
        for d, p in zip(digests, proofs, strict=True)
    )


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    rel = con.sql(ORACLE["op11_manifest"])
    got = op11_manifest(spark, SF_SMALL)
    assert got.columns == rel.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(rel.fetchall())
    assert {r[-1] for r in rows} == {True, False}


def test_odd_rows_hot_groups_and_fanouts_match_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, "hot", f"text {i}") for i in range(250)]
    rows += [(i, rng.choice(["é", "z", "Z", "", None, "😀"]), rng.choice([None, "", "a\nb", "x" * 5000])) for i in range(60)]
    rows += [(7, "lone", "one"), (None, "z", "no key"), (None, "z", None), (3, "same", "t"), (3, "same", "t"), (3, "same", "u")]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], "id bigint, grp string, body string, tree int, pos int, digest string")
    for fanout in (2, 3, 5):
        found = manifest(df.repartition(9), ["id", "grp", "body"], "id", "grp", fanout=fanout)
        assert found.columns == ["id", "leaf", "subroot", "root", "path", "altered"]
        got = found.select("leaf", "subroot", "root", siblings(F.col("path")).alias("proof"), fold(F.col("leaf"), F.col("path")))
        got = [tuple(r) for r in got.collect()]
        assert sorted(g[:4] for g in got) == expected(rows, fanout)
        assert all(g[4] == g[2] for g in got)


def test_altered_leaf_changes_the_root(spark):
    df = spark.createDataFrame([(i, "s", f"{i}\n") for i in range(10)], "id int, grp string, body string")
    found = manifest(df, ["id", "body"], "id", "grp", altered=F.when(F.col("id") == 4, F.sha2(F.lit("other"), 256)))
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    assert {r[0]: r[1] for r in found.select("id", folded == F.col("root")).collect()} == {i: i != 4 for i in range(10)}


def test_empty_and_single_row(spark):
    df = spark.createDataFrame([(1, None, None)], "id int, grp string, body string")
    only = manifest(df, ["id", "grp", "body"], "id", "grp").collect()[0]
    assert only.leaf == only.subroot == only.root == leaf((1, None, None)) and only.path == []
    assert manifest(df.limit(0), ["id", "grp", "body"], "id", "grp").collect() == []


def test_fields_are_framed(spark):
    got = spark.range(1).select(framed(F.lit("é")), framed(F.lit(12)), framed(F.lit("")), framed(F.lit(None).cast("string")))
    assert list(got.first()) == ["2:é", "2:12", "0:", "-"]
