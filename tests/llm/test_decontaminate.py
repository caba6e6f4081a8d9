import random

import duckdb
from pyspark.sql import functions as F

from fleetlake.llm.decontaminate import contaminated, contamination, drop_contaminated
from fleetlake.llm.queries import ORACLE, op1_decontaminate
from tests.conftest import SF_SMALL

SQL = ORACLE["op1_decontaminate"]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel, got = con.sql(SQL), op1_decontaminate(spark, SF_SMALL)
    assert got.columns == rel.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def brute(docs, bench, span):
    import re

    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)

    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + span]), set()).add(item)
    sizes, out = {len(x) for x in windows}, []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in items if x is not None)))
    return out


def test_short_items_ties_and_odd_rows(spark):
    rng = random.Random(2)
    draw = lambda n: " ".join(rng.choice(["a", "B", "é", "c3", "d."]) for _ in range(n))
    bench = [(i, draw(rng.randint(0, 9))) for i in range(20)] + [(20, None), (21, ""), (3, draw(5)), (None, draw(6))]
    docs = [(i, draw(rng.randint(0, 60))) for i in range(80)] + [(80, None), (81, ""), (82, "a " * 20000), (82, "a " * 20000)]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id bigint, text string, row int, windows string")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    key = lambda x: (x[0], x[1], x[2], str(x[3]))
    for span, gram in ((5, 3), (4, 4), (6, 1)):
        rows = contamination(d.repartition(5), b, span, gram).select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted(map(tuple, rows), key=key) == sorted(brute(docs, bench, span), key=key)
    # a full filter lets everything through and changes nothing
    rows = contamination(d, b, 5, 3, bloom_bits=64).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted(map(tuple, rows), key=key) == sorted(brute(docs, bench, 5), key=key)


def test_empty_tables_and_dropping(spark):
    b = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id bigint, text string")
    docs = [(1, " ".join(f"q{i}" for i in range(20))), (None, " ".join(f"q{i}" for i in range(15))), (3, "clean text"), (4, None)]
    d = spark.createDataFrame([(*x, "en") for x in docs], "doc_id bigint, text string, text_key string")
    assert {r.doc_id for r in drop_contaminated(d, b).collect()} == {3, 4}
    assert drop_contaminated(d, b).columns == d.columns
    assert contamination(d.limit(0), b).collect() == []
    none = contamination(d, b.limit(0)).filter(contaminated() | (F.col("n_hit") > 0))
    assert none.collect() == []
