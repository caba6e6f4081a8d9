import zlib
from collections import Counter

import numpy as np

from fleetlake.llm.queries import op8_shard
from fleetlake.llm.sharding import assign_shards, communication_matrix, hypergeometric
from tests.conftest import SF_SMALL


def check_shards(rows, docs, shards=16):
    """docs: (doc_id, text) of every row."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(j, [])) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_query_has_exact_shards(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = op8_shard(spark, SF_SMALL).collect()
    check_shards(rows, docs)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    # the order within and over shards is not the input's
    by_place = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(by_place, range(len(by_place)))[0, 1]) < 0.3


def test_hot_rows_many_cells_and_odd_rows(spark):
    docs = [(1, "same")] * 300 + [(i, f"text {i}") for i in range(200)] + [(None, None), (2, ""), (3, "é😀" * 1000)]
    df = spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id bigint, text string, shard int, block int")
    check_shards(assign_shards(df.repartition(6), shards=5, rows_per_cell=20).collect(), docs, 5)
    assert assign_shards(df.limit(0)).collect() == []
    check_shards(assign_shards(df.limit(3)).collect(), docs[:3])


def test_matrix_has_the_law_of_a_permutation():
    blocks, shards = [40, 0, 25, 35], [30, 30, 40]
    draws = np.array([communication_matrix(blocks, shards, s) for s in range(3000)])
    assert (draws.sum(axis=2) == blocks).all() and (draws.sum(axis=1) == shards).all()
    want = np.outer(blocks, shards) / 100
    assert np.abs(draws.mean(axis=0) - want).max() < 0.3
    # variance of the hypergeometric entry 0, 0
    assert abs(draws[:, 0, 0].var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.6


def test_hypergeometric_of_any_size():
    rng = np.random.default_rng(1)
    x = np.array([hypergeometric(rng, 3 * 10**9, 10**10, 10**6) for _ in range(400)])
    assert abs(x.mean() / (10**6 * 3 / 13) - 1) < 1e-3
    for good, bad, draws in ((5, 0, 3), (0, 5, 3), (4, 4, 8), (1, 1, 1), (7, 3, 0)):
        assert max(0, draws - bad) <= hypergeometric(rng, good, bad, draws) <= min(good, draws)
