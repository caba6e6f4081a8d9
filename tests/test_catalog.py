"""Every catalog key against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from fleetlake.plans.catalog import oracle_sql, queries
from tests.conftest import SF_SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def _canon(v):
    if v is None:
        return "~null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, int):
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())
    assert len(queries()) >= 50


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF_SMALL)
    s_cols, s_data = sdf.columns, [tuple(r) for r in sdf.collect()]
    rel = duck.sql(oracle_sql()[name])
    d_cols, d_data = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_data) == len(d_data)
    assert _rows(s_cols, s_data) == _rows(d_cols, d_data)
