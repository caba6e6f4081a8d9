"""Local correctness check: every catalog query against its DuckDB oracle.

Usage: python scripts/oracle_check.py [sf_dir] [key ...]

Compares column names, row counts and the sorted rows value by value
(exact, with a note when values only agree to 1e-9 relative).
"""

from __future__ import annotations

import math
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fleetlake.plans.catalog import oracle_sql, queries  # noqa: E402
from fleetlake.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


TYPE_MAP = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "array": "VARCHAR",
    "float": "FLOAT",
}


def canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, v)
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (4, str([canon(x) for x in v]))
    if isinstance(v, dict):
        return (5, str(sorted((str(k), canon(x)) for k, x in v.items())))
    return (6, str(v)) if not isinstance(v, (int, bool)) else (2, float(v))


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda t: str(t)), [cols[i] for i in order]


def close(a, b):
    if a == b:
        return True
    if a[0] == 2 and b[0] == 2:
        x, y = a[1], b[1]
        return abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y))
    return False


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session()
    # optional session overrides, e.g. EXTRA_CONF="spark.sql.ansi.enabled=false,spark.sql.session.timeZone=America/New_York"
    for kv in filter(None, os.environ.get("EXTRA_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            scols = sdf.columns
            sdata = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(sdata)} rows (no oracle) {ts:.2f}s")
            continue
        timer = threading.Timer(float(os.environ.get("ORACLE_TIMEOUT", "600")), con.interrupt)
        timer.start()
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            ddata = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            continue
        finally:
            timer.cancel()
        if sorted(scols) != sorted(dcols):
            bad += 1
            print(f"FAIL {name}: columns differ spark={sorted(scols)} duck={sorted(dcols)}")
            continue
        if len(sdata) != len(ddata):
            bad += 1
            print(f"FAIL {name}: rows spark={len(sdata)} duck={len(ddata)}")
            continue
        stypes = dict(sdf.dtypes)
        dtypes = dict(zip(dcols, [str(t) for t in rel.types]))
        tdiff = [
            (c, stypes[c], dtypes[c])
            for c in scols
            if TYPE_MAP.get(stypes[c].split("(")[0].split("<")[0], "?") != dtypes[c].split("(")[0].split("[")[0]
        ]
        if tdiff:
            print(f"TYPE {name}: {tdiff}")
        a, cols = rows_of(scols, sdata)
        b, _ = rows_of(dcols, ddata)
        exact = a == b
        if exact:
            print(f"OK   {name}: {len(a)} rows x {len(cols)} cols {ts:.2f}s")
            continue
        diffs = [(x, y) for x, y in zip(a, b) if x != y]
        approx = all(all(close(u, v) for u, v in zip(x, y)) for x, y in diffs)
        if approx:
            print(f"NEAR {name}: {len(a)} rows, {len(diffs)} rows differ only in float bits")
        else:
            bad += 1
            print(f"FAIL {name}: {len(diffs)} rows differ; cols={cols}")
            for x, y in diffs[:3]:
                print("   spark:", [v[1] for v in x])
                print("   duck :", [v[1] for v in y])
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
