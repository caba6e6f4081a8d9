import os
import random
import threading

from fleetlake.operators import keyed
from fleetlake.operators.keyed import compact, read_row, read_rows, upsert_rows
from fleetlake.session import scratch_path
from fleetlake.sources.commits import newest

SCHEMA = "id string, status string, n int, _seq bigint"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _files(table):
    return {os.path.join(d, f) for d, _, fs in os.walk(table.removeprefix("file:") + "/segments") for f in fs if f.endswith(".parquet")}


def test_upserts_match_a_dictionary(spark):
    rng, table, want = random.Random(6), scratch_path(spark, "keyed"), {}
    assert _rows(read_rows(spark, table, SCHEMA)) == []
    seq = 0
    for round_ in range(6):
        batch = []
        for _ in range(rng.randint(0, 30)):
            seq += 1
            # a hot id, ids that come again, null ids, null values
            i = rng.choice(["hot", "hot", None, f"id{rng.randint(0, 25)}"])
            batch.append((i, rng.choice(["ok", None]), seq, seq))
            want[i] = batch[-1]
        rng.shuffle(batch)
        upsert_rows(spark, table, spark.createDataFrame(batch, SCHEMA), SCHEMA, buckets=4, max_segments=3)
        assert _rows(read_rows(spark, table, SCHEMA)) == sorted(want.values(), key=str)
        assert len(newest(spark, f"{table}/_commits")[1]["segments"]) <= 3
    for i in ["hot", "id3", None, "absent"]:
        assert _rows(read_row(spark, table, SCHEMA, i)) == ([want[i]] if i in want else [])


def test_older_updates_lose_and_replays_change_nothing(spark):
    table = scratch_path(spark, "keyed-old")
    new = spark.createDataFrame([("a", "done", 2, 9)], SCHEMA)
    late = spark.createDataFrame([("a", "running", 1, 3), ("b", "x", None, None)], SCHEMA)
    for df in (new, late, new, late):
        upsert_rows(spark, table, df, SCHEMA)
    assert _rows(read_rows(spark, table, SCHEMA)) == [("a", "done", 2, 9), ("b", "x", None, None)]
    # of equal sequences the later upsert counts
    upsert_rows(spark, table, spark.createDataFrame([("a", "again", 5, 9)], SCHEMA), SCHEMA)
    assert _rows(read_row(spark, table, SCHEMA, "a")) == [("a", "again", 5, 9)]


def test_one_row_does_not_rewrite_the_table(spark):
    table = scratch_path(spark, "keyed-big")
    upsert_rows(spark, table, spark.range(3000).selectExpr("cast(id as string) id", "'a' status", "1 n", "id _seq"), SCHEMA)
    before = _files(table)
    upsert_rows(spark, table, spark.createDataFrame([("7", "b", 2, 10**6)], SCHEMA), SCHEMA)
    assert len(_files(table) - before) == 1 and before <= _files(table)
    assert _rows(read_row(spark, table, SCHEMA, "7")) == [("7", "b", 2, 10**6)] and read_rows(spark, table, SCHEMA).count() == 3000
    plan = read_row(spark, table, SCHEMA, "7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan
    version = newest(spark, f"{table}/_commits")[0]
    compact(spark, table, SCHEMA)
    assert newest(spark, f"{table}/_commits")[0] == version + 1
    assert read_rows(spark, table, SCHEMA).count() == 3000 and _rows(read_row(spark, table, SCHEMA, "7"))[0][1] == "b"


def test_no_update_of_several_writers_is_lost(spark):
    table, failures = scratch_path(spark, "keyed-race"), []
    gate = threading.Barrier(4)

    def write(i):
        try:
            gate.wait()
            for j in range(3):
                rows = [(f"w{i}-{j}", "x", j, j), ("shared", f"{i}", j, 10 * j + i)]
                upsert_rows(spark, table, spark.createDataFrame(rows, SCHEMA), SCHEMA, buckets=2 + i, max_segments=4)
        except Exception as e:  # noqa: BLE001 - shown by the assert
            failures.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failures
    rows = {r.id: r for r in read_rows(spark, table, SCHEMA).collect()}
    assert set(rows) == {"shared"} | {f"w{i}-{j}" for i in range(4) for j in range(3)}
    assert rows["shared"].status == "3" and rows["shared"].n == 2
    assert _rows(read_row(spark, table, SCHEMA, "w2-1")) == [("w2-1", "x", 1, 1)]
    assert keyed.BUCKETS == 16
