import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from fleetlake.operators.health import build_customer_health
from fleetlake.operators.silver import build_silver, score_silver
from fleetlake.plans.timeline import add_runs, open_timeline
from fleetlake.session import scratch_path
from fleetlake.sources.commits import commit, newest
from fleetlake.sources.telemetry import load_telemetry
from tests.conftest import SF_SMALL


def _ids(df):
    return sorted((str(r.job_id), r.incident_id) for r in df.select("job_id", "incident_id").collect())


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df.select(*cols).collect()))


@pytest.fixture(scope="module")
def silver(spark):
    return score_silver(load_telemetry(spark, SF_SMALL)).cache()


def test_late_runs_rewrite_their_days_only(spark, silver):
    base = scratch_path(spark, "timeline")
    recent = silver.filter("event_ts >= '1998-06-01'")
    day, late_job = recent.groupBy(F.to_date("event_ts").alias("d")).agg(F.max("job_id"), F.count("*")).orderBy("count(1)", "d").tail(1)[0][:2]
    late = F.col("job_id") == late_job
    one = add_runs(spark, base, recent.filter(~late))
    two = add_runs(spark, base, recent.filter(late))
    changed = {p for p in two.places if two.places[p] != one.places.get(p)}
    assert changed == {day.isoformat()} and day.isoformat() in one.places
    # numbers equal a full rebuild, also those of days that were not written again
    assert _ids(two.silver()) == _ids(build_silver(load_telemetry(spark, SF_SMALL).filter("event_ts >= '1998-06-01'")))
    # the older version is still there as it was
    again = open_timeline(spark, base, 1)
    assert again.places == one.places and again.silver().count() < two.silver().count()


def test_health_of_any_window_equals_the_runs(spark, silver):
    base = scratch_path(spark, "timeline-health")
    third = F.pmod(F.hash("job_id"), F.lit(3))
    for i in range(3):
        line = add_runs(spark, base, silver.filter(third == i), grain="month")
    for days in (7, 90, 1, 4000):
        assert _rows(line.health(days)) == _rows(build_customer_health(silver, days))


def test_lookup_reads_one_period(spark, silver):
    base = scratch_path(spark, "timeline-lookup")
    line = add_runs(spark, base, silver, grain="month")
    want = build_silver(load_telemetry(spark, SF_SMALL)).orderBy("job_id").limit(3).collect()
    for row in want:
        found = line.incident(row.incident_id)
        assert [r.asDict() for r in found.collect()] == [{k: v for k, v in row.asDict().items()}]
        assert len(found.inputFiles()) < len(line.places)
    for absent in ("inc-x-0101-0000", "inc-europe-0101-99999999", "nonsense"):
        assert line.incident(absent).collect() == []


def test_odd_times_ties_and_empty_batches(spark, silver):
    base = scratch_path(spark, "timeline-odd")
    few = silver.filter("event_ts < '1992-02-01'")
    first = few.agg(F.min("event_ts")).first()[0]
    tied = few.withColumn("event_ts", F.lit(first))
    lost = few.withColumn("event_ts", F.lit(None).cast("timestamp_ntz"))
    odd = few.unionByName(tied).unionByName(lost)
    empty = add_runs(spark, base, few.limit(0))
    assert empty.silver().count() == 0 and empty.latest() is None and empty.health(7).count() == 0
    add_runs(spark, base, lost)
    line = add_runs(spark, base, few.unionByName(tied))
    n = odd.count()
    numbers = sorted(int(r[0].rsplit("-", 1)[1]) for r in line.silver().filter("event_ts IS NOT NULL").select("incident_id").collect())
    assert numbers == list(range(2 * few.count())) and line.silver().count() == n
    assert _rows(line.health(30)) == _rows(build_customer_health(few.unionByName(tied), 30))
    with pytest.raises(ValueError):
        add_runs(spark, base, few, grain="month")
    with pytest.raises(ValueError):
        add_runs(spark, base, few.drop("status"))


def test_two_writers_never_share_a_version(spark, silver):
    base = scratch_path(spark, "timeline-race")
    days = [dt.date(1995, 3, d) for d in range(1, 5)]
    parts = [silver.filter(F.to_date("event_ts") == F.lit(d)) for d in days]
    failures = []

    def write(part):
        try:
            add_runs(spark, base, part)
        except Exception as e:  # noqa: BLE001 - shown by the assert
            failures.append(e)

    threads = [threading.Thread(target=write, args=(p,)) for p in parts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failures
    line = open_timeline(spark, base)
    assert line.version == 4
    assert line.silver().count() == silver.filter(F.to_date("event_ts").isin(days)).count()


def test_commit_is_taken_once(spark):
    log = scratch_path(spark, "log")
    assert newest(spark, log) == (0, {})
    won = []
    gate = threading.Barrier(6)

    def write(i):
        gate.wait()
        won.append(commit(spark, log, 1, {"by": i}))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 5 + [True]
    assert newest(spark, log)[0] == 1 and commit(spark, log, 2, {"by": "next"}) and newest(spark, log) == (2, {"by": "next"})


def test_rename_does_not_replace(spark):
    """The way of file systems without links, tried on the local one."""
    import os

    from fleetlake.sources import commits

    folder = scratch_path(spark, "rename")
    for name in ("a", "b"):
        commits._write(spark, f"{folder}/{name}", name)
    commits._rename(spark, f"{folder}/a", f"{folder}/taken")
    with pytest.raises(Exception, match="AlreadyExists"):
        commits._rename(spark, f"{folder}/b", f"{folder}/taken")
    assert open(os.path.join(folder.removeprefix("file:"), "taken")).read() == "a"


def test_runs_of_the_queries_are_derived_once(spark, monkeypatch):
    """Both parts that are added come from one stored table, not from the source tables again."""
    from fleetlake.plans import queries_io

    seen = []

    def spy(spark, base, runs, grain):
        seen.append(runs.inputFiles())
        return add_runs(spark, base, runs, grain)

    monkeypatch.setattr(queries_io, "add_runs", spy)
    line = queries_io._timeline(spark, SF_SMALL)
    assert len(seen) == 2 and all("timeline-src" in f for files in seen for f in files)
    assert _ids(line.silver()) == _ids(build_silver(load_telemetry(spark, SF_SMALL)))


def test_blocks_hold_few_rows(spark, silver, monkeypatch):
    from fleetlake.operators import position

    monkeypatch.setattr(position, "SORT_ROWS", 100)
    line = add_runs(spark, scratch_path(spark, "timeline"), silver, grain="month")
    assert line.index().groupBy("row_block").agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0] < 400
    assert _ids(line.silver()) == _ids(build_silver(load_telemetry(spark, SF_SMALL)))
