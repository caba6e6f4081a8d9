"""Property tests: score limits and severity monotonicity over random runs."""

import numpy as np
from pyspark.sql import functions as F

from fleetlake.operators.silver import score_silver
from tests.test_silver import BASE, TELEMETRY_SCHEMA

# inputs whose increase can only make a run look worse
WORSE = {
    "duration_min": 7,
    "queue_depth": 3,
    "failed_tasks": 2,
    "retried_tasks": 4,
    "spill_gb": 1.3,
    "memory_utilization_pct": 9,
}


def _random_rows(n=400, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        r = dict(BASE)
        r.update(
            job_id=f"job-{i:05d}",
            duration_min=int(rng.integers(5, 160)),
            sla_minutes=int(rng.integers(30, 120)),
            queue_depth=int(rng.integers(0, 25)),
            failed_tasks=int(rng.integers(0, 12)),
            retried_tasks=int(rng.integers(0, 20)),
            spill_gb=round(float(rng.uniform(0, 15)), 1),
            memory_utilization_pct=int(rng.integers(30, 100)),
            shuffle_gb=round(float(rng.uniform(0, 500)), 1),
            input_rows_m=int(rng.integers(0, 60)),
            status=str(rng.choice(["success", "degraded", "failed"])),
        )
        rows.append(r)
    return rows


def _df(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in TELEMETRY_SCHEMA.fields) for r in rows], TELEMETRY_SCHEMA)


def test_scores_stay_within_limits(spark):
    s = score_silver(_df(spark, _random_rows()))
    bad = s.filter(
        (F.col("reliability_score") < 8)
        | (F.col("reliability_score") > 99)
        | (F.col("queue_pressure_score") < 0)
        | (F.col("queue_pressure_score") > 100)
        | (F.col("memory_pressure_score") < 0)
        | (F.col("shuffle_pressure_score") < 6.4)
        | (F.col("latency_over_sla_min") < 0)
        | ~F.col("severity").isin("high", "medium", "low")
    )
    assert bad.count() == 0


def test_severity_is_monotone_in_each_input(spark):
    base = _random_rows()
    rows = []
    for r in base:
        rows.append(dict(r))
        for col, step in WORSE.items():
            w = dict(r, job_id=f"{r['job_id']}-{col}")
            w[col] = round(w[col] + step, 1) if isinstance(step, float) else w[col] + step
            rows.append(w)
    s = score_silver(_df(spark, rows)).select("job_id", "severity_rank", "reliability_score")
    got = {r.job_id: (r.severity_rank, r.reliability_score) for r in s.collect()}
    for r in base:
        rank, rel = got[r["job_id"]]
        for col in WORSE:
            worse_rank, worse_rel = got[f"{r['job_id']}-{col}"]
            assert worse_rank <= rank, (r["job_id"], col)
            assert worse_rel <= rel, (r["job_id"], col)


def test_status_order(spark):
    rows = [dict(BASE, job_id=f"j{i}", status=s) for i, s in enumerate(["success", "degraded", "failed"])]
    s = score_silver(_df(spark, rows)).orderBy("job_id").select("severity_rank", "reliability_score").collect()
    ranks = [r[0] for r in s]
    rels = [r[1] for r in s]
    assert ranks[0] >= ranks[1] >= ranks[2] and rels[0] >= rels[1] >= rels[2]
