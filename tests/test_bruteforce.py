"""Customer health against a plain pandas computation on a skewed fixture.

One customer holds a third of all runs; keys and metrics contain nulls;
reliability and timestamps tie. pandas here follows the original's rules
(with the documented rounding and tie decisions).
"""

import datetime as dt

import numpy as np
import pandas as pd

from fleetlake.operators.health import build_customer_health
from fleetlake.operators.silver import score_silver
from tests.test_silver import BASE, TELEMETRY_SCHEMA


def _fixture(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    t_end = dt.datetime(2024, 4, 24, 9, 0)
    rows = []
    for i in range(n):
        cust = "hot-1" if i % 3 == 0 else f"c{int(rng.integers(0, 12))}-x"
        r = dict(BASE)
        r.update(
            job_id=f"job-{i:05d}",
            customer_id=cust,
            customer_name=None if i % 97 == 0 else cust.upper(),
            workload_name=None if i % 11 == 0 else f"w{int(rng.integers(0, 4))}",
            failure_category=str(rng.choice(["none", "executor_oom", "hot_partition"])),
            event_ts=t_end - dt.timedelta(minutes=int(rng.integers(0, 60 * 24 * 10))),
            status=str(rng.choice(["success", "degraded", "failed"])),
            duration_min=int(rng.integers(20, 120)),
            queue_depth=None if i % 53 == 0 else int(rng.integers(0, 20)),
            failed_tasks=int(rng.integers(0, 5)),
            retried_tasks=int(rng.integers(0, 9)),
            spill_gb=round(float(rng.integers(0, 50)) / 10, 1),
            memory_utilization_pct=int(rng.integers(40, 100)),
        )
        rows.append(r)
    return rows


def _pandas_health(silver: pd.DataFrame, days=7) -> pd.DataFrame:
    latest = silver.event_ts.max()
    recent = silver[silver.event_ts >= latest - pd.Timedelta(days=days)]
    keys = ["customer_id", "customer_name", "region", "account_tier", "cluster_name"]
    out = []
    for k, g in recent.dropna(subset=keys).groupby(keys):
        rel = g.reliability_score.dropna()
        out.append(
            dict(
                zip(keys, k),
                jobs_last_7d=int(g.job_id.notna().sum()),
                failed_jobs=int((g.status == "failed").sum()),
                degraded_jobs=int((g.status == "degraded").sum()),
                open_incidents=int((g.severity == "high").sum()),
                avg_reliability_score=float(np.rint(rel * 10).sum() / (len(rel) * 10)) if len(rel) else None,
                success_rate_pct=float(np.rint((g.status == "success").mean() * 100 * 10) / 10),
            )
        )
    health = pd.DataFrame(out)
    # first non-null in (reliability nulls last, event_ts, job_id) order
    srt = recent.assign(_n=recent.reliability_score.isna()).sort_values(["_n", "reliability_score", "event_ts", "job_id"])
    worst = srt.groupby("customer_id").agg(at_risk_workload=("workload_name", "first"), dominant_failure=("failure_category", "first"))
    return health.merge(worst.reset_index(), on="customer_id", how="left")


def test_health_matches_pandas_on_skewed_fixture(spark):
    rows = _fixture()
    df = spark.createDataFrame([tuple(r[f.name] for f in TELEMETRY_SCHEMA.fields) for r in rows], TELEMETRY_SCHEMA)
    silver = score_silver(df.repartition(13))
    got = build_customer_health(silver, 7).toPandas().set_index("customer_id").sort_index()
    want = _pandas_health(silver.toPandas()).set_index("customer_id").sort_index()
    assert list(got.index) == list(want.index)
    assert got.loc["hot-1", "jobs_last_7d"] > got.drop("hot-1").jobs_last_7d.max()  # the hot key
    for col in ["jobs_last_7d", "failed_jobs", "degraded_jobs", "open_incidents", "at_risk_workload", "dominant_failure"]:
        assert got[col].tolist() == want[col].tolist(), col
    for col in ["avg_reliability_score", "success_rate_pct"]:
        assert np.allclose(got[col].astype(float), want[col].astype(float), rtol=0, atol=1e-12), col
