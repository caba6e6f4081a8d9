from pyspark.sql import functions as F

from fleetlake.functions import fixed_values as fv
from fleetlake.operators.health import build_customer_health
from fleetlake.operators.incidents import incident_candidates, top_incidents
from fleetlake.operators.silver import build_silver
from fleetlake.operators.triage import build_triage, triage_rejects
from fleetlake.sources.telemetry import load_telemetry
from tests.conftest import SF_SMALL


def _gold(spark, days=90):
    silver = build_silver(load_telemetry(spark, SF_SMALL))
    return incident_candidates(silver), build_customer_health(silver, days, ordered=False)


def test_report_for_top_incident_is_customer_ready(spark):
    incidents, health = _gold(spark)
    top_id = top_incidents(incidents, 1).select("incident_id").first()[0]
    rep = build_triage(incidents, health).filter(F.col("incident_id") == top_id).first()
    assert len(rep.next_actions) >= 1
    assert len(rep.deployment_plan) >= 1
    assert rep.customer_update and rep.customer_name in rep.customer_update
    assert [s.stage for s in rep.steps] == [s for s, _ in fv.TRIAGE_STEPS]
    assert len(rep.evidence) == 4


def test_comparables_exclude_self_and_follow_queue_order(spark):
    incidents, health = _gold(spark)
    rep = build_triage(incidents, health)
    for r in rep.select("incident_id", "comparable_incidents").collect():
        ids = [c.incident_id for c in r.comparable_incidents]
        assert r.incident_id not in ids and len(ids) <= 3
    # brute force for a few incidents
    some = rep.orderBy("incident_id").limit(5).collect()
    for r in some:
        cat = incidents.filter(F.col("incident_id") == r.incident_id).select("failure_category").first()[0]
        expect = (
            incidents.filter((F.col("failure_category") == cat) & (F.col("incident_id") != r.incident_id))
            .orderBy("severity_rank", F.col("event_ts").desc(), "incident_id")
            .limit(3)
            .select("incident_id")
            .collect()
        )
        assert [c.incident_id for c in r.comparable_incidents] == [e[0] for e in expect]


def test_unknown_category_and_missing_customer_are_rejected(spark):
    incidents, health = _gold(spark, days=7)
    odd = incidents.limit(3).withColumn("failure_category", F.lit("mystery"))
    keep_customer = odd.join(health.select("customer_id"), "customer_id", "left_semi")
    rej = triage_rejects(odd, health).collect()
    reasons = {r.reason for r in rej}
    if keep_customer.count():
        assert fv.REJECT_UNKNOWN_CATEGORY in reasons
    assert build_triage(odd, health).count() == 0
    # every incident is either triaged or rejected
    total = incidents.count()
    assert build_triage(incidents, health).count() + triage_rejects(incidents, health).count() == total


def test_duplicate_customer_rows_give_one_report_with_the_lowest_score(spark):
    incidents, health = _gold(spark)
    cid = health.orderBy("customer_id").select("customer_id").first()[0]
    twin = health.filter(F.col("customer_id") == cid).withColumn("customer_name", F.lit("Other Name")).withColumn(
        "customer_health_score", F.col("customer_health_score") - 1
    )
    doubled = health.unionByName(twin)
    rep = build_triage(incidents, doubled)
    assert rep.count() == build_triage(incidents, health).count()
    low = twin.select("customer_health_score").first()[0]
    got = rep.filter(F.col("customer_id") == cid).select(F.col("steps")[1]["metrics"]["customer_health_score"]).first()
    assert got is None or float(got[0]) == low


def test_comparables_with_a_hot_category_match_brute_force(spark):
    incidents, health = _gold(spark)
    # two thirds of the incidents move into one category
    hot = incidents.withColumn(
        "failure_category",
        F.when(F.abs(F.hash("incident_id")) % 3 != 0, F.lit("executor_oom")).otherwise(F.col("failure_category")),
    )
    rep = build_triage(hot.repartition(7), health)
    some = rep.filter(F.col("incident_id").endswith("7")).select("incident_id", "comparable_incidents").collect()
    pool = hot.select("incident_id", "failure_category", "severity_rank", "event_ts").toPandas()
    assert len(some) > 10 and (pool.failure_category == "executor_oom").mean() > 0.6
    for r in some:
        cat = pool.loc[pool.incident_id == r.incident_id, "failure_category"].iloc[0]
        others = pool[(pool.failure_category == cat) & (pool.incident_id != r.incident_id)].copy()
        others["neg_ts"] = -others.event_ts.astype("int64")
        want = others.sort_values(["severity_rank", "neg_ts", "incident_id"]).incident_id.head(3).tolist()
        assert [c.incident_id for c in r.comparable_incidents] == want


def test_comparables_with_missing_and_repeated_ids(spark):
    """Each incident gets the first candidates of its category with another id; without an id it gets none."""
    from collections import defaultdict

    cands, health = _gold(spark)
    some = cands.limit(120).withColumn("n", F.abs(F.xxhash64("job_id")) % 40).localCheckpoint()
    ids = F.when(F.col("n") > 3, F.concat(F.lit("inc-"), F.lpad(F.col("n").cast("string"), 2, "0")))
    incidents = some.withColumn("incident_id", ids).withColumn("severity_rank", F.lit(1)).withColumn("event_ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    pool = defaultdict(list)
    for r in incidents.collect():
        pool[r.failure_category].append(r.incident_id)
    first = {c: sorted(v, key=lambda i: (i is None, i or ""))[:4] for c, v in pool.items()}
    category = {r.job_id: r.failure_category for r in incidents.collect()}
    reports = build_triage(incidents, health, run_id=F.col("job_id")).select("run_id", "incident_id", "comparable_incidents").collect()
    assert reports
    for r in reports:
        others = [i for i in first[category[r.run_id]] if i is not None and r.incident_id is not None and i != r.incident_id]
        assert [c.incident_id for c in r.comparable_incidents] == others[:3]
