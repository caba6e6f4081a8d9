"""Rule-based triage report for every incident, as one DataFrame job.

The original builds one report per call for one incident id. Here the whole
incident table is triaged at once:

* G1 incident + customer context: an equi join on customer_id (AQE picks
  broadcast or sort-merge from the runtime size of the health table);
  incidents without a customer go to ``triage_rejects`` (left anti join).
* G2 runbook: a broadcast join to the 7-row runbook dimension (fixed size);
  unknown categories are rejected instead of raising.
* G7 comparables: the top 4 incidents per category are found with
  ``row_number() <= 4`` (Spark plans a partial window-group limit before the
  shuffle, so a hot category never reaches one task whole), folded into one
  sorted array per category, and broadcast -- at most 4 x (runbook
  categories) rows. Each incident drops itself and keeps 3: no self join,
  no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.functions import fixed_values as fv
from fleetlake.functions.exprs import num_text, spaced
from fleetlake.operators.incidents import queue_order

COMPARABLE_FIELDS = [
    "incident_id",
    "customer_id",
    "customer_name",
    "workload_name",
    "severity",
    "severity_rank",
    "event_ts",
    "reliability_score",
    "summary_line",
]

STEP_TYPE = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
    ]
)


def runbook_dimension(spark: SparkSession) -> DataFrame:
    """G2 library as a 7-row table with array columns."""
    schema = T.StructType(
        [
            T.StructField("failure_category", T.StringType(), False),
            T.StructField("rb_root_cause", T.StringType()),
            T.StructField("rb_actions", T.ArrayType(T.StringType())),
            T.StructField("rb_deployment", T.ArrayType(T.StringType())),
        ]
    )
    rows = [(k, v["root_cause"], list(v["actions"]), list(v["deployment"])) for k, v in fv.RUNBOOK_LIBRARY.items()]
    return spark.createDataFrame(rows, schema)


def comparables_by_category(pool: DataFrame, categories: DataFrame, keep: int = fv.COMPARABLE_LIMIT + 1) -> DataFrame:
    """Per category, the first ``keep`` incidents in queue order, as a sorted array."""
    w = Window.partitionBy("failure_category").orderBy(*queue_order())
    top = (
        pool.join(F.broadcast(categories.select("failure_category")), "failure_category", "left_semi")
        .withColumn("_fl_rn", F.row_number().over(w))
        .filter(F.col("_fl_rn") <= keep)
    )
    return top.groupBy("failure_category").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_fl_rn"), *[F.col(c) for c in COMPARABLE_FIELDS]))).alias(
            "_fl_cands"
        )
    )


def _kept(cands: Column) -> Column:
    return F.transform(
        F.slice(cands, 1, fv.COMPARABLE_LIMIT), lambda x: F.struct(*[x[c].alias(c) for c in COMPARABLE_FIELDS])
    )


def _with_first(cands: DataFrame) -> DataFrame:
    """Per category, what an incident outside its candidates gets, and their ids: made once a category, not per incident."""
    named = F.filter("_fl_cands", lambda x: x["incident_id"].isNotNull())
    return cands.withColumns(
        {"_fl_first": _kept(named), "_fl_ids": F.transform(named, lambda x: x["incident_id"])}
    )


def _comparables() -> Column:
    """The first candidates that have another id than the incident."""
    own = F.col("incident_id").isNull() | F.array_contains("_fl_ids", F.col("incident_id"))
    others = F.filter("_fl_cands", lambda x: x["incident_id"] != F.col("incident_id"))
    return F.when(own, _kept(others)).otherwise(F.col("_fl_first"))


def _first_action_lower() -> Column:
    return F.lower(F.element_at(F.col("next_actions"), 1))


def _step(stage: str, title: str, detail: Column, metrics: Column) -> Column:
    return F.struct(
        F.lit(stage).alias("stage"), F.lit(title).alias("title"), detail.alias("detail"), metrics.alias("metrics")
    )


def _metrics(*pairs: tuple[str, Column]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    args = []
    for k, v in pairs:
        args += [F.lit(k), v.cast("string")]
    return F.create_map(*args)


def customer_context(health: DataFrame) -> DataFrame:
    """One health row per customer_id: the lowest score when an id appears in
    several rows (the original reads the first match of the score-sorted
    table). A partial aggregate over a customer-sized table."""
    best = F.min_by(
        F.struct("customer_health_score", "open_incidents"),
        F.struct(F.col("customer_health_score").isNull(), F.col("customer_health_score")),
    )
    return health.groupBy("customer_id").agg(best.alias("_c")).select(
        "customer_id",
        F.col("_c.customer_health_score").alias("customer_health_score"),
        F.col("_c.open_incidents").alias("customer_open_incidents"),
    )


def triage_context(incidents: DataFrame, health: DataFrame) -> DataFrame:
    """G1: incidents with their customer's health score and open incidents."""
    return incidents.join(customer_context(health), "customer_id", "inner")


def triage_rejects(incidents: DataFrame, health: DataFrame) -> DataFrame:
    """Incidents that cannot be triaged, with the reason (the original raises).
    One left join to the customers and one broadcast join to the runbook."""
    spark = incidents.sparkSession
    known = runbook_dimension(spark).select("failure_category", F.lit(True).alias("_fl_rb"))
    custs = customer_context(health).select("customer_id", F.lit(True).alias("_fl_c"))
    flagged = incidents.join(custs, "customer_id", "left").join(F.broadcast(known), "failure_category", "left")
    reason = F.when(F.col("_fl_c").isNull(), F.lit(fv.REJECT_NO_CUSTOMER)).when(
        F.col("_fl_rb").isNull(), F.lit(fv.REJECT_UNKNOWN_CATEGORY)
    )
    return flagged.select("incident_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def build_triage(
    incidents: DataFrame,
    health: DataFrame,
    pool: DataFrame | None = None,
    run_id: Column | None = None,
) -> DataFrame:
    """One report row per incident that has a customer and a runbook."""
    spark = incidents.sparkSession
    runbook = runbook_dimension(spark)
    pool = incidents if pool is None else pool
    ctx = triage_context(incidents, health).join(F.broadcast(runbook), "failure_category", "inner")
    cands = _with_first(comparables_by_category(pool, runbook))
    ctx = ctx.join(F.broadcast(cands), "failure_category", "left")

    def opt(cond: Column, text: str) -> Column:
        return F.when(cond, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))

    ctx = ctx.withColumns(
        {
            "next_actions": F.concat(
                F.col("rb_actions"),
                opt(F.col("queue_depth") >= fv.QUEUE_ACTION_THRESHOLD, fv.QUEUE_ACTION),
                opt(F.col("memory_utilization_pct") >= fv.MEMORY_ACTION_THRESHOLD, fv.MEMORY_ACTION),
            ),
            "deployment_plan": F.concat(
                F.col("rb_deployment"),
                opt(
                    F.col("customer_open_incidents") >= fv.OPEN_INCIDENT_DEPLOY_THRESHOLD,
                    fv.OPEN_INCIDENT_DEPLOY_STEP,
                ),
            ),
            "root_cause": F.col("rb_root_cause"),
        }
    )
    elem = pool.select(*COMPARABLE_FIELDS).schema
    ctx = ctx.withColumn("comparable_incidents", F.coalesce(_comparables(), F.array().cast(T.ArrayType(elem))))
    ctx = ctx.withColumns(
        {
            "customer_update": F.concat(
                F.lit("We identified the main issue behind "),
                F.col("workload_name"),
                F.lit(" for "),
                F.col("customer_name"),
                F.lit(": "),
                F.col("root_cause"),
                F.lit(" Current health for the account is "),
                num_text(F.col("customer_health_score")),
                F.lit(" and the top remediation step is to "),
                _first_action_lower(),
                F.lit("."),
            ),
            "executive_summary": F.concat(
                F.col("customer_name"),
                F.lit(" needs a focused fix on "),
                F.col("workload_name"),
                F.lit(". The likely driver is "),
                spaced(F.col("failure_category")),
                F.lit(", and the fastest path is to "),
                _first_action_lower(),
            ),
            "evidence": F.array(
                F.concat(F.lit("Reliability score is "), num_text(F.col("reliability_score")), F.lit(".")),
                F.concat(
                    F.lit("Queue depth reached "),
                    num_text(F.col("queue_depth")),
                    F.lit(" and memory utilization reached "),
                    num_text(F.col("memory_utilization_pct")),
                    F.lit("%."),
                ),
                F.concat(
                    F.lit("Latency ran "), num_text(F.col("latency_over_sla_min")), F.lit(" minutes over SLA.")
                ),
                F.col("user_impact"),
            ),
        }
    )
    matches = F.size("comparable_incidents")
    (s1, t1), (s2, t2), (s3, t3), (s4, t4), (s5, t5) = fv.TRIAGE_STEPS
    steps = F.array(
        _step(
            s1,
            t1,
            F.concat(
                F.col("customer_name"),
                F.lit(" has a "),
                F.col("severity"),
                F.lit(" severity issue on "),
                F.col("workload_name"),
                F.lit(" with reliability "),
                num_text(F.col("reliability_score")),
                F.lit("."),
            ),
            _metrics(("queue_depth", F.col("queue_depth")), ("latency_over_sla_min", F.col("latency_over_sla_min"))),
        ),
        _step(
            s2,
            t2,
            F.concat(
                F.lit("Account health is "),
                num_text(F.col("customer_health_score")),
                F.lit(" with "),
                num_text(F.col("customer_open_incidents")),
                F.lit(" open high-priority incidents."),
            ),
            _metrics(
                ("customer_health_score", F.col("customer_health_score")),
                ("open_incidents", F.col("customer_open_incidents")),
            ),
        ),
        _step(
            s3,
            t3,
            F.when(matches > 0, F.replace(F.lit(fv.COMPARABLES_TEXT), F.lit("{n}"), matches.cast("string"))).otherwise(
                F.lit(fv.NO_COMPARABLES_TEXT)
            ),
            _metrics(("matches", matches)),
        ),
        _step(s4, t4, F.col("root_cause"), _metrics(("top_action", F.element_at(F.col("next_actions"), 1)))),
        _step(s5, t5, F.col("customer_update"), _metrics()),
    )
    rid = run_id if run_id is not None else F.concat(F.lit("triage-"), F.col("incident_id"))
    return ctx.select(
        rid.alias("run_id"),
        "incident_id",
        F.col("event_ts").alias("incident_ts"),
        "customer_id",
        "customer_name",
        "workload_name",
        "severity",
        "root_cause",
        "executive_summary",
        "evidence",
        "next_actions",
        "deployment_plan",
        "customer_update",
        "comparable_incidents",
        steps.cast(T.ArrayType(STEP_TYPE)).alias("steps"),
    )
