"""Cluster telemetry and workload runs, derived from the driver's tables.

One telemetry row per order: nation = customer, order priority = workload.
Every metric is an integer or an exact tenth, so scores are bit-reproducible.

Plan shape at scale: lineitem is pre-aggregated per order (partial +
final hash aggregate, its output already hash-partitioned on the order key),
orders join it and customer with shuffle joins chosen by AQE (skewed keys are
split by AQE's skew-join handling), and nation / region -- fixed 25 and 5 row
dimensions -- are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.functions.exprs import lookup, spaced
from fleetlake.functions.fixed_values import USER_IMPACT_BY_CATEGORY
from fleetlake.session import table_path

# Generated failure categories in key order (part of the fixture definition).
FAILURE_CYCLE = [
    "executor_oom",
    "skewed_shuffle",
    "metadata_timeout",
    "hot_partition",
    "queue_saturation",
    "late_input_arrival",
]

TELEMETRY_SCHEMA = T.StructType(
    [
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("partition_date", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("account_tier", T.StringType()),
        T.StructField("cluster_name", T.StringType()),
        T.StructField("workload_name", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("sla_minutes", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("failure_category", T.StringType()),
        T.StructField("user_impact", T.StringType()),
        T.StructField("ticket_hint", T.StringType()),
        T.StructField("shuffle_gb", T.DoubleType()),
        T.StructField("input_rows_m", T.LongType()),
        T.StructField("spill_gb", T.DoubleType()),
        T.StructField("memory_utilization_pct", T.LongType()),
        T.StructField("queue_depth", T.LongType()),
        T.StructField("failed_tasks", T.LongType()),
        T.StructField("retried_tasks", T.LongType()),
        T.StructField("duration_min", T.LongType()),
        T.StructField("cost_cents", T.LongType()),
    ]
)


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(table_path(sf_dir, n)) for n in names]


def user_impact(category) -> F.Column:
    return lookup(USER_IMPACT_BY_CATEGORY, category)


def ticket_hint(customer_name, workload_name, category) -> F.Column:
    return F.when(
        category == F.lit("none"),
        F.concat(customer_name, F.lit(" "), workload_name, F.lit(" completed in-family.")),
    ).otherwise(
        F.concat(
            customer_name,
            F.lit(" flagged "),
            workload_name,
            F.lit(" for follow-up because of "),
            spaced(category),
            F.lit("."),
        )
    )


def telemetry_from_tables(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame, lineitem: DataFrame
) -> DataFrame:
    li = lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("l_quantity").alias("_qty")
    )
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = customer.select("c_custkey", "c_nationkey")
    base = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    k = F.col("o_orderkey")
    n = F.coalesce(F.col("_n"), F.lit(0))
    troubled = (F.col("o_orderstatus") == "P") | ((F.col("o_orderstatus") == "F") & (k % 5 == 0))
    category = F.when(~troubled, F.lit("none")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in FAILURE_CYCLE]), (k % 6).cast("int") + 1)
    )
    cols = {
        "event_ts": F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (k % 1440).cast("int")),
        "partition_date": F.date_format(F.col("o_orderdate"), "yyyy-MM-dd"),
        "customer_id": F.concat(
            F.replace(F.lower(F.col("r_name")), F.lit(" "), F.lit("_")), F.lit("-"), F.col("n_nationkey").cast("string")
        ),
        "customer_name": F.col("n_name"),
        "region": F.col("r_name"),
        "account_tier": F.when(F.col("n_nationkey") % 3 == 0, "platinum")
        .when(F.col("n_nationkey") % 3 == 1, "strategic")
        .otherwise("growth"),
        "cluster_name": F.concat(F.lit("cluster-"), F.col("n_nationkey").cast("string")),
        "workload_name": F.col("o_orderpriority"),
        "job_id": F.concat(F.lit("job-"), k.cast("string")),
        "sla_minutes": F.lit(60) + F.lit(10) * (k % 4),
        "status": F.when(F.col("o_orderstatus") == "P", "degraded")
        .when((F.col("o_orderstatus") == "F") & (k % 5 == 0), "failed")
        .otherwise("success"),
        "failure_category": category,
        "shuffle_gb": F.coalesce(F.col("_qty"), F.lit(0.0)),
        "input_rows_m": F.lit(4) + n,
        "spill_gb": (k * 31 % 120) / F.lit(10.0),
        "memory_utilization_pct": F.lit(50) + (k * 7) % 50,
        "queue_depth": (k * 13) % 16,
        "failed_tasks": k % 8,
        "retried_tasks": k % 13,
        "duration_min": F.lit(20) + F.lit(10) * n + k % 17,
        "cost_cents": F.round(F.col("o_totalprice") * 100).cast("bigint"),
    }
    out = base.select(*[v.alias(name) for name, v in cols.items()])
    out = out.withColumn("user_impact", user_impact(F.col("failure_category"))).withColumn(
        "ticket_hint", ticket_hint(F.col("customer_name"), F.col("workload_name"), F.col("failure_category"))
    )
    return out.select(*[f.name for f in TELEMETRY_SCHEMA.fields]).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in TELEMETRY_SCHEMA.fields]
    )


def load_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_tables(*read_tables(spark, sf_dir, "orders", "customer", "nation", "region", "lineitem"))


def workload_runs(telemetry: DataFrame) -> DataFrame:
    """The workload-metrics dataset shape (run per row) as a projection."""
    return telemetry.select(
        F.col("job_id").alias("run_id"),
        F.col("customer_name").alias("account"),
        F.col("workload_name").alias("workload"),
        F.col("region"),
        F.col("partition_date").alias("run_date"),
        F.col("duration_min").cast("double").alias("duration_minutes"),
        F.col("spill_gb").alias("shuffle_spill_gb"),
        (F.col("cost_cents") / F.lit(100.0)).alias("cost_usd"),
        F.col("failed_tasks").alias("error_count"),
        F.col("retried_tasks").alias("retry_count"),
        F.col("sla_minutes"),
    )


def load_workload_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload_runs(load_telemetry(spark, sf_dir))
