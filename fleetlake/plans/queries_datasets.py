"""Dataset profile and question-driven analysis queries (A6, I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake.functions.exprs import lookup
from fleetlake.operators import analysis as an
from fleetlake.operators.growing import RANK_ERROR, add_file, merge_states, sketched_quantiles, states
from fleetlake.operators.profile import column_features, column_kind, profile_summary, sample_records
from fleetlake.plans import oracle as o
from fleetlake.plans.catalog import register
from fleetlake.session import scratch_path
from fleetlake.sources.telemetry import load_workload_runs, read_tables

# Table layouts of the driver's datasets, as Spark reads them (for the SQL side).
EVENTS_COLUMNS = [
    ("event_id", "bigint", "numeric", False),
    ("ts", "timestamp_ntz", "other", False),
    ("user_id", "bigint", "numeric", False),
    ("event_type", "string", "categorical", False),
    ("value", "double", "numeric", True),
    ("props", "string", "categorical", False),
]
DOCUMENTS_COLUMNS = [
    ("doc_id", "bigint", "numeric", False),
    ("text", "string", "categorical", False),
    ("lang", "string", "categorical", False),
    ("source", "string", "categorical", False),
    ("n_chars", "bigint", "numeric", False),
]


def _missing(col: str, floating: bool) -> str:
    return f"{col} IS NULL" + (f" OR isnan({col})" if floating else "")


def features_sql(table: str, cols, with_kind: bool = False) -> str:
    parts = []
    for i, (c, dtype, kind, flt) in enumerate(cols):
        extra = f", {o.q(kind)} AS kind" if with_kind else ""
        parts.append(
            f"SELECT {i} AS ordinal, {o.q(c)} AS column_name, {o.q(dtype)} AS spark_dtype, "
            f"count(*) FILTER (WHERE {_missing(c, flt)}) AS missing_count, count(*) AS row_count{extra} FROM {table}"
        )
    return "\nUNION ALL\n".join(parts)


@register("column_features", features_sql("events", EVENTS_COLUMNS))
def q_column_features(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return column_features(events)


@register("column_features_documents", features_sql("documents", DOCUMENTS_COLUMNS))
def q_column_features_documents(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    return column_features(docs)


@register("profile_columns", features_sql("events", EVENTS_COLUMNS, with_kind=True))
def q_profile_columns(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    kinds = {f.name: column_kind(f) for f in events.schema.fields}
    return column_features(events).withColumn("kind", lookup(kinds, F.col("column_name")))


@register(
    "profile_missing",
    "SELECT column_name, missing_count FROM (" + features_sql("documents", DOCUMENTS_COLUMNS) + ")",
)
def q_profile_missing(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    return column_features(docs).select("column_name", "missing_count")


def _iso_sql(c: str) -> str:
    return (
        f"CASE WHEN strftime({c}, '%f') = '000000' THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


_EVENTS_JSON = (
    "json_object('event_id', event_id, 'ts', " + _iso_sql("ts") + ", 'user_id', user_id, 'event_type', event_type, "
    "'value', CASE WHEN isnan(value) THEN NULL ELSE value END, 'props', props)::VARCHAR"
)


@register(
    "profile_sample",
    f"SELECT row_number() OVER (ORDER BY event_id) AS sample_index, {_EVENTS_JSON} AS record "
    "FROM (SELECT * FROM events ORDER BY event_id NULLS LAST LIMIT 5)",
)
def q_profile_sample(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return sample_records(events, ["event_id"])


_names = ",".join(c for c, *_ in EVENTS_COLUMNS)
_num = ",".join(c for c, _, k, _ in EVENTS_COLUMNS if k == "numeric")
_cat = ",".join(c for c, _, k, _ in EVENTS_COLUMNS if k == "categorical")
_dtypes = ";".join(f"{c}={d}" for c, d, *_ in sorted(EVENTS_COLUMNS))


@register(
    "profile_summary",
    f"""WITH feats AS ({features_sql('events', EVENTS_COLUMNS)}),
sample AS (SELECT {_EVENTS_JSON} AS rec, event_id FROM (SELECT * FROM events ORDER BY event_id NULLS LAST LIMIT 5))
SELECT 'events.parquet' AS filename, max(row_count) AS rows, {len(EVENTS_COLUMNS)} AS columns,
  {o.q(_names)} AS column_names, {o.q(_dtypes)} AS dtypes, {o.q(_num)} AS numeric_columns,
  {o.q(_cat)} AS categorical_columns,
  string_agg(column_name || '=' || CAST(missing_count AS VARCHAR), ';' ORDER BY column_name) AS missing_values,
  (SELECT '[' || string_agg(rec, ',' ORDER BY event_id) || ']' FROM sample) AS sample_rows
FROM feats""",
)
def q_profile_summary(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    p = profile_summary(events, "events.parquet", ["event_id"])

    def map_text(m):
        return F.array_join(
            F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), m[k].cast("string"))), ";"
        )

    return p.select(
        "filename",
        "rows",
        "columns",
        F.array_join("column_names", ",").alias("column_names"),
        map_text(F.col("dtypes")).alias("dtypes"),
        F.array_join("numeric_columns", ",").alias("numeric_columns"),
        F.array_join("categorical_columns", ",").alias("categorical_columns"),
        map_text(F.col("missing_values")).alias("missing_values"),
        "sample_rows",
    )


# ---- analyses -----------------------------------------------------------------------------

RUNS_CTE = """
runs AS (
  SELECT job_id AS run_id, customer_name AS account, workload_name AS workload, region,
    partition_date AS run_date, CAST(duration_min AS DOUBLE) AS duration_minutes, spill_gb AS shuffle_spill_gb,
    cost_cents / 100e0 AS cost_usd, failed_tasks AS error_count, retried_tasks AS retry_count, sla_minutes
  FROM telemetry
), scored AS (
  SELECT *, CASE WHEN duration_minutes - sla_minutes < 0 THEN 0 ELSE duration_minutes - sla_minutes END
    AS sla_overrun_minutes FROM runs
), risk AS (
  SELECT *, sla_overrun_minutes + error_count * 8 + retry_count * 3 + shuffle_spill_gb * 0.5e0 AS risk_score
  FROM scored
), ranking AS (
  SELECT account, workload, count(run_id) AS runs,
    MEAN(duration_minutes) AS avg_duration_minutes, MEAN(cost_usd) AS avg_cost_usd,
    CAST(coalesce(sum(error_count), 0) AS BIGINT) AS errors, CAST(coalesce(sum(retry_count), 0) AS BIGINT) AS retries,
    MEAN(sla_overrun_minutes) AS avg_sla_overrun_minutes, MEAN(risk_score) AS risk_score
  FROM risk WHERE account IS NOT NULL AND workload IS NOT NULL GROUP BY account, workload
)"""


def _runs_sql(body: str) -> str:
    cte = RUNS_CTE
    for col in ["duration_minutes", "cost_usd", "sla_overrun_minutes", "risk_score"]:
        cte = cte.replace(f"MEAN({col})", o.rounded_mean(col))
    return o.with_ctes(o.TELEMETRY, cte, body=body)


_RISK_ORDER = "risk_score DESC NULLS LAST, account, workload"


@register("workload_risk", _runs_sql(f"SELECT * FROM ranking ORDER BY {_RISK_ORDER} LIMIT 10"))
def q_workload_risk(spark, sf_dir):
    return rounded(an.workload_risk(load_workload_runs(spark, sf_dir)), *RISK_MEANS)


@register("top_risk", _runs_sql(f"SELECT * FROM ranking ORDER BY {_RISK_ORDER} LIMIT 1"))
def q_top_risk(spark, sf_dir):
    return rounded(an.top_risk(load_workload_runs(spark, sf_dir)), *RISK_MEANS)


@register(
    "auto_analyze",
    _runs_sql(f"SELECT * FROM ranking ORDER BY {_RISK_ORDER} LIMIT 10"),
)
def q_auto_analyze(spark, sf_dir):
    runs = load_workload_runs(spark, sf_dir)
    found = an.auto_analyze(runs, "Which account and workload carry the most operational risk?")
    return rounded(found.frame, *RISK_MEANS)


@register(
    "chart_table",
    _runs_sql(
        f"SELECT account AS x, risk_score AS y, workload AS color FROM ranking ORDER BY {_RISK_ORDER} LIMIT 10"
    ),
)
def q_chart_table(spark, sf_dir):
    runs = load_workload_runs(spark, sf_dir)
    return rounded(an.chart_table(an.auto_analyze(runs, "Where is risk concentrated?")), "y")


@register(
    "mean_by_group",
    _runs_sql(
        f"SELECT account, {o.rounded_mean('duration_minutes')} AS duration_minutes FROM runs "
        "WHERE account IS NOT NULL GROUP BY account"
    ),
)
def q_mean_by_group(spark, sf_dir):
    return rounded(an.mean_by_group(load_workload_runs(spark, sf_dir), "account", "duration_minutes"), "duration_minutes")


_CAT_SQL = (
    f"SELECT event_type, count(value) AS count, {o.rounded_mean('value')} AS mean, min(value) AS min, "
    "max(value) AS max FROM events WHERE event_type IS NOT NULL GROUP BY event_type "
    "ORDER BY mean DESC NULLS LAST, event_type LIMIT 10"
)


@register("category_summary", _CAT_SQL)
def q_category_summary(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return rounded(an.category_summary(events, "event_type", "value"), "mean")


@register("auto_analyze_category", _CAT_SQL)
def q_auto_analyze_category(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    a = an.auto_analyze(events.select("event_id", "event_type", "value"), "Compare the value by event type")
    return rounded(a.frame, "mean")


DESCRIBE_SQL = """WITH vals AS (
  SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)
)
SELECT count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
  round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
  round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max
FROM vals"""


def rounded(df, *names):
    """The named columns at six decimals, as in the SQL."""
    return df.withColumns({n: F.round(n, 6) for n in names})


RISK_MEANS = ("avg_duration_minutes", "avg_cost_usd", "avg_sla_overrun_minutes", "risk_score")


@register("numeric_describe", DESCRIBE_SQL)
def q_numeric_describe(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return rounded(an.numeric_describe(events, "value"), "mean", "std", "p25", "p50", "p75")


@register("auto_analyze_numeric", DESCRIBE_SQL)
def q_auto_analyze_numeric(spark, sf_dir):
    """J9 on numbers only: a describe."""
    (events,) = read_tables(spark, sf_dir, "events")
    found = an.auto_analyze(events.select("value"), "How is the value distributed?")
    return rounded(found.frame, "mean", "std", "p25", "p50", "p75")


@register("auto_analyze_preview", "SELECT event_type, props FROM events ORDER BY event_type, props LIMIT 10")
def q_auto_analyze_preview(spark, sf_dir):
    """J9 without numbers: a preview."""
    (events,) = read_tables(spark, sf_dir, "events")
    return an.auto_analyze(events.select("event_type", "props"), "Show me the data").frame


@register(
    "histogram",
    """WITH vals AS (
  SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)
), b AS (SELECT min(v) AS lo, max(v) AS hi FROM vals),
binned AS (
  SELECT CASE WHEN hi = lo THEN 0 ELSE least(9, CAST(floor((v - lo) / ((hi - lo) / 10e0)) AS INTEGER)) END AS bin,
    lo, hi FROM vals, b
)
SELECT bin, CASE WHEN hi = lo THEN lo ELSE lo + bin * ((hi - lo) / 10e0) END AS bin_start,
  CASE WHEN hi = lo THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 10e0) END AS bin_end, count(*) AS count
FROM binned GROUP BY bin, lo, hi""",
)
def q_histogram(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return an.histogram(events, "value", 10)


@register("preview", "SELECT * FROM events ORDER BY event_id NULLS LAST LIMIT 10")
def q_preview(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return an.preview(events, ["event_id"])


# ---- growing data: one scan per file, states merge ------------------------------------------


def _grown(spark, sf_dir) -> str:
    """Events arrive as two files; the second is added twice, which changes nothing."""
    (events,) = read_tables(spark, sf_dir, "events")
    table, even = scratch_path(spark, "states"), F.col("event_id") % 2 == 0
    add_file(spark, table, events.filter(even), "even")
    for _ in range(2):
        add_file(spark, table, events.filter(~even), "odd")
    return table


@register(
    "growing_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing_count, "
        + (
            f"count({c}) AS \"count\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max"
            if c in ("event_id", "user_id", "value")
            else "0 AS \"count\", NULL AS mean, NULL AS std, NULL AS min, NULL AS max"
        )
        + " FROM events"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
)
def q_growing_profile(spark, sf_dir):
    """A6, I5, J5 of the union of two uploads from their states."""
    merged = merge_states(states(spark, _grown(spark, sf_dir)))
    out = merged.select("column_name", "row_count", "missing_count", "count", "mean", "std", "min", "max")
    return rounded(out, "mean", "std")


@register(
    "quantile_sketch",
    "SELECT p, true AS within, (SELECT count(value) FROM events) AS \"count\" "
    "FROM (VALUES (0.01e0), (0.25e0), (0.5e0), (0.75e0), (0.99e0)) t(p)",
)
def q_quantile_sketch(spark, sf_dir):
    """J5 from merged sketches: whether each answer's true ranks come within the stated error of the one asked for."""
    (events,) = read_tables(spark, sf_dir, "events")
    merged = merge_states(states(spark, _grown(spark, sf_dir))).filter(F.col("column_name") == "value")
    found = sketched_quantiles(merged, [0.01, 0.25, 0.5, 0.75, 0.99]).select("p", "quantile")
    # one row of five answers, as a scalar subquery: all rows are counted against them in one scan
    answers = found.agg(F.sort_array(F.collect_list(F.struct("p", "quantile")))).scalar()
    counts = events.filter(F.col("value").isNotNull()).select("value", answers.alias("a")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("value") < F.col("a")[i]["quantile"]).alias(f"lt{i}") for i in range(5)],
        *[F.count_if(F.col("value") <= F.col("a")[i]["quantile"]).alias(f"le{i}") for i in range(5)],
        F.first("a").alias("a"),
    )
    rows = F.array(
        *[
            F.struct(
                F.col("a")[i]["p"].alias("p"),
                (
                    (F.col(f"lt{i}") <= (F.col("a")[i]["p"] + RANK_ERROR) * F.col("n"))
                    & (F.col(f"le{i}") >= (F.col("a")[i]["p"] - RANK_ERROR) * F.col("n"))
                ).alias("within"),
                F.col("n").alias("count"),
            )
            for i in range(5)
        ]
    )
    return counts.select(F.inline(rows))
