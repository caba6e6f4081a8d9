"""Question-driven analyses over any tabular dataset.

Each analysis is a DataFrame plan over all rows; the original's cap of 5,000
rows (J12) is left out, as it changes answers. Means and deviations have full
double precision. Quantiles are exact: equal values are counted first, so a hot
value is one row, and the different values are sorted by range partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.functions import fixed_values as fv
from fleetlake.functions.exprs import clip, lit_d, mean, nan_to_null
from fleetlake.operators.position import BLOCK, ROW, number_rows
from fleetlake.operators.profile import categorical_columns, numeric_columns
from fleetlake.session import ensure_checkpoint_dir


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _present(df: DataFrame, *names: str) -> bool:
    return set(names).issubset(df.columns)


# ---- J1-J3: workload risk ---------------------------------------------------------------


def with_risk(df: DataFrame) -> DataFrame:
    """sla_overrun_minutes and risk_score per run; a term is used only
    when its column exists."""
    out = df
    terms: list[Column] = []
    if _present(df, "duration_minutes", "sla_minutes"):
        out = out.withColumn("sla_overrun_minutes", clip(_q("duration_minutes") - _q("sla_minutes"), lower=0))
        terms.append(F.col("sla_overrun_minutes"))
    if "error_count" in df.columns:
        terms.append(_q("error_count") * F.lit(8))
    if "retry_count" in df.columns:
        terms.append(_q("retry_count") * F.lit(3))
    if "shuffle_spill_gb" in df.columns:
        terms.append(_q("shuffle_spill_gb") * lit_d(0.5))
    risk = F.lit(0)
    if terms:
        risk = terms[0]
        for t in terms[1:]:
            risk = risk + t
    return out.withColumn("risk_score", risk)


def workload_risk(df: DataFrame, top: int = fv.SUMMARY_TOP) -> DataFrame:
    """Risk ranking by (account, workload), highest mean risk first."""
    scored = with_risk(df).dropna(subset=["account", "workload"])
    aggs = [
        (F.count("run_id") if "run_id" in df.columns else F.count(F.lit(1))).alias("runs"),
        mean("duration_minutes").alias("avg_duration_minutes"),
    ]
    if "cost_usd" in df.columns:
        aggs.append(mean("cost_usd").alias("avg_cost_usd"))
    if "error_count" in df.columns:
        aggs.append(F.coalesce(F.sum("error_count"), F.lit(0)).alias("errors"))
    if "retry_count" in df.columns:
        aggs.append(F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"))
    aggs += [
        mean("sla_overrun_minutes").alias("avg_sla_overrun_minutes"),
        mean("risk_score").alias("risk_score"),
    ]
    return (
        scored.groupBy("account", "workload")
        .agg(*aggs)
        .orderBy(F.col("risk_score").desc_nulls_last(), "account", "workload")
        .limit(top)
    )


def top_risk(df: DataFrame) -> DataFrame:
    """The single highest-risk (account, workload)."""
    return workload_risk(df, 1)


# ---- J4-J7: category summary, describe, histogram, preview -------------------------------


def category_summary(df: DataFrame, category: str, metric: str, top: int = fv.SUMMARY_TOP) -> DataFrame:
    """Count / mean / min / max of a metric per category, mean descending."""
    m = nan_to_null(_q(metric))
    return (
        df.filter(_q(category).isNotNull())
        .groupBy(_q(category).alias(category))
        .agg(
            F.count(m).alias("count"),
            mean(m).alias("mean"),
            F.min(m).alias("min"),
            F.max(m).alias("max"),
        )
        .orderBy(F.col("mean").desc_nulls_last(), F.col(f"`{category}`"))
        .limit(top)
    )


def _values(df: DataFrame, metric: str) -> DataFrame:
    v = _q(metric).cast("double")
    return df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def exact_quantiles(df: DataFrame, metric: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (the numpy default rule).

    Values are counted (a partial aggregate, so a value that fills a third of
    the table is one row per task), the different values are sorted by range
    partitions, and running counts give each value its positions. Only the (at
    most 2 per probability) values at the needed positions are kept.
    """
    ensure_checkpoint_dir(df.sparkSession)
    counted = _values(df, metric).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    numbered = number_rows(counted, [F.col("v").asc()]).checkpoint(eager=True)
    n = numbered.select(F.sum("c")).scalar()
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = numbered.groupBy(BLOCK).agg(F.sum("c").alias("_n")).select(
        BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(BLOCK).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("_in", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(offsets, BLOCK)
    first = F.col("_off") + F.col("_in")
    cols = []
    for i, p in enumerate(probs):
        h = (n - F.lit(1)).cast("double") * lit_d(p)
        prev = F.floor(h).cast("bigint")
        nxt = F.least(prev + 1, n - F.lit(1))
        cols += [prev.alias(f"_lo{i}"), nxt.alias(f"_hi{i}"), (h - prev.cast("double")).alias(f"_t{i}")]
    wanted = placed.select(first.alias("_first"), (first + F.col("c")).alias("_next"), "v", *cols)

    def holds(name: str) -> Column:
        return (F.col(name) >= F.col("_first")) & (F.col(name) < F.col("_next"))

    need = F.lit(False)
    for i in range(len(probs)):
        need = need | holds(f"_lo{i}") | holds(f"_hi{i}")
    aggs = []
    for i in range(len(probs)):
        aggs += [
            F.max(F.when(holds(f"_lo{i}"), F.col("v"))).alias(f"_a{i}"),
            F.max(F.when(holds(f"_hi{i}"), F.col("v"))).alias(f"_b{i}"),
            F.first(f"_t{i}").alias(f"_t{i}"),
        ]
    row = wanted.filter(need).agg(*aggs)
    out = []
    for i, p in enumerate(probs):
        a, b, t = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_t{i}")
        diff = b - a
        lerp = F.when(t >= 0.5, b - diff * (F.lit(1.0) - t)).otherwise(a + diff * t)
        out.append(lerp.alias(f"p{int(round(p * 100))}"))
    return row.select(*out)


def numeric_describe(df: DataFrame, metric: str) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75% (linear), max in one row.

    Spark's ``stddev`` merges central moments, so it is stable for values far
    from 0. With an infinite value the mean is infinite and std is NaN, as in
    pandas.
    """
    vals = _values(df, metric)
    row = vals.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quart = exact_quantiles(df, metric, [0.25, 0.5, 0.75])
    q = quart.select(F.struct("p25", "p50", "p75")).scalar()
    return row.select(
        "count",
        "mean",
        "std",
        "min",
        q["p25"].alias("p25"),
        q["p50"].alias("p50"),
        q["p75"].alias("p75"),
        "max",
    )


def histogram(df: DataFrame, metric: str, bins: int = 10) -> DataFrame:
    """Fixed-width bins between min and max (one bin when they are equal).
    Bins cover the finite values; infinities cannot be binned."""
    vals = _values(df, metric).filter(F.abs(F.col("v")) != F.lit(float("inf")))
    bounds = vals.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width).cast("int"))
    )
    counted = vals.withColumn("bin", b.cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "bin",
        F.when(hi == lo, lo).otherwise(lo + F.col("bin") * width).alias("bin_start"),
        F.when(hi == lo, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "count",
    ).orderBy("bin")


def preview(df: DataFrame, order_by: list[str] | None = None, n: int = fv.PREVIEW_ROWS) -> DataFrame:
    """The first n rows in an explicit order."""
    order = order_by or df.columns
    return df.orderBy(*[_q(c).asc_nulls_last() for c in order]).limit(n)


def mean_by_group(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Mean of a metric per group, descending."""
    return (
        df.filter(_q(group).isNotNull())
        .groupBy(_q(group).alias(group))
        .agg(mean(metric).alias(metric))
        .orderBy(F.col(f"`{metric}`").desc_nulls_last(), F.col(f"`{group}`"))
    )


# ---- J8-J10: choosing and running an analysis ---------------------------------------


def preferred_column(columns: list[str], question: str, preferences: list[str]) -> str:
    """A column named in the question, else the first keyword match, else the first."""
    asked = question.lower()
    named = [c for c in columns if c.lower() in asked]
    if named:
        return named[0]
    for word in preferences:
        hits = [c for c in columns if word in c.lower()]
        if hits:
            return hits[0]
    return columns[0]


@dataclass
class Analysis:
    kind: str  # risk | category | numeric | preview
    frame: DataFrame
    params: dict
    data: DataFrame | None = None  # the analysed rows (for the chart table)


def choose_analysis(df: DataFrame, question: str, source: str = "parquet") -> tuple[str, dict]:
    """Risk when account, workload, duration_minutes and sla_minutes all
    exist; else a category summary; else a numeric describe; else a preview."""
    num = numeric_columns(df.schema)
    cat = categorical_columns(df.schema, source)
    if set(fv.RISK_REQUIRED_COLUMNS).issubset(set(num) | set(cat)):
        return "risk", {}
    if num and cat:
        return "category", {
            "category": preferred_column(cat, question, fv.CATEGORY_PREFERENCES),
            "metric": preferred_column(num, question, fv.METRIC_PREFERENCES),
        }
    if num:
        return "numeric", {"metric": preferred_column(num, question, fv.METRIC_PREFERENCES)}
    return "preview", {}


def auto_analyze(df: DataFrame, question: str, source: str = "parquet", order_by=None) -> Analysis:
    """Pick the analysis for the question and build its plan, over all rows."""
    kind, params = choose_analysis(df, question, source)
    if kind == "risk":
        frame = workload_risk(df)
    elif kind == "category":
        frame = category_summary(df, params["category"], params["metric"])
    elif kind == "numeric":
        frame = numeric_describe(df, params["metric"])
    else:
        frame = preview(df, order_by)
    return Analysis(kind, frame, params, df)


def chart_table(analysis: Analysis, bins: int = 10) -> DataFrame | None:
    """The bar chart's x / y / colour columns; histogram bins (J6) for a
    numeric analysis; nothing for a preview."""
    f = analysis.frame
    if analysis.kind == "numeric" and analysis.data is not None:
        return histogram(analysis.data, analysis.params["metric"], bins)
    if analysis.kind == "risk":
        return f.select(F.col("account").alias("x"), F.col("risk_score").alias("y"), F.col("workload").alias("color"))
    if analysis.kind == "category":
        cat = analysis.params["category"]
        return f.select(F.col(f"`{cat}`").alias("x"), F.col("mean").alias("y"), F.lit(None).cast("string").alias("color"))
    return None
