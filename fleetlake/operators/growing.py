"""Profiles and distributions of data that grows, from one mergeable state per file and column.

A file is scanned once, when it is added. Its state has one small row for each
column: rows, missing values, and for numeric columns count, mean, squared
deviations, least and greatest value and a quantile sketch. States merge in any
order, so the profile of any set of files needs their states only. They are kept
in a keyed table (``operators/keyed``): a file that is added again replaces its
state.

Quantiles come from KLL sketches with ``SKETCH_K`` levels' width. The rank of
an answer is within ``RANK_ERROR`` of the one asked for (its normalized rank
error is 2.296 / k^0.9723 = 0.0014 with 99 % confidence; the stated bound is
seven times that). ``numeric_describe`` gives exact ones, by a sort.

A column that is missing from a file has no rows there; one whose type changes
from file to file is numeric where it was. NaN counts as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.functions.exprs import nan_to_null
from fleetlake.operators.keyed import read_rows, upsert_rows
from fleetlake.operators.profile import NUMERIC, is_missing
from fleetlake.operators.runlog import SEQ

SKETCH_K = 2000
RANK_ERROR = 0.01
STATE_SCHEMA = (
    "id string, file string, ordinal int, column_name string, spark_dtype string, row_count bigint, missing_count bigint, "
    f"n bigint, mean double, m2 double, min double, max double, sketch binary, {SEQ} bigint"
)


def file_state(df: DataFrame, file: str) -> DataFrame:
    """The state rows of one file, from one scan."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(is_missing(f)).alias(f"_m{i}"))
        if isinstance(f.dataType, NUMERIC):
            v = nan_to_null(F.col(f"`{f.name}`").cast("double"))
            aggs += [
                F.count(v).alias(f"_c{i}"),
                F.avg(v).alias(f"_a{i}"),
                F.var_pop(v).alias(f"_v{i}"),
                F.min(v).alias(f"_l{i}"),
                F.max(v).alias(f"_h{i}"),
                F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(f"_s{i}"),
            ]
    none = F.lit(None)
    rows = []
    for i, f in enumerate(fields):
        numeric = isinstance(f.dataType, NUMERIC)
        count = F.col(f"_c{i}") if numeric else F.lit(0)
        m2 = F.col(f"_v{i}") * F.col(f"_c{i}") if numeric else none
        rows.append(
            F.struct(
                F.lit(f"{file}:{f.name}").alias("id"),
                F.lit(file).alias("file"),
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("spark_dtype"),
                F.col("_n").alias("row_count"),
                F.col(f"_m{i}").alias("missing_count"),
                count.cast("bigint").alias("n"),
                *[(F.col(f"_{x}{i}") if numeric else none).cast("double").alias(c) for x, c in (("a", "mean"),)],
                m2.cast("double").alias("m2"),
                *[(F.col(f"_{x}{i}") if numeric else none).cast("double").alias(c) for x, c in (("l", "min"), ("h", "max"))],
                (F.when(F.col(f"_c{i}") > 0, F.col(f"_s{i}")) if numeric else none).cast("binary").alias("sketch"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows))).withColumn(SEQ, F.unix_micros(F.current_timestamp()))


def add_file(spark: SparkSession, table: str, df: DataFrame, file: str) -> int:
    """Scan ``df`` once and keep its state under the name ``file``."""
    return upsert_rows(spark, table, file_state(df, file), STATE_SCHEMA)


def states(spark: SparkSession, table: str) -> DataFrame:
    return read_rows(spark, table, STATE_SCHEMA).drop(SEQ)


def merge_states(parts: DataFrame) -> DataFrame:
    """One row for each column over all files given: counts, moments and the merged sketch."""
    own = Window.partitionBy("column_name")
    total = F.sum(F.when(F.col("n") > 0, F.col("n") * F.col("mean"))).over(own) / F.nullif(
        F.sum("n").over(own).cast("double"), F.lit(0.0)
    )
    # around the common mean, so that values far from 0 keep their deviations
    apart = F.when(F.col("n") > 0, F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0)))
    merged = (
        parts.withColumn("_mean", total)
        .withColumn("_apart", apart)
        .groupBy("column_name")
        .agg(
            F.min("ordinal").alias("ordinal"),
            F.max_by("spark_dtype", F.struct("row_count", "file")).alias("spark_dtype"),
            F.sum("missing_count").alias("missing_count"),
            F.sum("row_count").alias("row_count"),
            F.sum("n").alias("count"),
            F.first("_mean").alias("mean"),
            F.sum("_apart").alias("m2"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.kll_merge_agg_double("sketch").alias("sketch"),
        )
    )
    spread = F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1)))
    return merged.withColumn("std", spread).drop("m2")


def merged_features(spark: SparkSession, table: str) -> DataFrame:
    """A6 over all files added, without reading them."""
    found = merge_states(states(spark, table))
    return found.select("ordinal", "column_name", "spark_dtype", "missing_count", "row_count")


def sketched_quantiles(merged: DataFrame, probs: list[float]) -> DataFrame:
    """``column_name``, ``p`` and ``quantile`` (a value of the column) for the numeric columns of ``merge_states``."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    numeric = merged.filter(F.col("count") > 0)
    found = F.kll_sketch_get_quantile_double("sketch", wanted)
    return numeric.select("column_name", F.inline(F.arrays_zip(wanted.alias("p"), found.alias("quantile"))).alias("p", "quantile"))


def sketched_describe(merged: DataFrame) -> DataFrame:
    """J5 for every numeric column from its state: as ``numeric_describe``, quartiles within ``RANK_ERROR``."""
    quarter = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return merged.filter(F.col("count") > 0).select("column_name", "count", "mean", "std", "min", *quarter, "max")
