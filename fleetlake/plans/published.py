"""The lake that serving queries read: refreshed once for a set of source files, read by many queries.

As in the application this follows, a refresh publishes its tables and the
dashboard, the lookups and the triage read them. A refresh is made when a
session first asks for a folder of source tables, and again when their files
have changed or its own are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlake.plans.medallion import Layout, current_table, run_feature_pipeline
from fleetlake.session import scratch_path, table_path
from fleetlake.sources.telemetry import load_telemetry

SOURCES = ("orders", "customer", "nation", "region", "lineitem")
_LAKES: dict[tuple, str] = {}


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, size and time of every file of the source tables (a listing, no data)."""
    found = []
    for name in SOURCES:
        root = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(root)]
    return tuple(sorted(found))


def _exists(spark: SparkSession, base: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(Layout(base).manifest)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def published_lake(spark: SparkSession, sf_dir: str) -> str:
    """Base folder of the lake over ``sf_dir``."""
    key = (spark.sparkContext.applicationId, _fingerprint(spark, sf_dir))
    if key not in _LAKES or not _exists(spark, _LAKES[key]):
        base = scratch_path(spark, "lake")
        run_feature_pipeline(spark, load_telemetry(spark, sf_dir), base)
        _LAKES[key] = base
    return _LAKES[key]


def published(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return current_table(spark, published_lake(spark, sf_dir), name)
