"""An uploaded file as one job, and questions to a stored upload.

``upload_dataset`` reads the file, lands it as bronze, stores its feature
table, profiles it and upserts the session row, which carries the kind of
source along. Every upload has folders of its own and the session row names
them, so a second upload under the same id leaves running analyses their rows,
and rows, features and profile always belong together. ``analyse_session``
loads a session, analyses its landed rows and appends the run with its result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.operators.analysis import auto_analyze
from fleetlake.operators.keyed import read_row, read_rows, upsert_rows
from fleetlake.operators.profile import column_features, profile_summary
from fleetlake.operators.runlog import append_runs, load_session
from fleetlake.sources.files import land_bronze, read_dataset, write_parquet_dataset

SESSION_SCHEMA = (
    "id string, filename string, source string, bronze_path string, features_path string, profile_json string, "
    "created_at timestamp, _seq bigint"
)
PROFILE_SCHEMA = (
    "filename string, rows bigint, columns int, column_names array<string>, dtypes map<string,string>, "
    "numeric_columns array<string>, categorical_columns array<string>, missing_values map<string,bigint>, "
    "sample_rows string"
)


def _sessions(base: str) -> str:
    return f"{base.rstrip('/')}/_system/sessions"


def _runs(base: str) -> str:
    return f"{base.rstrip('/')}/_system/analysis_runs"


def upload_dataset(
    spark: SparkSession, path: str, base: str, session_id: str, schema=None, multi_line: bool = True, order_by=None
) -> DataFrame:
    """The stored session row of the file at ``path``, its profile decoded."""
    filename = os.path.basename(path.rstrip("/"))
    source = os.path.splitext(filename)[1].lstrip(".").lower() or "parquet"
    root = base.rstrip("/")
    upload = uuid.uuid4().hex
    bronze_path, features_path = f"{root}/bronze/{session_id}/{upload}", f"{root}/features/{session_id}/{upload}"
    landed = land_bronze(read_dataset(spark, path, schema, multi_line), bronze_path)
    data = landed.drop("_ingested_at")
    write_parquet_dataset(column_features(data), features_path)
    row = profile_summary(data, filename, order_by, source).select(
        F.lit(session_id).alias("id"),
        "filename",
        F.lit(source).alias("source"),
        F.lit(bronze_path).alias("bronze_path"),
        F.lit(features_path).alias("features_path"),
        F.to_json(F.struct("*")).alias("profile_json"),
        F.current_timestamp().alias("created_at"),
        F.unix_micros(F.current_timestamp()).alias("_seq"),
    )
    upsert_rows(spark, _sessions(base), row, SESSION_SCHEMA)
    return stored_session(spark, base, session_id)


def stored_session(spark: SparkSession, base: str, session_id: str) -> DataFrame:
    """H7: the session with its profile decoded."""
    return load_session(read_row(spark, _sessions(base), SESSION_SCHEMA, session_id), session_id, PROFILE_SCHEMA)


def stored_sessions(spark: SparkSession, base: str) -> DataFrame:
    """All sessions as stored."""
    return read_rows(spark, _sessions(base), SESSION_SCHEMA)


def analyse_session(spark: SparkSession, base: str, session_id: str, question: str, order_by=None) -> DataFrame:
    """The answer's rows; the run is appended to the analysis log with them as JSON.

    Answers are top-k reports, one row or a preview, so their JSON is small.
    """
    session = stored_session(spark, base, session_id).select("source", "bronze_path").first()  # one row
    if session is None:
        raise KeyError(f"no session {session_id!r} under {base}")
    data = spark.read.parquet(session.bronze_path).drop("_ingested_at")
    found = auto_analyze(data, question, session.source, order_by)
    result = found.frame.agg(F.to_json(F.collect_list(F.struct("*"))).alias("result_json"))
    append_runs(
        result.select(
            F.lit(session_id).alias("session_id"),
            F.lit(question).alias("query"),
            F.lit(found.kind).alias("kind"),
            "result_json",
            F.current_timestamp().alias("created_at"),
        ),
        _runs(base),
    )
    return found.frame


def analysis_runs(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(_runs(base))
