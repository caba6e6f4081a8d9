"""Run logs and sessions as latest-wins tables (H1-H8).

Instead of a database with a primary key, a run log is a parquet table plus
update batches. An upsert unions base and updates with a sequence number and
keeps, per id, the row with the highest sequence (``max_by`` -- a partial
aggregate, so an id with a third of all updates is merged per task before
the shuffle). The result is written as a new version, never over the path
being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.functions.fixed_values import PIPELINE_RUNS_SHOWN, SESSIONS_SHOWN

PIPELINE_RUNS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("finished_at", T.StringType()),
        T.StructField("summary_json", T.StringType()),
        T.StructField("error_text", T.StringType()),
    ]
)

AGENT_RUNS_SCHEMA = T.StructType(
    PIPELINE_RUNS_SCHEMA.fields[:1] + [T.StructField("incident_id", T.StringType())] + PIPELINE_RUNS_SCHEMA.fields[1:]
)

SEQ = "_seq"


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", seq: str = SEQ) -> DataFrame:
    """H1/H5: insert new ids, replace every other column of existing ids.

    Both inputs carry ``seq`` (base rows must order before their updates);
    the latest row per id wins as a whole, nulls included.
    """
    cols = [c for c in base.columns if c not in (key, seq)]
    both = base.unionByName(updates.select(*base.columns))
    latest = both.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols + [seq]]), F.col(seq)).alias("_r"))
    return latest.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols + [seq]])


def encode_summary(fields: dict[str, Column]) -> Column:
    """H2: the run summary as JSON text."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def run_record(
    run_id: Column, status: Column, started_at: Column, finished_at: Column, summary: Column | None, error: Column
) -> list[Column]:
    """H2: columns of a pipeline run row (summary already JSON text or null)."""
    return [
        run_id.alias("id"),
        status.alias("status"),
        started_at.alias("started_at"),
        finished_at.alias("finished_at"),
        (summary if summary is not None else F.lit(None).cast("string")).alias("summary_json"),
        error.alias("error_text"),
    ]


def recent_runs(runs: DataFrame, n: int = PIPELINE_RUNS_SHOWN) -> DataFrame:
    """H3: newest runs first (top-n)."""
    return runs.orderBy(F.col("started_at").desc_nulls_last(), F.col("id")).limit(n)


def decode_summary(runs: DataFrame, schema: T.StructType | str, column: str = "summary_json") -> DataFrame:
    """H4: ``summary`` parsed from JSON text; null when the text is null or empty."""
    text = F.col(column)
    parsed = F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(F.from_json(text, schema))
    return runs.withColumn("summary", parsed).drop(column)


def decode_variant(runs: DataFrame, column: str = "summary_json") -> DataFrame:
    """H4 without a schema: ``summary`` as VARIANT with whatever fields each run has.

    Null when the text is null, empty or not JSON. Fields are read by path:
    ``F.try_variant_get("summary", "$.rows", "int")``.
    """
    return runs.withColumn("summary", F.try_parse_json(F.nullif(F.col(column), F.lit("")))).drop(column)


def summary_fields(runs: DataFrame, column: str = "summary_json") -> str:
    """The type that holds the summaries of all runs, found by one aggregate (one text)."""
    return decode_variant(runs, column).select(F.schema_of_variant_agg("summary")).first()[0]


PROFILE_HEAD_SCHEMA = "rows BIGINT, columns INT, column_names ARRAY<STRING>"


def session_list(sessions: DataFrame, n: int = SESSIONS_SHOWN) -> DataFrame:
    """H6: newest sessions with rows, columns and column names taken out of
    the stored profile JSON."""
    head = F.from_json(F.col("profile_json"), PROFILE_HEAD_SCHEMA)
    return (
        sessions.orderBy(F.col("created_at").desc_nulls_last(), F.col("id"))
        .limit(n)
        .select(
            "id",
            "filename",
            "created_at",
            head["rows"].alias("rows"),
            head["columns"].alias("columns"),
            F.coalesce(head["column_names"], F.array().cast("array<string>")).alias("column_names"),
        )
    )


def load_session(sessions: DataFrame, session_id, profile_schema: T.StructType | str | None = None) -> DataFrame:
    """H7: one session by id (a pushed-down filter); its profile JSON is
    decoded into ``profile`` when its schema is given."""
    key = F.lit(session_id) if isinstance(session_id, str) else session_id
    found = sessions.filter(F.col("id") == key)
    if profile_schema is None:
        return found
    return found.withColumn("profile", F.from_json("profile_json", profile_schema)).drop("profile_json")


def append_runs(runs: DataFrame, path: str) -> None:
    """H8: append analysis runs."""
    runs.write.mode("append").parquet(path)


def _commits(table_dir: str) -> str:
    return f"{table_dir.rstrip('/')}/_commits"


def current_version(spark, table_dir: str) -> int | None:
    """Newest committed version: the commit log is append-only (one tiny JSON
    row per version, written after the version's data), so a reader never sees
    a version whose files are still being written."""
    from pyspark.errors import AnalysisException

    try:
        log = spark.read.schema("version INT").json(_commits(table_dir))
    except AnalysisException:
        return None
    return log.agg(F.max("version")).first()[0]  # one value


def read_current(spark, table_dir: str, schema) -> DataFrame:
    """The newest committed version (an empty frame before the first commit)."""
    v = current_version(spark, table_dir)
    if v is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{table_dir.rstrip('/')}/version={v:08d}")


def publish_upsert(spark, table_dir: str, updates: DataFrame, schema, key: str = "id", seq: str = SEQ) -> int:
    """H1 on storage: upsert ``updates`` into the newest version and write the
    result as the next version, then commit it. The version being read is
    never overwritten. Returns the new version number."""
    from fleetlake.sources.files import publish_version

    v = current_version(spark, table_dir)
    new = 1 if v is None else v + 1
    publish_version(upsert(read_current(spark, table_dir, schema), updates, key, seq), table_dir, f"{new:08d}")
    spark.createDataFrame([(new,)], "version INT").coalesce(1).write.mode("append").json(_commits(table_dir))
    return new
