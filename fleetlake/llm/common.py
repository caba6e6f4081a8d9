"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.session import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by its own ``sys.path`` only."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage in files that every executor can read, so a lost executor
    costs a retry of the reading task only, and later steps see one fixed set
    of rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Writes inside let go of their shuffle files when they end, not at the driver's next collection of garbage.

    Only for steps that are written as they go: a DataFrame that is run again
    makes its shuffles anew. The session's setting is restored.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 1 << 19
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches holding about ``max_bytes`` of UTF-8 text, or one longer text; null is empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        lo, texts, size = 0, [], 0
        # few texts at a time leave Arrow's buffers, however many a batch holds
        for at in range(0, len(col), 64):
            for i, t in enumerate(col.slice(at, 64).to_pylist(), at):
                t = t or b""
                if size and size + len(t) > max_bytes:
                    yield batch.slice(lo, i - lo), texts
                    lo, texts, size = i, [], 0
                texts.append(t)
                size += len(t)
        if texts:
            yield batch.slice(lo), texts


def narrow(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the columns an operator reads, so that clashing names of other columns cannot matter."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``order``, ``doc_id``, ``text``, ``label`` of at most ``max_rows`` labelled ids, by a hash of the id.

    The sample of ids has a proven size, so it is broadcast and texts stay
    where they are. Null labels and ids are left out; of several labels of an
    id the largest counts.
    """
    order = F.xxhash64(F.lit(2), "doc_id")
    chosen = (
        labels.select("doc_id", F.col("label").cast("int"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("order", order)
        .orderBy("order")
        .limit(max_rows)
    )
    return narrow(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
