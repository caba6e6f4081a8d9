"""The corpus pipeline: quality, near-dedup, decontamination, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept. ``run`` writes each stage's rows as Parquet in the shared
checkpoint folder and reads them again, so a lost executor never costs more
than a stage. All but the last return the columns of ``docs``.

Null texts, repeated rows, empty tables and further columns are handled as the
operators' docstrings say: a null text has no n-grams, so quality does not
favour it; of equal rows one stays; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm.common import materialise, read
from fleetlake.llm.decontaminate import drop_contaminated
from fleetlake.llm.neardup import keep_one
from fleetlake.llm.packing import pack
from fleetlake.llm.personal_data import redact
from fleetlake.llm.quality import select_documents
from fleetlake.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good ones selects."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return select_documents(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of benchmark windows."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained and sampled stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
