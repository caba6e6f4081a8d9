"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows lie in ``blocks`` (groups of scan partitions). How many rows of each
block go to each shard is drawn first, by the exact law of a uniform
permutation: row sums are the block counts, column sums the shard sizes, and
every entry a hypergeometric draw from what the shards still lack. Each block
then permutes its rows locally and cuts them by its row of the matrix
(exchange), and each shard permutes what it received. The second permutation
sorts by a random hash in cells of about ``rows_per_cell`` rows; counts of the
cells give their first slots, so no task ever holds a whole shard.

Only ids, sizes and hashes move; the matrix has ``blocks x shards`` numbers.

Cases: null text has size 1 and the crc32 of the empty text; repeated rows
are rows of their own; an empty table gives no rows; other columns are kept
when named in ``keep``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import materialise, narrow

SHARDS = 16
MAX_BLOCKS = 2048
ROWS_PER_CELL = 1 << 18


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from a pool of any size, by inversion around the mode.

    Probabilities farther than 12 deviations out (below 1e-30) count as 0.
    """
    least, most = max(0, draws - bad), min(good, draws)
    if least == most:
        return least
    pool = good + bad
    share = good / pool
    spread = 12 * (draws * share * (1 - share) * (pool - draws) / max(1, pool - 1)) ** 0.5 + 12
    mode = min(most, max(least, (draws + 1) * (good + 1) // (pool + 2)))
    k = np.arange(max(least, int(mode - spread)), min(most, int(mode + spread)) + 1, dtype=np.float64)
    step = (
        np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1)
    )
    log_p = np.concatenate(([0.0], np.cumsum(step)))
    p = np.exp(log_p - log_p.max())
    return int(k[min(len(k) - 1, np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"))])


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that block i sends to shard j, for a uniform permutation of all rows."""
    rng = np.random.default_rng(seed)
    lack, out = list(shard_rows), []
    for rows in block_rows:
        pool, row = sum(lack), []
        for open_ in lack:
            row.append(hypergeometric(rng, open_, pool - open_, rows))
            pool, rows = pool - open_, rows - row[-1]
        lack = [a - b for a, b in zip(lack, row, strict=True)]
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = 8, rows_per_cell: int = ROWS_PER_CELL, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``keep``, ``shard`` and ``slot`` (0-based, gapless in its shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        narrow(docs, "doc_id", "text", *keep).select(
            "doc_id",
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            *keep,
            (F.spark_partition_id() % F.lit(MAX_BLOCKS)).alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    # one count per block, at most MAX_BLOCKS numbers
    counts = sorted((r["block"], r["n"]) for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = shard_sizes(sum(n for _, n in counts), shards)
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    moves = []
    for (block, _), row in zip(counts, matrix, strict=True):
        hi = 0
        for shard, n in enumerate(row):
            lo, hi = hi, hi + n
            moves.append((block, shard, lo, hi))
    plan = spark.createDataFrame(moves, "block int, shard int, lo bigint, hi bigint")
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "row"), "row")
    ranked = rows.withColumn("rank", F.row_number().over(local) - 1)
    per_shard = max(1, -(-sizes[0] // rows_per_cell))
    order = F.xxhash64(F.lit(seed + 1), "row")
    sent = materialise(
        ranked.join(plan, "block")
        .filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .drop("lo", "hi", "rank", "block")
        .withColumn("order", order)
        .withColumn("cell", F.pmod("order", F.lit(per_shard)).cast("int")),
        "shard-sent",
    )
    first = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        sent.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first"))
    )
    received = Window.partitionBy("shard", "cell").orderBy("order", "row")
    return (
        sent.withColumn("at", F.row_number().over(received) - 1)
        .join(cells, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", *keep, "shard", (F.col("first") + F.col("at")).cast("bigint").alias("slot")
        )
    )
