from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlake.operators.position import with_global_position


def test_matches_single_window_with_skewed_key(spark):
    # a third of the rows share one key value; the tie-break splits them
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id")
    )
    want = df.withColumn("p", F.row_number().over(Window.orderBy("k", "id")) - 1)
    for n in (1, 5, 17):
        got = with_global_position(df, [F.col("k"), F.col("id")], "p", num_partitions=n)
        assert sorted(got.collect()) == sorted(want.collect())


def test_empty_input(spark):
    df = spark.range(0).select(F.col("id").alias("k"))
    assert with_global_position(df, [F.col("k")], "p").count() == 0


def test_adaptive_block_count(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    want = df.withColumn("p", F.row_number().over(Window.orderBy("k", "id")) - 1)
    got = with_global_position(df, [F.col("k"), F.col("id")], "p")
    assert sorted(got.collect()) == sorted(want.collect())
