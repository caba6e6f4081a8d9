from pyspark.sql import functions as F

from fleetlake.plans.medallion import current_table, run_feature_pipeline
from fleetlake.session import scratch_path
from fleetlake.sources.telemetry import load_telemetry
from tests.conftest import SF_SMALL


def test_refresh_publishes_versions_and_manifest(spark):
    base = scratch_path(spark, "lake-test")
    tel = load_telemetry(spark, SF_SMALL)
    m1 = run_feature_pipeline(spark, tel, base).first()
    assert m1.raw_rows == m1.feature_rows == tel.count()
    assert m1.incident_count == 16
    queue = current_table(spark, base, "incident_queue")
    assert queue.count() == 16 and "incident_id" in queue.columns
    health = current_table(spark, base, "customer_health")
    assert health.count() == m1.customer_count
    # bronze keeps text dates; silver ids are unique
    bronze = spark.read.schema(tel.schema.add("ingested_at", "string")).parquet(m1.output_paths["bronze"])
    assert dict(bronze.dtypes)["partition_date"] == "string"
    silver = current_table(spark, base, "silver")
    assert silver.select(F.count_distinct("incident_id")).first()[0] == tel.count()
    # a second refresh writes a new version; the manifest moves, the old version stays readable
    m2 = run_feature_pipeline(spark, tel, base).first()
    assert m2.output_paths["silver"] != m1.output_paths["silver"]
    assert spark.read.parquet(m1.output_paths["silver"]).count() == tel.count()
    assert m2.run_id != m1.run_id


def test_refresh_ids_equal_the_checkpointed_positions(spark):
    from fleetlake.operators.silver import build_silver

    base = scratch_path(spark, "lake-ids")
    tel = load_telemetry(spark, SF_SMALL)
    run_feature_pipeline(spark, tel, base)
    stored = current_table(spark, base, "silver").select("job_id", "incident_id")
    direct = build_silver(tel, num_partitions=3).select("job_id", "incident_id")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect()))


def test_published_health_equals_direct_health(spark):
    from fleetlake.operators.health import build_customer_health
    from fleetlake.operators.silver import score_silver

    base = scratch_path(spark, "lake-health")
    tel = load_telemetry(spark, SF_SMALL)
    run_feature_pipeline(spark, tel, base, days=90)
    published = current_table(spark, base, "customer_health")
    direct = build_customer_health(score_silver(tel), 90)
    cols = sorted(direct.columns)
    assert sorted(map(tuple, published.select(*cols).collect())) == sorted(map(tuple, direct.select(*cols).collect()))


def test_refresh_and_triage_write_run_rows(spark):
    import json

    import pytest

    from fleetlake.plans.medallion import agent_runs, pipeline_runs, run_triage

    base = scratch_path(spark, "lake-runs")
    tel = load_telemetry(spark, SF_SMALL)
    m = run_feature_pipeline(spark, tel, base).first()
    assert set(m.output_paths) == {"raw", "bronze", "silver", "customer_health", "incidents", "incident_queue"}
    assert spark.read.parquet(m.output_paths["raw"]).count() == tel.count()
    with pytest.raises(Exception):
        run_feature_pipeline(spark, tel.drop("status"), base)
    runs = {r.status: r for r in pipeline_runs(spark, base).collect()}
    assert set(runs) == {"completed", "failed"}
    assert json.loads(runs["completed"].summary_json)["raw_rows"] == tel.count() and runs["completed"].finished_at
    assert runs["failed"].error_text and runs["failed"].summary_json is None
    # the failed refresh has not moved the tables
    assert current_table(spark, base, "silver").count() == tel.count()
    reports = run_triage(spark, base)
    run_triage(spark, base)
    everything = agent_runs(spark, base, 10**6)
    assert everything.count() == reports.count() == everything.select("incident_id").distinct().count()
    assert agent_runs(spark, base).count() == 8


def test_bronze_bins_hold_neighbouring_dates(spark):
    import os

    from fleetlake.plans.medallion import date_bins

    rows = spark.createDataFrame(
        [("2024-01-01",)] * 3 + [("2024-01-02",)] * 2 + [("2024-01-03",)] * 40 + [("2024-01-04",), (None,)], "partition_date string"
    )
    bins = {r.d: r.dates_from for r in date_bins(rows, 5).collect()}
    first, last = "2024-01-01", "2024-01-04"
    assert bins == {first: first, "2024-01-02": first, "2024-01-03": "2024-01-03", last: last, None: last}
    base = scratch_path(spark, "lake-bins")
    m = run_feature_pipeline(spark, load_telemetry(spark, SF_SMALL), base, bin_rows=400).first()
    folders = [f for f in os.listdir(m.output_paths["bronze"].removeprefix("file:")) if f.startswith("dates_from=")]
    assert 3 <= len(folders) <= 5


def test_lookups_skip_row_groups(spark):
    from fleetlake.operators.dashboard import load_incident
    from fleetlake.sources.files import write_parquet_dataset

    rows = spark.range(20000).selectExpr("concat('inc-', cast(pmod(id * 7919, 20000) as string)) incident_id", "id n").coalesce(1)
    path = scratch_path(spark, "bloom")
    spark.conf.set("parquet.block.size", "16384")
    spark.conf.set("parquet.block.size.row.check.min", "100")
    try:
        rows.write.option("parquet.block.size", "16384").parquet(path + "/plain")
        write_parquet_dataset(rows, path + "/bloom", lookup_by=["incident_id"])
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.block.size.row.check.min")

    def scanned(name):
        df = load_incident(spark.read.parquet(f"{path}/{name}"), "inc-77")
        assert df.count() == 1 and len(df.collect()) == 1
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))

    assert scanned("bloom") < scanned("plain") / 2


def test_sorts_of_a_refresh_are_dealt_by_rows(spark, monkeypatch):
    """No task of the sorts holds many more rows than SORT_ROWS, however well they compress; the tables are the same."""
    from fleetlake.operators import position
    from fleetlake.operators.silver import build_silver

    tel = load_telemetry(spark, SF_SMALL)
    monkeypatch.setattr(position, "SORT_ROWS", 100)
    base = scratch_path(spark, "lake-rows")
    m = run_feature_pipeline(spark, tel, base, days=90).first()
    n = tel.count()
    blocks = spark.read.parquet(m.output_paths["bronze"]).groupBy("row_block").count()
    assert blocks.count() > n // 200 and blocks.agg(F.max("count")).first()[0] < 400
    for table in ("silver", "incidents"):
        files = current_table(spark, base, table).groupBy(F.input_file_name()).count()
        assert files.agg(F.max("count")).first()[0] < 400
    stored = current_table(spark, base, "silver").select("job_id", "incident_id")
    direct = build_silver(tel, num_partitions=3).select("job_id", "incident_id")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect()))


def test_a_refresh_scores_and_words_each_run_once(spark, monkeypatch):
    """Silver is dealt by bronze's blocks, without a sample of scored rows; incident texts are made after the sort."""
    from fleetlake.operators import position
    from fleetlake.plans import medallion
    from fleetlake.sources.files import publish_version

    seen = {}

    def publish(df, base, version, *args, **options):
        seen[base.rsplit("/", 1)[1]] = (df, options)
        return publish_version(df, base, version, *args, **options)

    monkeypatch.setattr(position, "SORT_ROWS", 100)
    monkeypatch.setattr(medallion, "publish_version", publish)
    base = scratch_path(spark, "lake-once")
    run_feature_pipeline(spark, load_telemetry(spark, SF_SMALL), base, days=90)
    silver, options = seen["silver"]
    assert options["dealt"] and "rangepartitioning" not in silver._jdf.queryExecution().executedPlan().toString()
    incidents, options = seen["incidents"]
    assert "summary_line" not in incidents.columns and "summary_line" in options["finish"](incidents).columns
    # every silver file is one block's runs of a severity, in event order
    files = current_table(spark, base, "silver").groupBy(F.input_file_name().alias("f"), "severity")
    times = sorted(map(tuple, files.agg(F.min("event_ts").alias("a"), F.max("event_ts").alias("b")).select("severity", "a", "b").collect()))
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(times, times[1:]))


def test_queue_of_a_stored_table_reads_few_whole_rows(spark):
    """The queue is the same with ties, repeats, missing times and few rows; other ranks' row groups are skipped."""
    from fleetlake.operators.incidents import top_incidents, top_stored_incidents

    def same(rows, n=16):
        a, b = (sorted(map(str, f(rows, n).collect())) for f in (top_incidents, top_stored_incidents))
        assert a == b and len(a) == min(n, rows.count())

    k = F.col("id")
    rows = spark.range(200).select(
        (k % 3).cast("int").alias("severity_rank"),
        F.when(k % 5 > 0, F.expr("timestamp_ntz'2024-03-31 02:30:00.123456' + make_dt_interval(0, 0, 0, cast(id % 7 as int))")).alias("event_ts"),
        F.when(k % 11 > 0, F.concat(F.lit("inc-"), (k % 50).cast("string"))).alias("incident_id"),
    )
    for n in (0, 1, 16, 60, 67, 150, 500):
        same(rows, n)
    same(rows.limit(0))
    same(rows.withColumn("event_ts", F.lit(None).cast("timestamp_ntz")))
    same(rows.withColumn("event_ts", F.col("event_ts").cast("timestamp")))
    same(rows.withColumn("severity_rank", F.lit(None).cast("int")))
    path = scratch_path(spark, "queue")
    timed = spark.range(4000).select((k % 8).cast("int").alias("severity_rank"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("event_ts"), k.cast("string").alias("incident_id"))
    for rank in range(8):
        timed.filter(F.col("severity_rank") == rank).write.mode("append").parquet(path)
    found = top_stored_incidents(spark.read.parquet(path))
    found.collect()
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    stages = [leaves.apply(i) for i in range(leaves.length())]
    assert sum(s.metrics().apply("numOutputRows").value() for s in stages) < 1000
