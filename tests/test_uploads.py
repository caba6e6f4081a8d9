import pytest

from fleetlake.plans.uploads import analyse_session, analysis_runs, stored_session, upload_dataset
from fleetlake.session import scratch_path
from fleetlake.sources.files import write_csv
from tests.conftest import SF_SMALL


def test_upload_then_questions(spark):
    base, path = scratch_path(spark, "uploads"), scratch_path(spark, "in") + "/events.csv"
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "event_type", "value")
    write_csv(events, path)
    row = upload_dataset(spark, path, base, "s1", order_by=["event_id"]).first()
    assert row.filename == "events.csv" and row.source == "csv"
    assert row.profile.rows == events.count() and row.profile.column_names == events.columns
    assert row.profile.categorical_columns == ["event_type"]
    features = spark.read.parquet(row.features_path)
    assert features.count() == 3
    answer = analyse_session(spark, base, "s1", "Compare value by event type").collect()
    assert len(answer) == min(10, events.select("event_type").distinct().count())
    analyse_session(spark, base, "s1", "Show value")
    runs = analysis_runs(spark, base).collect()
    assert len(runs) == 2 and {r.kind for r in runs} == {"category"} and all('"mean"' in r.result_json for r in runs)
    # the same id again replaces the session
    upload_dataset(spark, path, base, "s1", order_by=["event_id"])
    assert stored_session(spark, base, "s1").count() == 1
    with pytest.raises(KeyError):
        analyse_session(spark, base, "missing", "?")
