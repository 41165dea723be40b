"""The report of the last anomalous window, looked up where no window is anomalous."""

from datetime import datetime, timedelta

from loglantern.checks.queries import QUERIES


def test_lookup_without_any_report(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=5 * i), i % 7, "view", 1.5) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["incident_by_id"](spark, str(tmp_path))
    assert got.columns == ["id", "ts", "title", "severity", "category"]
    assert got.collect() == [] == QUERIES["latest_incidents"](spark, str(tmp_path)).collect()
