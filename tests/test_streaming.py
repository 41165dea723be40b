"""Stream = batch: what a stream emits equals the batch result on closed windows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from loglantern import schemas
from loglantern.checks.fixtures import HOUR, view
from loglantern.operators.metrics import service_window_metrics
from loglantern.operators.related import near_alerts
from loglantern.operators.summaries import window_summaries
from loglantern.operators.throttle import throttle_notifications
from loglantern.plans import jobs
from loglantern.sources.tables import (
    compact_incidents, incident_by_id, read_batches, read_days, read_incidents, stream_batches, write_batch, write_days, write_incidents,
)
from loglantern.streaming import streams as S


def rows(df):
    return sorted(map(str, df.collect()))


def run(df, tmp, name, mode="append"):
    """Drain a stream into a table and read it back."""
    q = df.writeStream.format("parquet").option("path", f"{tmp}/{name}").outputMode(mode)
    S.start(q, f"{tmp}/{name}-cp").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp}/{name}")


@pytest.fixture(scope="module")
def land(spark, sf, tmp_path_factory):
    """Raw lines in four files in time order, ingested one file per micro-batch."""
    tmp = str(tmp_path_factory.mktemp("land"))
    raw = view(spark, sf, "rawlogs").withColumnRenamed("event_ts", "source_ts")
    for i in range(4):
        raw.where(F.floor(F.col("ord") / 250) == i).coalesce(1).write.mode("append").parquet(f"{tmp}/raw")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/raw")
    S.start_ingest(stream, f"{tmp}/out", f"{tmp}/cp", pane_sec=HOUR, ingest_ts=F.col("source_ts")).awaitTermination()
    return tmp, raw


def test_ingest_equals_batch(spark, land):
    tmp, raw = land
    logs = jobs.parse_logs(raw, ingest_ts=F.col("source_ts")).select(*schemas.LOG.fieldNames())
    assert rows(read_batches(spark, f"{tmp}/out/logs", schemas.LOG).drop("batch_id")) == rows(logs)
    alerts = jobs.detect_alerts(raw, ingest_ts=F.col("source_ts"))
    assert rows(read_batches(spark, f"{tmp}/out/alerts", schemas.ALERT).drop("batch_id")) == rows(alerts)


def test_metric_stream_equals_batch_on_closed_windows(spark, land):
    tmp, raw = land
    panes = stream_batches(spark, f"{tmp}/out/panes", S.PANE)
    closed = run(S.metric_stream(panes, HOUR, 6 * HOUR, HOUR, delay_sec=0), tmp, "metrics")
    logs = jobs.parse_logs(raw, ingest_ts=F.col("source_ts"))
    batch = service_window_metrics(logs, HOUR, 6 * HOUR, HOUR)
    last = logs.agg(F.date_trunc("hour", F.max("event_ts")).alias("t")).first()["t"]
    expected = rows(batch.where(F.col("window_end") <= F.lit(last)))
    got = rows(closed)
    assert set(got) <= set(rows(batch))
    assert set(expected) <= set(got)
    assert len(got) == len(set(got))


def test_replayed_pane_batch_changes_nothing(spark, land, tmp_path):
    """A batch written twice under new file names is still counted once."""
    tmp, _ = land
    panes = read_batches(spark, f"{tmp}/out/panes", S.PANE)
    for part in (panes.where("batch_id < 2"), panes.where("batch_id = 1"), panes.where("batch_id >= 2")):
        part.coalesce(1).write.mode("append").partitionBy("batch_id").parquet(f"{tmp_path}/panes")
    once = run(S.metric_stream(stream_batches(spark, f"{tmp}/out/panes", S.PANE), HOUR, 6 * HOUR, HOUR, 0), tmp_path, "once")
    twice = run(S.metric_stream(stream_batches(spark, f"{tmp_path}/panes", S.PANE), HOUR, 6 * HOUR, HOUR, 0), tmp_path, "twice")
    assert rows(once) == rows(twice)


def test_summary_stream_equals_batch_and_feeds_incidents(spark, land):
    tmp, raw = land
    panes = stream_batches(spark, f"{tmp}/out/panes", S.PANE)
    counts = S.service_count_stream(panes, 3 * HOUR, HOUR, delay_sec=0)
    answer = '{"is_anomaly": true, "severity": "high", "category": "error_spike", "summary": "s"}'

    def reviewer(payloads):
        assert all('"sample_logs":[{' in p for p in payloads)
        return [answer] * len(payloads)

    def incidents(summaries, batch_id):
        alerts = read_batches(spark, f"{tmp}/out/alerts", schemas.ALERT).drop("batch_id")
        write_incidents(jobs.build_incidents(summaries, alerts), f"{tmp}/incidents", batch_id)

    S.start_summaries(
        counts, f"{tmp}/out/tails", f"{tmp}/summaries", f"{tmp}/s-cp",
        window_sec=3 * HOUR, slide_sec=HOUR, reviewer=reviewer, then=incidents,
    ).awaitTermination()
    closed = read_batches(spark, f"{tmp}/summaries", schemas.SUMMARY).drop("batch_id")
    logs = jobs.parse_logs(raw, ingest_ts=F.col("source_ts"))
    batch = window_summaries(logs, None, 3 * HOUR, HOUR)
    counted = ["window_start", "window_end", "total_logs", "error_count", "warn_count", "services_top"]
    got = rows(closed.select(counted))
    assert len(got) > 500 and set(got) <= set(rows(batch.select(counted)))
    stored = read_incidents(spark, f"{tmp}/incidents")
    assert stored.count() == len(got)
    one = stored.first()
    assert incident_by_id(spark, f"{tmp}/incidents", one["id"]).first() == one


def test_near_alert_stream(spark, land):
    tmp, _ = land
    logs, alerts = (stream_batches(spark, f"{tmp}/out/{n}", s) for n, s in (("logs", schemas.LOG), ("alerts", schemas.ALERT)))
    got = run(S.near_alert_stream(logs.drop("batch_id"), alerts, delay_sec=10**7), tmp, "near")
    batch = near_alerts(*(read_batches(spark, f"{tmp}/out/{n}", s).drop("batch_id") for n, s in (("logs", schemas.LOG), ("alerts", schemas.ALERT))))
    assert rows(got.select("ord")) == rows(batch.select("ord"))


def _notices(spark, sf):
    e = view(spark, sf, "spans")
    return e.select(
        "ord", (F.col("ord") % 3).alias("scope"), F.col("event_ts").alias("window_end"), F.col("event_ts").alias("window_start"),
        F.col("name").alias("category"), F.col("service").alias("severity"), F.lit(True).alias("is_anomaly"), F.lit("x").alias("summary"),
    )


def test_throttle_stream_equals_batch(spark, sf, tmp_path):
    notices = _notices(spark, sf)
    for i in range(3):
        notices.where(F.floor(F.col("ord") / 334) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/n")
    stream = spark.readStream.schema(notices.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/n")
    got = run(S.throttle_stream(stream, "scope", gap_ms=12 * HOUR * 1000), tmp_path, "thr")
    batch = throttle_notifications(notices, 12 * HOUR * 1000, ["scope"])
    assert 0 < batch.count() < notices.count()
    assert rows(got.select("ord")) == rows(batch.select("ord"))


def test_dedupe_stream(spark, sf, tmp_path):
    notices = _notices(spark, sf)
    for _ in range(2):
        notices.coalesce(1).write.mode("append").parquet(f"{tmp_path}/n")
    stream = spark.readStream.schema(notices.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/n")
    got = run(S.new_summaries(stream, delay_sec=10**7), tmp_path, "dedupe")
    assert got.count() == notices.count()


def test_feed_messages_stream(spark, land):
    tmp, raw = land
    logs, alerts = (stream_batches(spark, f"{tmp}/out/{n}", s) for n, s in (("logs", schemas.LOG), ("alerts", schemas.ALERT)))
    empty = spark.readStream.schema(schemas.SUMMARY).parquet(f"{tmp}/out/logs")
    feed = run(jobs.feed_messages(logs, alerts, empty.where("is_anomaly")), tmp, "feed")
    counts = {r["type"]: r["count"] for r in feed.groupBy("type").count().collect()}
    assert counts["log"] == raw.count() and counts["alert"] > 0


def test_a_batch_run_again_under_a_live_reader_is_seen_once(spark, tmp_path):
    """A reader follows the table while batches are retried; a crash before the rename leaves nothing to see."""
    def batch(n):
        return spark.range(n * 10, n * 10 + 10).repartition(2)

    schema = batch(0).schema
    assert write_batch(batch(0), f"{tmp_path}/t", 0)
    stream = stream_batches(spark, f"{tmp_path}/t", schema)
    query = stream.writeStream.format("memory").queryName("followed").start()
    try:
        query.processAllAvailable()
        assert not write_batch(batch(0), f"{tmp_path}/t", 0)
        batch(1).write.parquet(f"{tmp_path}/t/_aside/1-lost")
        query.processAllAvailable()
        assert write_batch(batch(1), f"{tmp_path}/t", 1)
        assert not write_batch(batch(1), f"{tmp_path}/t", 1)
        query.processAllAvailable()
        got = sorted(r["id"] for r in spark.table("followed").collect())
    finally:
        query.stop()
    assert got == list(range(20)) == sorted(r["id"] for r in read_batches(spark, f"{tmp_path}/t", schema).collect())


def _incidents(spark, rows):
    full = [{**{f.name: None for f in schemas.INCIDENT.fields}, "id": i, "title": t} for i, t in rows]
    return spark.createDataFrame(full, schemas.INCIDENT)


def _opened(df):
    """Data files that a lookup reads."""
    return df.inputFiles()


def test_point_lookup_opens_one_bucket_and_levels_stay_few(spark, tmp_path):
    path, want = f"{tmp_path}/incidents", {}
    for b in range(9):
        rows = [(f"i{(b * 7 + j) % 40}", f"b{b}") for j in range(12)]
        want.update(dict(rows))
        write_incidents(_incidents(spark, rows), path, b, buckets=4)
        assert not write_incidents(_incidents(spark, [("i0", "again")]), path, b, buckets=4)
    def check():
        assert {r["id"]: r["title"] for r in read_incidents(spark, path).collect()} == want
        for i in ("i0", "i7", "i39"):
            found = incident_by_id(spark, path, i, buckets=4)
            assert [r["title"] for r in found.collect()] == [want[i]]
            assert len({f.split("/bucket=")[1][0] for f in _opened(found)}) == 1
        return len(_opened(incident_by_id(spark, path, "i0", buckets=4)))

    before = check()
    assert compact_incidents(spark, path, fan=3) == 1
    assert check() < before and compact_incidents(spark, path, fan=3) == 0
    # Older than what was merged, and newer.
    write_incidents(_incidents(spark, [("i1", "late")]), path, 9, buckets=4)
    want["i1"] = "late"
    check()
    assert incident_by_id(spark, path, "nobody", buckets=4).count() == 0


def test_tails_of_other_days_are_not_opened(spark, tmp_path):
    """The files opened for a span of days do not grow with the history."""
    schema = _day_rows(spark, 0).schema
    opened = []
    for n in range(4):
        write_days(_day_rows(spark, n), f"{tmp_path}/tails", n, "pane_start")
        found = read_days(spark, f"{tmp_path}/tails", schema, date(2024, 1, 1), date(2024, 1, 2))
        opened.append(len(found.inputFiles()))
        assert {str(r["pane_start"].date()) for r in found.collect()} <= {"2024-01-01", "2024-01-02"}
    assert opened == [1, 2, 2, 2]
    assert read_days(spark, f"{tmp_path}/tails", schema, date(2020, 1, 1), date(2020, 1, 2)).count() == 0


def _day_rows(spark, n):
    return spark.range(5).select(F.expr(f"timestamp'2024-01-01 10:00:00' + INTERVAL {n} DAYS").alias("pane_start"), "id").coalesce(1)
