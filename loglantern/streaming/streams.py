"""The jobs as Structured Streaming queries.

Two kinds of query make up a deployment:

* ``start_ingest`` parses each micro-batch once and writes logs, alerts, panes
  and pane tails. A micro-batch is an ordinary DataFrame there, so rows are cut
  down per key before the shuffle, which a streaming aggregation cannot do.
* ``metric_stream`` and ``service_count_stream`` read the pane table as a
  stream and close windows behind a watermark. Their state holds panes, never
  logs.

Everything written is keyed by micro-batch or by window, so a restart after a
failure repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loglantern import fixed_values as V
from loglantern.operators.metrics import WINDOW_KEY, merge_panes
from loglantern.operators.panes import assign_windows, metric_panes, pane_tails
from loglantern.operators.review import Reviewer, call_reviewer, review_windows, to_alerts
from loglantern.operators.summaries import finish_summaries, window_counts, window_samples, with_payload
from loglantern.operators.throttle import notification_key
from loglantern.plans.jobs import reviewed_logs
from loglantern.schemas import LOG, PANE, TAIL
from loglantern.sources.tables import BATCH, read_days, write_batch, write_days

def start(writer: DataStreamWriter, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Start with a fixed processing rate, or drain what is there when ``trigger`` is None."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def start_ingest(
    raw: DataFrame,
    out: str,
    checkpoint: str,
    *,
    pane_sec: int = V.METRIC_SLIDE_SEC,
    ingest_ts: Column | None = None,
    reviewer: Reviewer | None = None,
    trigger: str | None = None,
) -> StreamingQuery:
    """One parse feeds four tables under ``out``: logs, alerts, tails, panes (in this order)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        reviewed = reviewed_logs(batch, ingest_ts=ingest_ts, reviewer=reviewer).persist()
        try:
            logs = reviewed.select(*LOG.fieldNames())
            write_batch(logs, f"{out}/logs", batch_id)
            write_batch(to_alerts(reviewed), f"{out}/alerts", batch_id)
            # Tails first: whoever sees a pane finds its sample logs.
            write_days(pane_tails(logs, pane_sec), f"{out}/tails", batch_id, "pane_start")
            write_batch(metric_panes(logs, pane_sec).select(*PANE.fieldNames()), f"{out}/panes", batch_id)
        finally:
            reviewed.unpersist()

    return start(raw.writeStream.foreachBatch(write), checkpoint, trigger)


def _closing(panes: DataFrame, windows: Sequence[tuple[int, int]], delay_sec: int) -> DataFrame:
    """Panes assigned to windows, watermarked by window end and free of repeats.

    The newest window end runs ahead of the newest pane by up to one window, so
    the watermark is held back by as much: a window closes once panes are
    ``delay_sec`` past its end.
    """
    longest = max(size for size, _ in windows)
    return (
        assign_windows(panes.withColumn("_pane", F.col("pane_start")), windows)
        .withWatermark("window_end", f"{delay_sec + longest} seconds")
        .dropDuplicatesWithinWatermark([BATCH, "_pane", "window_end", "window_sec", "service"])
    )


def metric_stream(
    panes: DataFrame,
    short_sec: int = V.SHORT_WINDOW_SEC,
    long_sec: int = V.LONG_WINDOW_SEC,
    slide_sec: int = V.METRIC_SLIDE_SEC,
    delay_sec: int = 10,
) -> DataFrame:
    """Closed metric windows of both sizes (append mode)."""
    return merge_panes(_closing(panes, [(short_sec, slide_sec), (long_sec, slide_sec)], delay_sec))


def service_count_stream(
    panes: DataFrame,
    window_sec: int = V.ANALYSIS_WINDOW_SEC,
    slide_sec: int = V.ANALYSIS_SLIDE_SEC,
    delay_sec: int = 10,
) -> DataFrame:
    """Closed (window, service) counts; all services of a window close together."""
    return (
        _closing(panes, [(window_sec, slide_sec)], delay_sec)
        .groupBy(*WINDOW_KEY)
        .agg(
            F.sum("total").alias("total"),
            F.sum("errors").alias("errors"),
            F.sum("warns").alias("warns"),
            F.min("first_ord").alias("first_ord"),
        )
    )


def start_summaries(
    counts: DataFrame,
    tails_path: str,
    out: str,
    checkpoint: str,
    *,
    window_sec: int = V.ANALYSIS_WINDOW_SEC,
    slide_sec: int = V.ANALYSIS_SLIDE_SEC,
    reviewer: Reviewer | None = None,
    then: Callable[[DataFrame, int], None] | None = None,
    trigger: str | None = None,
    tail_schema: T.StructType = TAIL,
) -> StreamingQuery:
    """Summaries of the windows closed by each micro-batch, written to ``out``.

    Top services and samples need a ranking, which a stream refuses; the closed
    windows of a micro-batch are few and complete. ``then`` runs on the written
    summaries, for instance to build incidents; give those the alert batches
    that can still be among the newest, since every batch it names is scanned.
    Tails of Kafka rows have the ``tail_schema`` ``schemas.arrived(schemas.TAIL)``.
    """
    spark = counts.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        closed = batch.persist()
        try:
            # The span of the closed windows: only the tails of these days are opened.
            low, high = closed.agg(F.min("window_start"), F.max("window_end")).first()
            if low is None:
                return
            days = closed.agg(F.to_date(F.min("window_start")), F.to_date(F.max("window_end"))).first()
            tails = read_days(spark, tails_path, tail_schema, *days).where(F.col("pane_start").between(low, high))
            windows = window_counts(closed).join(
                window_samples(tails, window_sec, slide_sec), ["window_start", "window_end", "window_sec"], "left"
            )
            windows = with_payload(windows)
            if reviewer is not None:
                windows = call_reviewer(windows, "payload", reviewer)
            write_batch(finish_summaries(review_windows(windows)), out, batch_id)
        finally:
            closed.unpersist()
        if then is not None:
            then(spark.read.parquet(f"{out}/{BATCH}={batch_id}"), batch_id)

    return start(counts.writeStream.foreachBatch(write), checkpoint, trigger)


def near_alert_stream(logs: DataFrame, alerts: DataFrame, gap_sec: int = 60, delay_sec: int = 10) -> DataFrame:
    """Streaming form of the interval semi join; both sides forget rows behind the watermark.

    The service alone would be a hot state key. Alerts are entered under the
    buckets they can reach, so a log looks at the alerts around its own time.
    """
    gap_ms = gap_sec * 1000

    def bucket(ts: str) -> Column:
        return F.floor(F.unix_millis(ts) / gap_ms).cast("bigint")

    left = logs.withWatermark("event_ts", f"{delay_sec} seconds").withColumn("_bucket", bucket("event_ts"))
    right = (
        alerts.select(F.col("service").alias("_service"), F.col("event_ts").alias("_at"))
        .withWatermark("_at", f"{delay_sec} seconds")
        .withColumn("_reach", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: bucket("_at") + d)))
    )
    gap = F.expr(f"INTERVAL {gap_sec} SECONDS")
    close = (
        (F.col("service") == F.col("_service"))
        & (F.col("_bucket") == F.col("_reach"))
        & (F.col("_at") > F.col("event_ts") - gap)
        & (F.col("_at") < F.col("event_ts") + gap)
    )
    return left.join(right, close, "left_semi").drop("_bucket")


def new_summaries(summaries: DataFrame, delay_sec: int = 60) -> DataFrame:
    """First summary per dedupe key; keys are forgotten behind the watermark."""
    return (
        summaries.where("is_anomaly")
        .withWatermark("window_end", f"{delay_sec} seconds")
        .dropDuplicatesWithinWatermark(["window_end", "category", "severity", "summary"])
    )


class _Throttle(StatefulProcessor):
    """Remembers the last notification of one scope."""

    def __init__(self, gap_ms: int, columns: list[str], kept: list[str]):
        self.gap_ms = gap_ms
        self.columns = columns
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("at_ms", T.LongType()), T.StructField("key", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Computed columns reach the processor without their names.
        frames = [f.set_axis(self.columns, axis=1) for f in rows if len(f)]
        if not frames:
            return
        batch = pd.concat(frames).sort_values(["_ms", "_tie"], kind="stable")
        known = self.last.get() if self.last.exists() else None
        at, last_key = known if known is not None else (None, None)
        sent = []
        for ms, k in zip(batch["_ms"], batch["_key"]):
            send = at is None or ms - at >= self.gap_ms or k != last_key
            sent.append(send)
            if send:
                at, last_key = int(ms), k
        self.last.update((at, last_key))
        yield batch[sent][self.kept]

    def close(self) -> None:
        pass


def throttle_stream(
    summaries: DataFrame, scope: str, *, gap_ms: int = 1000, at: str = "window_end", tie: str = "window_start"
) -> DataFrame:
    """Notified summaries of a stream, one last notification per ``scope`` value.

    Rows are ordered inside a micro-batch; across micro-batches they have to
    arrive in time order.
    """
    spark: SparkSession = summaries.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = summaries.where("is_anomaly").withColumns(
        {
            "_ms": F.unix_millis(F.col(at)),
            "_tie": F.col(tie),
            "_key": notification_key(F.col("category"), F.col("severity")),
        }
    )
    return rows.groupBy(scope).transformWithStateInPandas(
        statefulProcessor=_Throttle(gap_ms, rows.columns, summaries.columns),
        outputStructType=summaries.schema,
        outputMode="Append",
        timeMode="None",
    )
