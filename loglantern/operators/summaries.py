"""Window summaries: counts, top services, sample logs and the review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglantern import fixed_values as V
from loglantern import schemas
from loglantern.functions.log_fields import iso_text
from loglantern.functions.text import first_of
from loglantern.operators.panes import assign_windows, count_panes, counts_and_tails, latest_per_key, pane_step
from loglantern.operators.review import review_windows

WINDOW = ("window_start", "window_end", "window_sec")


def service_counts(panes: DataFrame, window_sec: int, slide_sec: int) -> DataFrame:
    """Rows per service and window, with the arrival that breaks ties."""
    return (
        assign_windows(panes, [(window_sec, slide_sec)])
        .groupBy(*WINDOW, "service")
        .agg(
            F.sum("total").alias("total"),
            F.sum("errors").alias("errors"),
            F.sum("warns").alias("warns"),
            F.min("first_ord").alias("first_ord"),
        )
    )


def window_counts(counts: DataFrame, top: int = V.TOP_SERVICES) -> DataFrame:
    """Totals of each window and its top services as ``name(count)``.

    Works on one row per service, so a busy service weighs no more than a quiet
    one. Equal counts go to the service seen first.
    """
    rank = F.row_number().over(Window.partitionBy(*WINDOW).orderBy(F.col("total").desc(), "first_ord"))
    label = F.concat(F.col("service"), F.lit("("), F.col("total").cast("string"), F.lit(")"))
    return (
        counts.withColumn("_rank", rank)
        .groupBy(*WINDOW)
        .agg(
            F.sum("total").alias("total_logs"),
            F.sum("errors").alias("error_count"),
            F.sum("warns").alias("warn_count"),
            F.sort_array(
                F.collect_list(F.when(F.col("_rank") <= top, F.struct("_rank", label.alias("label"))))
            ).alias("_top"),
        )
        .withColumn("services_top", F.transform("_top", lambda x: x["label"]))
        .drop("_top")
    )


def log_struct() -> Column:
    """A log as it appears inside payloads."""
    return F.struct("ts", "service", "level", "message", F.col("latency_ms").alias("latencyMs"), "stacktrace")


def window_samples(tails: DataFrame, window_sec: int, slide_sec: int, keep: int = V.SAMPLE_LOGS) -> DataFrame:
    """The last ``keep`` logs of each window, oldest first."""
    rows = assign_windows(tails, [(window_sec, slide_sec)])
    return (
        latest_per_key(rows, WINDOW, [F.col("ord").desc()], keep)
        .groupBy(*WINDOW)
        .agg(F.sort_array(F.collect_list(F.struct("ord", log_struct().alias("log")))).alias("_s"))
        .select(*WINDOW, F.transform("_s", lambda x: x["log"]).alias("sample_logs"))
    )


def window_aggregates(
    logs: DataFrame, window_sec: int = V.ANALYSIS_WINDOW_SEC, slide_sec: int = V.ANALYSIS_SLIDE_SEC
) -> DataFrame:
    """Counts and top services per window."""
    step = pane_step(window_sec, slide_sec)
    return window_counts(service_counts(count_panes(logs, step), window_sec, slide_sec))


def window_payloads(
    logs: DataFrame, window_sec: int = V.ANALYSIS_WINDOW_SEC, slide_sec: int = V.ANALYSIS_SLIDE_SEC
) -> DataFrame:
    """Aggregates plus ``payload``, the JSON a window reviewer reads."""
    counts, tails = counts_and_tails(logs, pane_step(window_sec, slide_sec))
    windows = window_counts(service_counts(counts, window_sec, slide_sec))
    return with_payload(windows.join(window_samples(tails, window_sec, slide_sec), list(WINDOW)))


def with_payload(windows: DataFrame) -> DataFrame:
    payload = F.to_json(
        F.struct(
            iso_text(F.col("window_end")).alias("ts"),
            F.col("window_sec"),
            F.struct(
                F.col("total_logs").alias("total"),
                F.col("error_count").alias("error"),
                F.col("warn_count").alias("warn"),
            ).alias("counts"),
            F.col("services_top"),
            F.col("sample_logs"),
        ),
        {"ignoreNullFields": "false"},
    )
    return windows.withColumn("payload", payload)


def finish_summaries(reviewed: DataFrame, signals: int | None = None, actions: int | None = None) -> DataFrame:
    """Summary rows from aggregates with a ``review``; the lists are cut only where a limit is given."""
    columns = {
        "is_anomaly": F.col("review.is_anomaly"),
        "severity": F.col("review.severity"),
        "category": F.col("review.category"),
        "summary": F.col("review.summary"),
        "top_signals": first_of(F.col("review.top_signals"), signals),
        "recommended_actions": first_of(F.col("review.recommended_actions"), actions),
    }
    return reviewed.withColumns(columns).select(*schemas.SUMMARY.fieldNames())


def window_summaries(
    logs: DataFrame,
    replies: DataFrame | None = None,
    window_sec: int = V.ANALYSIS_WINDOW_SEC,
    slide_sec: int = V.ANALYSIS_SLIDE_SEC,
) -> DataFrame:
    """One summary per window. ``replies`` holds (window_start, reply[, reply_failed])."""
    windows = window_aggregates(logs, window_sec, slide_sec)
    if replies is not None:
        windows = windows.join(replies, "window_start", "left")
        if "reply_failed" in replies.columns:
            windows = windows.withColumn("reply_failed", F.coalesce("reply_failed", F.lit(False)))
    return finish_summaries(review_windows(windows))
