"""Panes: logs pre-aggregated once into short tumbling slices.

Every window in the library is a whole number of panes, so the log table is
read and shuffled once whatever the number of window sizes and overlaps. A
pane row is small and mergeable; its lists are bounded (the last few addresses).

Windows are aligned to the epoch and half-open, ``[start, end)``. Rows without
a readable time belong to no window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglantern import fixed_values as V
from loglantern.functions.log_fields import is_level
from loglantern.operators.pane_parts import LOG_FIELDS, pane_parts
from loglantern.session import written

PANE_KEY = ("pane_start", "service")


def pane_start(event_ts: Column, step_sec: int) -> Column:
    return F.window(event_ts, f"{step_sec} seconds")["start"]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in the given order.

    Filtering the row number makes Spark limit each group before the shuffle
    too, so at most ``n`` rows per key leave a map task, however hot the key.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n)


def metric_panes(logs: DataFrame, step_sec: int, keep_ips: int = V.LAST_IPS) -> DataFrame:
    """One mergeable row per pane and service with everything a metric needs, from one read of the logs.

    What is merged here are the parts that tasks have folded, a few per pane.
    """
    parts = pane_parts(logs, pane_start(F.col("event_ts"), step_sec), keep_ips)
    merged = parts.groupBy(*PANE_KEY).agg(
        *[F.sum(c).alias(c) for c in ("total", "errors", "warns", "latency_sum", "latency_count")],
        F.max("latency_max").cast("int").alias("latency_max"),
        F.max("last").alias("last"),
        F.max("last_endpoint").alias("last_endpoint"),
        F.flatten(F.collect_list("ips")).alias("ips"),
        F.min("first_ord").alias("first_ord"),
    )
    return merged.withColumn("ips", F.slice(F.sort_array("ips", asc=False), 1, keep_ips))


def counts_and_tails(logs: DataFrame, step_sec: int, keep: int = V.SAMPLE_LOGS) -> tuple[DataFrame, DataFrame]:
    """:func:`count_panes` and :func:`pane_tails` from one read of the logs; their parts are written first."""
    parts = written(pane_parts(logs, pane_start(F.col("event_ts"), step_sec), 0, keep))
    counts = (
        parts.where(F.col("total").isNotNull())
        .groupBy(*PANE_KEY)
        .agg(*[F.sum(c).alias(c) for c in ("total", "errors", "warns")], F.min("first_ord").alias("first_ord"))
    )
    rows = parts.where(F.col("tail").isNotNull()).select("pane_start", F.inline("tail"))
    return counts, latest_per_key(rows, ["pane_start"], [F.col("ord").desc()], keep).drop("_rank")


def count_panes(logs: DataFrame, step_sec: int) -> DataFrame:
    """Counts and first arrival per pane and service (fixed-width, hash-aggregated)."""
    return (
        logs.where(F.col("event_ts").isNotNull())
        .groupBy(pane_start(F.col("event_ts"), step_sec).alias("pane_start"), "service")
        .agg(
            F.count("*").alias("total"),
            F.count_if(is_level(F.col("level"), "ERROR")).alias("errors"),
            F.count_if(is_level(F.col("level"), "WARN")).alias("warns"),
            F.min("ord").alias("first_ord"),
        )
    )


def pane_tails(logs: DataFrame, step_sec: int, keep: int = V.SAMPLE_LOGS) -> DataFrame:
    """The last ``keep`` logs per pane in arrival order."""
    rows = logs.where(F.col("event_ts").isNotNull()).select(
        pane_start(F.col("event_ts"), step_sec).alias("pane_start"), "ord", *LOG_FIELDS
    )
    return latest_per_key(rows, ["pane_start"], [F.col("ord").desc()], keep).drop("_rank")


def window_starts(pane: Column, window_sec: int, slide_sec: int) -> Column:
    """Starts (epoch seconds) of the windows that contain a pane."""
    at = F.unix_seconds(pane)
    newest = F.floor(at / slide_sec).cast("bigint") * slide_sec
    return F.filter(
        F.sequence(newest, newest - F.lit(window_sec), F.lit(-slide_sec).cast("bigint")),
        lambda s: s + window_sec > at,
    )


def assign_windows(panes: DataFrame, windows: Sequence[tuple[int, int]]) -> DataFrame:
    """One row per pane and containing window, for ``(window_sec, slide_sec)`` pairs.

    All sizes are produced together, so one aggregation serves their union.
    """

    def choices(size: int, slide: int) -> Column:
        return F.transform(
            window_starts(F.col("pane_start"), size, slide),
            lambda s: F.struct(
                F.timestamp_seconds(s).alias("start"), F.timestamp_seconds(s + size).alias("end"), F.lit(size).alias("sec")
            ),
        )

    every = F.concat(*[choices(size, slide) for size, slide in dict.fromkeys(windows)])
    return (
        panes.withColumn("_w", F.explode(every))
        .withColumns(
            {"window_start": F.col("_w.start"), "window_end": F.col("_w.end"), "window_sec": F.col("_w.sec")}
        )
        .drop("_w", "pane_start")
    )


def pane_step(*seconds: int) -> int:
    """Longest pane that divides every given window and slide."""
    return math.gcd(*seconds)
