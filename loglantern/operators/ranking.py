"""Latest-N queries; a global order with a limit, never a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def latest(df: DataFrame, n: int, by: Sequence[str] = ("event_ts", "ord")) -> DataFrame:
    """The newest ``n`` rows, newest first (each task keeps its own top ``n``)."""
    return df.orderBy(*[F.col(c).desc() for c in by]).limit(n)


ALERT_ORDER = ("event_ts", "ord")
SPAN_ORDER = ("event_ts", "ord")
SUMMARY_ORDER = ("window_end", "window_sec")
# Arrival order of metric rows: tick, then short before long, then service.
METRIC_ORDER = ("window_end", "window_sec", "service")
INCIDENT_ORDER = ("event_ts", "id")
