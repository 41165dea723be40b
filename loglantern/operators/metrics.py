"""Per-service window metrics, merged from panes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loglantern import fixed_values as V
from loglantern import schemas
from loglantern.operators.panes import assign_windows, metric_panes, pane_step

WINDOW_KEY = ("window_start", "window_end", "window_sec", "service")


def newest_ips(lists: Column, keep: int = V.LAST_IPS) -> Column:
    """Last ``keep`` occurrences over several pane lists, oldest first, then distinct."""
    newest = F.slice(F.sort_array(F.flatten(lists), asc=False), 1, keep)
    return F.array_distinct(F.transform(F.reverse(newest), lambda x: x["ip"]))


def merge_panes(assigned: DataFrame) -> DataFrame:
    """Metrics of each window from its panes. Lists hold a few entries per pane, so they stay bounded."""
    merged = assigned.groupBy(*WINDOW_KEY).agg(
        F.sum("total").alias("total_count"),
        F.sum("errors").alias("error_count"),
        F.sum("warns").alias("warn_count"),
        F.sum("latency_sum").alias("_sum"),
        F.sum("latency_count").alias("_n"),
        F.max("latency_max").alias("_max"),
        F.max("last").alias("_last"),
        F.max("last_endpoint").alias("_endpoint"),
        F.collect_list("ips").alias("_ips"),
    )
    return finish_metrics(merged)


def finish_metrics(merged: DataFrame) -> DataFrame:
    columns = {
        "ts": F.col("_last.ts"),
        # No latency at all reads as 0.0, and the maximum never falls below 0.
        "avg_latency_ms": F.coalesce(F.try_divide(F.col("_sum").cast("double"), F.col("_n")), F.lit(0.0)),
        "max_latency_ms": F.greatest(F.coalesce(F.col("_max"), F.lit(0)), F.lit(0)),
        "endpoint_hint": F.col("_endpoint.endpoint"),
        "failed_ips": newest_ips(F.col("_ips")),
    }
    return merged.withColumns(columns).select(*schemas.METRIC.fieldNames())


def service_window_metrics(
    logs: DataFrame,
    short_sec: int = V.SHORT_WINDOW_SEC,
    long_sec: int = V.LONG_WINDOW_SEC,
    slide_sec: int = V.METRIC_SLIDE_SEC,
) -> DataFrame:
    """Metrics per service for the short and the long window, both moving by ``slide_sec``."""
    panes = metric_panes(logs, pane_step(short_sec, long_sec, slide_sec))
    return merge_panes(assign_windows(panes, [(short_sec, slide_sec), (long_sec, slide_sec)]))


def in_publish_order(metrics: DataFrame) -> DataFrame:
    """Presentation order of one tick: short windows first, by service inside a size."""
    return metrics.orderBy("window_end", "window_sec", "service")


def error_ratio(errors: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(errors.cast("double"), total), F.lit(0.0))


def to_metric_message(metrics: DataFrame) -> DataFrame:
    """Message form: key is the service, value the JSON, plus an idempotence key."""
    value = F.to_json(
        F.struct(
            "ts",
            F.col("window_sec").alias("windowSec"),
            "service",
            F.col("total_count").alias("totalCount"),
            F.col("error_count").alias("errorCount"),
            F.col("warn_count").alias("warnCount"),
            F.col("avg_latency_ms").alias("avgLatencyMs"),
            F.col("max_latency_ms").alias("maxLatencyMs"),
            F.col("endpoint_hint").alias("endpointHint"),
            F.col("failed_ips").alias("failedIpsTop"),
        ),
        {"ignoreNullFields": "false"},
    )
    return metrics.select(
        F.col("service").alias("key"), value.alias("value"), "window_start", "window_sec", "service"
    )


def from_metric_message(messages: DataFrame, value: str = "value") -> DataFrame:
    """Typed metrics from message JSON; malformed rows are dropped."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.METRIC_MESSAGE.fields)
    numbers = {
        "windowSec": "window_sec",
        "totalCount": "total_count",
        "errorCount": "error_count",
        "warnCount": "warn_count",
        "avgLatencyMs": "avg_latency_ms",
        "maxLatencyMs": "max_latency_ms",
    }
    parsed = F.from_json(F.col(value), f"{fields}, _corrupt_record STRING")
    return (
        messages.withColumn("_m", parsed)
        .where(F.col("_m").isNotNull() & F.col("_m._corrupt_record").isNull())
        # A message without its texts is malformed; a missing number reads as 0.
        .where(F.col("_m.ts").isNotNull() & F.col("_m.service").isNotNull())
        .select(
            F.col("_m.ts").alias("ts"),
            F.col("_m.service").alias("service"),
            *[F.coalesce(F.col(f"_m.{field}"), F.lit(0)).alias(name) for field, name in numbers.items()],
            F.col("_m.endpointHint").alias("endpoint_hint"),
            F.coalesce(F.col("_m.failedIpsTop"), F.array().cast("array<string>")).alias("failed_ips"),
        )
    )
