"""Dashboard numbers, log search and question contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loglantern import fixed_values as V
from loglantern.functions.log_fields import iso_text
from loglantern.functions.text import blank, list_text, record_text, round_half_up
from loglantern.operators.ranking import ALERT_ORDER, SUMMARY_ORDER, latest
from loglantern.operators.related import near_alerts, newest_per_key

KPI_LOGS = 100


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("status") == V.NEW_STATUS)


def dashboard_kpis(logs: DataFrame, alerts: DataFrame, recent: int = KPI_LOGS) -> DataFrame:
    """One row: error rate, p95 latency and throughput of the ``recent`` last logs, active alerts.

    A missing latency counts as 0 in the percentile; the level is matched
    exactly here, unlike in the window counts.
    """
    newest = latest(logs.select("event_ts", "ord", "level", "latency_ms"), recent)
    active = active_alerts(alerts).agg(F.count("*").alias("n")).scalar()
    n = F.count("*")
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY coalesce(latency_ms, 0))")
    return newest.agg(
        F.coalesce(round_half_up(F.try_divide(F.count_if(F.col("level") == "ERROR") * F.lit(100.0), n)), F.lit(0)).alias(
            "error_rate"
        ),
        F.coalesce(p95.cast("bigint"), F.lit(0)).alias("p95_latency_ms"),
        F.greatest(round_half_up(n / F.lit(20.0)), F.lit(0)).alias("throughput"),
    ).withColumn("active_alerts", active)


def distinct_services(logs: DataFrame) -> DataFrame:
    return logs.select("service").distinct().orderBy("service")


def search_logs(
    logs: DataFrame,
    alerts: DataFrame | None = None,
    *,
    query: str = "",
    service: str = "all",
    level: str = "all",
    anomaly_only: bool = False,
    recent: int | None = None,
    n: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Filter the logs, newest first; ``recent`` limits the search to so many of the newest.

    ``n`` keeps the newest rows found: each task then keeps its own, instead of
    all being sorted. ``ordered=False`` leaves what is found as it comes.

    The level is matched case-sensitively, the text ignoring case.
    """
    found = logs if recent is None else latest(logs, recent)
    if service != "all":
        found = found.where(F.col("service") == service)
    if level != "all":
        found = found.where(F.col("level") == level)
    needle = query.strip().lower()
    if needle:
        text = F.concat_ws(" ", "ts", "service", "level", "message", F.coalesce("stacktrace", F.lit("")))
        found = found.where(F.lower(text).contains(needle))
    if anomaly_only:
        if alerts is None:
            raise ValueError("anomaly_only needs the alerts")
        found = near_alerts(found, alerts)
    if n is not None:
        return latest(found, n)
    return found.orderBy(F.col("event_ts").desc(), F.col("ord").desc()) if ordered else found


def log_text(log: Column) -> Column:
    fields = ("ts", "service", "level", "message", "latency_ms", "stacktrace")
    shown = ("ts", "service", "level", "message", "latencyMs", "stacktrace")
    return record_text("LogEvent", [(label, log[f]) for label, f in zip(shown, fields)])


def alert_text(alert: Column) -> Column:
    fields = ("ts", "service", "category", "score", "level", "message", "explanation", "status")
    return record_text("AlertEvent", [(f, alert[f]) for f in fields])


def summary_text(s: Column) -> Column:
    return record_text(
        "SummaryEvent",
        [
            ("ts", iso_text(s["window_end"])),
            ("windowSec", s["window_sec"]),
            ("totalLogs", s["total_logs"]),
            ("errorCount", s["error_count"]),
            ("warnCount", s["warn_count"]),
            ("servicesTop", list_text(s["services_top"])),
            ("isAnomaly", s["is_anomaly"]),
            ("severity", s["severity"]),
            ("category", s["category"]),
            ("summary", s["summary"]),
            ("topSignals", list_text(s["top_signals"])),
            ("recommendedActions", list_text(s["recommended_actions"])),
        ],
    )


def _newest_list(df: DataFrame, n: int, order: tuple[str, ...], newest_first: bool) -> Column:
    """The newest ``n`` rows of a table as one list value (a scalar subquery of at most ``n`` rows)."""
    rows = latest(df, n, order).agg(
        F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row"))), asc=not newest_first).alias("_l")
    )
    return rows.select(F.transform("_l", lambda x: x["row"])).scalar()


def question_contexts(
    questions: DataFrame,
    logs: DataFrame,
    alerts: DataFrame,
    summaries: DataFrame,
    newest_alerts: int = 5,
    newest_logs: int = 10,
    related_alerts: int = 3,
) -> DataFrame:
    """Add ``prompt`` to each non-blank question.

    ``questions`` holds (question, mode, log), ``log`` being the selected log
    struct or null. Mode ``overview`` looks at the newest rows overall
    (``newest_alerts``, ``newest_logs``), any other mode at the selected log and
    the ``related_alerts`` newest alerts of its service.
    """
    asked = questions.where(~blank(F.col("question")))
    asked = asked.withColumns(
        {
            "_last": _newest_list(summaries, 1, SUMMARY_ORDER, True),
            "_alerts": _newest_list(alerts, max(newest_alerts, related_alerts), ALERT_ORDER, True),
            "_logs": _newest_list(logs, newest_logs, ALERT_ORDER, False),
            "_service": F.col("log.service"),
        }
    )
    last = F.try_element_at("_last", F.lit(1))
    asked = asked.withColumn("_summary", F.when(last.isNull(), "null").otherwise(summary_text(last))).drop("_last")
    fields = [c for c in alerts.columns if c not in ("ord", "event_ts")]
    related = newest_per_key(alerts, ["service"], fields, related_alerts, "_related").withColumnRenamed("service", "_service")
    asked = asked.join(related, "_service", "left")

    def lines(labels: tuple[str, ...], values: list[Column]) -> Column:
        parts = [F.lit(t) for t in V.ASK_HEADER] + [F.concat(F.lit(a), b) for a, b in zip(labels, values)]
        return F.concat(*[x for p in parts for x in (p, F.lit("\n"))])

    none = F.lit("[]")
    overview = lines(
        V.ASK_OVERVIEW_LABELS,
        [
            F.col("question"),
            F.col("_summary"),
            F.coalesce(list_text(F.transform(F.slice("_alerts", 1, newest_alerts), alert_text)), none),
            F.coalesce(list_text(F.transform("_logs", log_text)), none),
        ],
    )
    # Without a selected log, the newest alerts stand in for the related ones.
    nearby = F.when(F.col("log").isNull(), list_text(F.transform(F.slice("_alerts", 1, related_alerts), alert_text))).otherwise(
        list_text(F.transform("_related", alert_text))
    )
    about_log = lines(
        V.ASK_LOG_LABELS,
        [
            F.col("question"),
            F.when(F.col("log").isNull(), "null").otherwise(log_text(F.col("log"))),
            F.col("_summary"),
            F.coalesce(nearby, none),
        ],
    )
    return asked.withColumn("prompt", F.when(F.col("mode") == "overview", overview).otherwise(about_log)).drop(
        "_summary", "_alerts", "_logs", "_service", "_related"
    )
