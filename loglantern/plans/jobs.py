"""The jobs a user calls, each a composition of operators.

All take and return DataFrames and stay lazy, except ``build_incidents`` and
``root_cause``, which checkpoint what they read several times (see
:mod:`loglantern.session`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loglantern import fixed_values as V
from loglantern.functions.log_fields import IS_JSON_COLUMN, JSON_COLUMN, with_json, with_log_fields
from loglantern.operators import incidents as _incidents
from loglantern.operators import rootcause as _rootcause
from loglantern.operators.dashboard import dashboard_kpis, question_contexts, search_logs
from loglantern.operators.feed import feed_messages, feed_snapshot
from loglantern.operators.metrics import service_window_metrics
from loglantern.operators.ranking import latest
from loglantern.operators.related import counted_lookup
from loglantern.operators.review import Reviewer, answer_questions, call_reviewer, review_logs, structured_answers, to_alerts
from loglantern.operators.similarity import similar_incidents, similar_to_text
from loglantern.operators.summaries import window_summaries
from loglantern.operators.throttle import throttle_notifications
from loglantern.session import written

__all__ = [
    "answered_questions",
    "ask_context",
    "build_incidents",
    "dashboard_kpis",
    "detect_alerts",
    "feed_messages",
    "feed_snapshot",
    "latest",
    "parse_logs",
    "root_cause",
    "search_logs",
    "service_window_metrics",
    "similar_incidents",
    "similar_to_text",
    "throttle_notifications",
    "window_summaries",
]


def parse_logs(raw: DataFrame, raw_column: str = "raw", ingest_ts: Column | None = None) -> DataFrame:
    """Typed logs from raw lines; see :mod:`loglantern.functions.log_fields`."""
    return with_log_fields(with_json(raw, raw_column), raw_column, ingest_ts).drop(JSON_COLUMN, IS_JSON_COLUMN)


def reviewed_logs(
    raw: DataFrame,
    raw_column: str = "raw",
    ingest_ts: Column | None = None,
    reviewer: Reviewer | None = None,
    use_parsed: bool = False,
) -> DataFrame:
    """Typed logs with their review; one JSON parse serves both."""
    if reviewer is not None:
        raw = call_reviewer(raw, raw_column, reviewer)
    parsed = with_log_fields(with_json(raw, raw_column), raw_column, ingest_ts)
    return review_logs(parsed, raw_column, use_parsed).drop(JSON_COLUMN, IS_JSON_COLUMN)


def detect_alerts(
    raw: DataFrame,
    raw_column: str = "raw",
    ingest_ts: Column | None = None,
    reviewer: Reviewer | None = None,
    use_parsed: bool = False,
    threshold: float = V.ALERT_THRESHOLD,
) -> DataFrame:
    """Alerts from raw lines: one narrow stage, no shuffle."""
    return to_alerts(reviewed_logs(raw, raw_column, ingest_ts, reviewer, use_parsed), threshold)


def build_incidents(
    summaries: DataFrame,
    alerts: DataFrame,
    drafts: DataFrame | None = None,
    store: DataFrame | None = None,
    drafter: Reviewer | None = None,
) -> DataFrame:
    """Reports for the anomalous summaries that have none in ``store`` yet.

    Drafts come from a table (window_start, reply) or from a callable over the
    context JSON.
    """
    contexts = _incidents.incident_contexts(_incidents.new_anomalies(summaries, store), alerts)
    if drafter is not None:
        contexts = call_reviewer(contexts, "context", drafter)
    return _incidents.with_prior_incidents(
        _incidents.assemble_reports(_incidents.drafted(contexts, drafts)), store
    )


def root_cause(
    summaries: DataFrame,
    alerts: DataFrame,
    spans: DataFrame,
    metrics: DataFrame,
    reports: DataFrame,
    requests: DataFrame | None = None,
    seen: _rootcause.Seen = _rootcause.Seen(),
) -> _rootcause.Graphs:
    """Header, node and edge tables of the root-cause graphs, at the times of ``requests`` (incident_id, tick)."""
    inputs = _rootcause.graph_inputs(summaries, alerts, spans, metrics, reports, requests, seen)
    return _rootcause.root_cause_graphs(inputs, seen)


def ask_context(questions: DataFrame, logs: DataFrame, alerts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Questions with the prompt an answerer reads."""
    return question_contexts(questions, logs, alerts, summaries)


def answered_questions(
    questions: DataFrame,
    logs: DataFrame,
    alerts: DataFrame,
    summaries: DataFrame,
    reviewer: Reviewer | None = None,
    structured: bool = False,
) -> DataFrame:
    """Questions with their ``prompt``, the ``reply``, whether the call failed, and the ``answer`` (``agent`` if structured).

    ``questions`` are those of :func:`ask_context`; blank ones have no row. Equal
    prompts are one request, whose reply is written once and then shared: no
    retry of a task asks again for what has been answered. Failed calls stay
    apart as ``reply_failed``, to be asked again alone.
    """
    asked = written(ask_context(questions, logs, alerts, summaries).withColumn("_request", F.sha2("prompt", 256)))
    requests = asked.groupBy("_request").agg(F.first("prompt").alias("prompt"), F.count("*").alias("_asked"))
    if reviewer is None:
        replies = requests.withColumns({"reply": F.lit(None).cast("string"), "reply_failed": F.lit(False)})
    else:
        replies = call_reviewer(requests.repartition("_request"), "prompt", reviewer)
    replies = written(replies.drop("prompt"))
    found = counted_lookup(asked, replies, ["_request"], "_asked").drop("_request")
    return structured_answers(found) if structured else answer_questions(found)
