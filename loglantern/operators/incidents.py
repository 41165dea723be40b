"""Incident reports: assembly, deduplication, prior incidents, table merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loglantern import fixed_values as V
from loglantern import schemas
from loglantern.functions.embedding import embed
from loglantern.functions.json_text import text_list
from loglantern.functions.log_fields import iso_text
from loglantern.functions.text import if_blank, merge_distinct, texts
from loglantern.functions.vectors import incident_text, similarity_text, vector_text
from loglantern.operators.asof import as_of_last
from loglantern.operators.panes import latest_per_key
from loglantern.operators.ranking import ALERT_ORDER
from loglantern.operators.review import draft_incidents
from loglantern.operators.similarity import nearest
from loglantern.session import cut_lineage

# What makes two summaries the same incident.
DEDUPE_KEY = ("window_end", "category", "severity", "summary")
ALERT_FIELDS = ("ts", "service", "category", "score", "level", "message", "explanation", "status")


def incident_id(at: Column, category: Column, severity: Column, summary: Column) -> Column:
    """Stable id of a report: a retried batch writes the same rows again.

    The parts are hashed as a JSON list, so no text can run into its neighbour.
    """
    return F.sha2(F.to_json(F.array(iso_text(at), category, severity, summary)), 256)


def summary_struct() -> Column:
    """A summary as it appears inside payloads."""
    return F.struct(
        iso_text(F.col("window_end")).alias("ts"),
        F.col("window_sec").alias("windowSec"),
        F.col("total_logs").alias("totalLogs"),
        F.col("error_count").alias("errorCount"),
        F.col("warn_count").alias("warnCount"),
        F.col("services_top").alias("servicesTop"),
        F.col("is_anomaly").alias("isAnomaly"),
        "severity",
        "category",
        "summary",
        F.col("top_signals").alias("topSignals"),
        F.col("recommended_actions").alias("recommendedActions"),
    )


def new_anomalies(summaries: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Anomalous summaries that have no report yet, one per dedupe key."""
    anomalies = summaries.where("is_anomaly")
    order = [F.col("window_sec").asc(), F.col("window_start").asc(), F.col("total_logs").desc()]
    distinct = latest_per_key(anomalies, DEDUPE_KEY, order, 1).drop("_rank")
    if store is None:
        return distinct
    known = store.select(
        F.col("event_ts").alias("window_end"), "category", "severity", "summary"
    )
    return distinct.join(known, list(DEDUPE_KEY), "left_anti")


def incident_contexts(
    anomalies: DataFrame, alerts: DataFrame, newest: int = V.REPORT_ALERTS, told: int = V.CONTEXT_ALERTS
) -> DataFrame:
    """Add the ``newest`` alerts at the window end and ``context``, the JSON a drafter reads with ``told`` of them."""
    seen = as_of_last(alerts, cut_lineage(anomalies), newest, ALERT_FIELDS, "alerts", at="window_end", order=ALERT_ORDER)
    context = F.to_json(
        F.struct(summary_struct().alias("summary"), F.slice("alerts", 1, told).alias("alerts")),
        {"ignoreNullFields": "false"},
    )
    return seen.withColumn("context", context)


def assemble_reports(
    drafted: DataFrame, evidence: int | None = None, actions: int | None = None, alerts: int = V.EVIDENCE_ALERTS
) -> DataFrame:
    """Report rows from contexts with a ``draft``; still without similar incidents.

    ``evidence`` and ``actions`` cut those lists; by default they are whole.
    The newest ``alerts`` count as evidence.
    """
    alert_lines = F.transform(
        F.slice("alerts", 1, alerts), lambda a: F.concat(a["service"], F.lit(": "), a["message"])
    )
    default_timeline = F.array(
        F.lit(V.DEFAULT_TIMELINE_FIRST),
        F.concat(F.lit("Category="), F.col("category"), F.lit(", severity="), F.col("severity")),
    )
    return drafted.select(
        incident_id(*[F.col(c) for c in DEDUPE_KEY]).alias("id"),
        F.col("window_end").alias("event_ts"),
        iso_text(F.col("window_end")).alias("ts"),
        if_blank(
            F.col("draft.title"), F.concat(F.replace("category", F.lit("_"), F.lit(" ")), F.lit(" incident"))
        ).alias("title"),
        "severity",
        "category",
        "summary",
        if_blank(
            F.col("draft.impact"),
            F.concat(F.lit("Incident affects "), F.array_join("services_top", ", "), F.lit(".")),
        ).alias("impact"),
        F.when(F.size("draft.timeline") > 0, F.col("draft.timeline")).otherwise(default_timeline).alias("timeline"),
        merge_distinct(evidence, F.col("top_signals"), F.col("draft.evidence"), alert_lines).alias("evidence"),
        merge_distinct(
            actions, F.col("recommended_actions"), F.col("draft.recommended_actions")
        ).alias("recommended_actions"),
        similarity_text(F.col("summary"), F.col("top_signals")).alias("_query"),
    )


def with_prior_incidents(reports: DataFrame, store: DataFrame | None = None, n: int = V.REPORT_SIMILAR) -> DataFrame:
    """Add the embedding and the ids of the ``n`` closest earlier incidents.

    Earlier means stored already or in this batch with an earlier time. The
    reports are checkpointed first: they feed the queries, the search side and
    the result.
    """
    ready = cut_lineage(reports.withColumn("embedding", embed(incident_text())).withColumn("_vec", embed(F.col("_query"))))
    searched = ready.select("id", F.col("embedding").alias("vec"), F.col("event_ts").alias("at"))
    if store is not None:
        searched = searched.unionByName(
            store.select("id", F.col("embedding").alias("vec"), F.col("event_ts").alias("at"))
        )
    queries = ready.select(F.col("id").alias("query_id"), F.col("_vec").alias("vec"), F.col("event_ts").alias("at"))
    hits = nearest(queries, searched, n, earlier_only=True)
    ids = (
        hits.groupBy(F.col("query_id").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("position", F.col("id").alias("hit")))).alias("_h"))
        .select("id", F.transform("_h", lambda h: h["hit"]).alias("similar_incident_ids"))
    )
    return (
        ready.join(ids, "id", "left")
        .withColumn("similar_incident_ids", F.coalesce("similar_incident_ids", texts(())))
        .select(*schemas.INCIDENT.fieldNames())
    )


def merge_incidents(store: DataFrame, batch: DataFrame, version: str = "version") -> DataFrame:
    """Insert-or-replace by id: the row with the highest version wins, the batch on a tie."""
    both = store.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest_per_key(both, ["id"], [F.col(version).desc(), F.col("_new").desc()], 1).drop("_new", "_rank")


def newest_saved(saves: DataFrame, n: int | None = None, version: str = "version") -> DataFrame:
    """Last save per id, newest first; the ``n`` newest where a number is given."""
    last = latest_per_key(saves, ["id"], [F.col(version).desc()], 1).drop("_rank")
    last = last.orderBy(F.col(version).desc(), F.col("id").desc())
    return last if n is None else last.limit(n)


LIST_COLUMNS = ("timeline", "evidence", "recommended_actions", "similar_incident_ids")
_JSON_NAMES = {
    "timeline": "timeline_json",
    "evidence": "evidence_json",
    "recommended_actions": "actions_json",
    "similar_incident_ids": "similar_ids_json",
}


def to_table_rows(incidents: DataFrame) -> DataFrame:
    """Relational form: lists as JSON text, the vector as text."""
    scalars = ["id", "ts", "title", "severity", "category", "summary", "impact"]
    return incidents.select(
        *scalars,
        *[F.to_json(F.coalesce(c, texts(()))).alias(_JSON_NAMES[c]) for c in LIST_COLUMNS],
        vector_text(F.col("embedding")).alias("embedding"),
    )


def from_table_rows(rows: DataFrame, columns: Sequence[str] = LIST_COLUMNS) -> DataFrame:
    """Reports from the relational form; unreadable JSON is an empty list."""
    scalars = ["id", "ts", "title", "severity", "category", "summary", "impact"]
    return rows.select(*scalars, *[text_list(F.col(_JSON_NAMES[c])).alias(c) for c in columns])


def drafted(contexts: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Add the draft from a table of replies (window_start, reply[, reply_failed])."""
    if replies is not None:
        contexts = contexts.join(replies, "window_start", "left")
        if "reply_failed" in replies.columns:
            contexts = contexts.withColumn("reply_failed", F.coalesce("reply_failed", F.lit(False)))
    return draft_incidents(contexts)
