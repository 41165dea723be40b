"""Root-cause graphs: header, node and edge tables, one graph per requested time."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from loglantern import fixed_values as V
from loglantern.functions.binding import let
from loglantern.functions.log_fields import iso_text
from loglantern.functions.text import clamp
from loglantern.operators.asof import Source, as_of_merge
from loglantern.operators.metrics import error_ratio
from loglantern.operators.ranking import ALERT_ORDER, INCIDENT_ORDER, METRIC_ORDER, SPAN_ORDER, SUMMARY_ORDER
from loglantern.session import cut_lineage

_ROOT = "incident"


class Graphs(NamedTuple):
    headers: DataFrame
    nodes: DataFrame
    edges: DataFrame


class Seen(NamedTuple):
    """How many of the newest rows of each source a graph looks at, and how many nodes it shows of each kind."""

    alerts: int = V.GRAPH_ALERTS
    spans: int = V.GRAPH_SPANS
    metrics: int = V.GRAPH_METRICS
    reports: int = V.GRAPH_REPORTS
    shown: int = V.GRAPH_SHOWN
    signals: int = V.GRAPH_SIGNALS
    shown_reports: int = 1


def graph_inputs(
    summaries: DataFrame,
    alerts: DataFrame,
    spans: DataFrame,
    metrics: DataFrame,
    reports: DataFrame,
    requests: DataFrame | None = None,
    seen: Seen = Seen(),
) -> DataFrame:
    """What each graph sees: the summary in force and the newest rows of every source.

    ``requests`` holds (incident_id, tick), at any times; by default every
    summary asks for one graph at its window end. One merge looks at all five
    sources.
    """
    if requests is None:
        requests = summaries.select(
            iso_text(F.col("window_end")).alias("incident_id"), F.col("window_end").alias("tick")
        ).distinct()
    inputs = as_of_merge(
        cut_lineage(requests.select("incident_id", "tick")),
        {
            "_summary": Source(summaries, 1, ["services_top", "is_anomaly", "severity", "category", "top_signals"], SUMMARY_ORDER),
            "_alerts": Source(alerts, seen.alerts, ["service", "category", "score"], ALERT_ORDER),
            "_spans": Source(spans, seen.spans, ["service", "name", "duration_ms"], SPAN_ORDER),
            "_metrics": Source(metrics, seen.metrics, ["service", "error_count", "total_count"], METRIC_ORDER),
            "_reports": Source(reports, seen.reports, ["title"], INCIDENT_ORDER),
        },
    )
    # Headers, nodes and edges are three reads of the same short lists.
    return cut_lineage(inputs.withColumn("_summary", F.try_element_at("_summary", F.lit(1))))


def slowest(spans: Column, n: int = V.GRAPH_SHOWN) -> Column:
    """The ``n`` longest spans of a newest-first list; equal durations keep that order."""
    ranked = F.transform(
        spans, lambda s, i: F.struct((-s["duration_ms"]).alias("d"), i.alias("i"), s.alias("span"))
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda r: r["span"])


def _node(id_: Column, label: Column, kind: str, weight: Column, edge: str) -> Column:
    return F.struct(
        id_.alias("id"), label.alias("label"), F.lit(kind).alias("type"),
        weight.cast("double").alias("weight"), F.lit(edge).alias("edge"),
    )


def _numbered(prefix: str, i: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), i.cast("string"))


def root_cause_graphs(inputs: DataFrame, seen: Seen = Seen()) -> Graphs:
    """Graphs from :func:`graph_inputs`. Lists are short and per row, so no shuffle follows."""
    s = F.col("_summary")
    shown = lambda c: F.slice(c, 1, seen.shown)
    active = F.concat(
        F.array(
            _node(F.lit(_ROOT), F.concat(s["category"], F.lit(" ("), s["severity"], F.lit(")")), "incident", F.lit(1.0), "")
        ),
        F.transform(
            s["services_top"],
            lambda x, i: _node(_numbered("svc", i), x, "service", F.lit(0.95) - i * F.lit(0.08), "affected"),
        ),
        F.transform(
            F.slice(s["top_signals"], 1, seen.signals),
            lambda x, i: _node(_numbered("sig", i), x, "signal", F.lit(0.72), "supports"),
        ),
        F.transform(
            shown("_alerts"),
            lambda a, i: _node(
                _numbered("alert", i), F.concat(a["service"], F.lit(":"), a["category"]), "alert",
                clamp(a["score"], 0.0, 1.0), "evidence",
            ),
        ),
        F.transform(
            slowest(F.col("_spans"), seen.shown),
            lambda t, i: _node(
                _numbered("trace", i), F.concat(t["service"], F.lit(":"), t["name"]), "trace",
                clamp(t["duration_ms"] / 2500.0, 0.15, 1.0), "observed",
            ),
        ),
        F.transform(
            shown("_metrics"),
            lambda m, i: _node(
                _numbered("metric", i),
                F.concat(
                    m["service"], F.lit(" err="), m["error_count"].cast("string"), F.lit("/"),
                    m["total_count"].cast("string"),
                ),
                "metric",
                clamp(error_ratio(m["error_count"], m["total_count"]), 0.15, 1.0),
                "correlates",
            ),
        ),
        F.transform(
            F.slice("_reports", 1, seen.shown_reports),
            lambda r, i: _node(_numbered("report", i), r["title"], "report", F.lit(0.6), "matches"),
        ),
    )
    idle = F.array(_node(F.lit("n0"), F.lit(V.GRAPH_EMPTY_LABEL), "state", F.lit(0.2), ""))
    graphs = inputs.withColumn("_nodes", F.when(s.isNull(), idle).otherwise(active))

    exploded = graphs.select("incident_id", F.explode("_nodes").alias("n"))
    nodes = exploded.select("incident_id", "n.id", "n.label", "n.type", "n.weight")
    edges = exploded.where(F.col("n.edge") != "").select(
        "incident_id", F.col("n.id").alias("from"), F.lit(_ROOT).alias("to"), F.col("n.edge").alias("label")
    )
    headers = graphs.select(
        "incident_id",
        iso_text(F.col("tick")).alias("ts"),
        F.when(s.isNull(), V.GRAPH_EMPTY_TITLE).otherwise(V.GRAPH_TITLE).alias("title"),
        F.when(s.isNull(), F.lit(V.GRAPH_EMPTY_CONFIDENCE)).otherwise(confidence(s["is_anomaly"])).alias("confidence"),
        F.when(s.isNull(), V.GRAPH_EMPTY_HYPOTHESIS).otherwise(hypothesis(s["category"])).alias("hypothesis"),
    )
    return Graphs(headers, nodes, edges)


def confidence(is_anomaly: Column) -> Column:
    """Grows with the rows seen (up to five of each kind), at most 0.95."""

    def counted(c: str, weight: float) -> Column:
        return F.least(F.size(c), F.lit(5)) * F.lit(weight)

    total = F.when(is_anomaly, 0.35).otherwise(0.1) + counted("_alerts", 0.05) + counted("_spans", 0.04) + counted("_metrics", 0.03)
    return let(total, lambda x: F.least(x, F.lit(0.95)))


def hypothesis(category: Column) -> Column:
    text = F.when(F.lit(False), F.lit(""))
    for name, sentence in V.HYPOTHESES.items():
        text = text.when(category == name, sentence)
    return text.otherwise(V.HYPOTHESIS_OTHER)
