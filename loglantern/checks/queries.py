"""Registered queries: every operator over the given tables, whole.

Each takes (spark, sf_dir) and returns flat columns: lists as text, times as
ISO text, decimals rounded to six places. Windows are an hour and six hours
(three for the summaries) because the given events are minutes apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from loglantern import schemas
from loglantern.checks.fixtures import HOUR, table, view
from loglantern.functions import log_fields as L
from loglantern.functions import replies as R
from loglantern.functions import text as X
from loglantern.functions import vectors as VEC
from loglantern.functions.embedding import embed
from loglantern.functions.net import normalize_ip
from loglantern.operators import asof, dashboard, feed, incidents, metrics, ranking, related, review, similarity, spans, summaries
from loglantern.operators.panes import latest_per_key
from loglantern.plans import jobs
from loglantern.session import cut_lineage, shared_dir
from loglantern.sources import kafka, tables
from loglantern.streaming import streams

SHORT, LONG, SLIDE = HOUR, 6 * HOUR, HOUR
ANALYSIS, ANALYSIS_SLIDE = 3 * HOUR, HOUR
SEP = " | "

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Plain columns that compare the same in both engines."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = L.iso_text(c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, SEP)
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


# ---- inputs -------------------------------------------------------------


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "rawlogs").withColumnRenamed("event_ts", "source_ts")


def logs_of(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "logs")


def alerts_of(spark: SparkSession, d: str) -> DataFrame:
    return jobs.detect_alerts(raw_lines(spark, d), ingest_ts=F.col("source_ts"))


def metrics_of(spark: SparkSession, d: str) -> DataFrame:
    return jobs.service_window_metrics(logs_of(spark, d), SHORT, LONG, SLIDE)


def summaries_of(spark: SparkSession, d: str) -> DataFrame:
    replies = view(spark, d, "window_replies")
    return jobs.window_summaries(logs_of(spark, d), replies, ANALYSIS, ANALYSIS_SLIDE)


def incidents_of(spark: SparkSession, d: str) -> DataFrame:
    return jobs.build_incidents(
        summaries_of(spark, d), alerts_of(spark, d), view(spark, d, "draft_replies")
    )


# ---- parsing ------------------------------------------------------------


@query
def parse_logs(spark, d):
    parsed = jobs.parse_logs(raw_lines(spark, d), ingest_ts=F.col("source_ts"))
    return flat(parsed.drop("raw", "source_ts"))


@query
def message_hints(spark, d):
    m = F.col("message")
    return flat(logs_of(spark, d).select("ord", L.message_ip(m).alias("ip"), L.message_endpoint(m).alias("endpoint")))


@query
def normalized_addresses(spark, d):
    """Addresses written in several ways, from the user ids of the events."""
    u = F.col("user_id")
    text = (
        F.when(u % 5 == 0, F.concat(F.lit(" 203.0.113."), u % 300))
        .when(u % 5 == 1, F.concat(F.lit("010.0."), u % 256, F.lit(".07")))
        .when(u % 5 == 2, F.concat(F.lit("2001:DB8::"), F.lower(F.hex(u % 65536))))
        .when(u % 5 == 3, F.concat(F.lit("host-"), u))
        .otherwise(F.concat(F.lit("::ffff:10.0.0."), u % 256))
    )
    ips = table(spark, d, "events").select("event_id", text.alias("written"))
    return ips.withColumn("ip", normalize_ip(F.col("written")))


@query
def serialized_logs(spark, d):
    value = F.to_json(summaries.log_struct(), {"ignoreNullFields": "false"})
    return logs_of(spark, d).select("ord", value.alias("value"))


@query
def display_logs(spark, d):
    return logs_of(spark, d).select(
        "ord",
        X.truncate(F.col("message"), 20).alias("short_message"),
        X.display_time(F.col("event_ts")).alias("shown_at"),
    )


# ---- replies ------------------------------------------------------------


def _reply_texts(spark, d) -> DataFrame:
    """Replies of every log: plain JSON, JSON inside prose, no JSON, wrong types, none."""
    o, msg = F.col("ord"), F.col("message")
    reply = (
        F.when(o % 7 == 0, F.lit(None).cast("string"))
        .when(o % 7 == 1, F.concat(F.lit("No idea about "), msg))
        .when(o % 7 == 2, F.concat(F.lit('{"is_anomaly":true,"score":0.'), o % 10, F.lit(',"category":"latency","explanation":"'), msg, F.lit('"}')))
        .when(o % 7 == 3, F.concat(F.lit('Well: {"is_anomaly":"true","score":"0.75"} ok '), o))
        .when(o % 7 == 4, F.concat(F.lit("} odd { "), o))
        .when(o % 7 == 5, F.lit('{"is_anomaly":null,"score":"high","category":null,"explanation":["a"]}'))
        .otherwise(F.concat(F.lit('{"is_anomaly":1,"score":1,"category":"security","explanation":'), o, F.lit("}")))
    )
    return raw_lines(spark, d).join(logs_of(spark, d).select("ord", reply.alias("reply")), "ord").withColumn(
        "reply_failed", (o % 21 == 7) & F.col("reply").isNull()
    )


@query
def reviewed_logs(spark, d):
    r = jobs.reviewed_logs(raw_lines(spark, d), ingest_ts=F.col("source_ts"))
    return flat(r.select("ord", "review.is_anomaly", "review.score", "review.category", "review.explanation"))


@query
def replied_log_reviews(spark, d):
    r = jobs.reviewed_logs(_reply_texts(spark, d), ingest_ts=F.col("source_ts"))
    return flat(r.select("ord", "review.is_anomaly", "review.score", "review.category", "review.explanation"))


@query
def alerts(spark, d):
    return flat(alerts_of(spark, d))


@query
def alert_category_counts(spark, d):
    return alerts_of(spark, d).groupBy("service", "category").agg(F.count("*").alias("n"))


@query
def agent_answers(spark, d):
    replies = view(spark, d, "window_replies").withColumn(
        "reply", F.replace(F.replace("reply", F.lit('"summary"'), F.lit('"answer"')), F.lit('"top_signals"'), F.lit('"steps"'))
    )
    a = review.answer_questions(review.structured_answers(replies))
    return flat(a.select("window_start", "answer", F.col("agent.answer").alias("agent_answer"), "agent.steps", "agent.commands", "agent.cautions"))


@query
def envelope_contents(spark, d):
    """Completion envelopes around the window replies, unwrapped again."""
    replies = view(spark, d, "window_replies").where(F.col("reply").isNotNull())
    raw = F.concat(
        F.lit('{"choices":['),
        F.to_json(F.struct(F.struct(F.col("reply").alias("content")).alias("message"))),
        F.lit("]}"),
    )
    return flat(replies.select("window_start", R.envelope_content(raw).alias("content")))


# ---- windows ------------------------------------------------------------


@query
def service_metrics(spark, d):
    return flat(metrics_of(spark, d))


@query
def metric_messages(spark, d):
    """Metric messages and unrelated lines in one topic; only readable metrics come back."""
    sent = metrics.to_metric_message(metrics_of(spark, d)).select("value")
    return flat(metrics.from_metric_message(sent.unionByName(raw_lines(spark, d).select(F.col("raw").alias("value")))))


@query
def metric_error_ratios(spark, d):
    m = metrics_of(spark, d)
    return flat(
        m.select("window_start", "window_sec", "service", metrics.error_ratio(F.col("error_count"), F.col("total_count")).alias("ratio"))
    )


@query
def window_aggregates(spark, d):
    return flat(summaries.window_aggregates(logs_of(spark, d), ANALYSIS, ANALYSIS_SLIDE))


@query
def window_payloads(spark, d):
    return flat(summaries.window_payloads(logs_of(spark, d), ANALYSIS, ANALYSIS_SLIDE).select("window_start", "payload"))


@query
def window_summaries(spark, d):
    return flat(summaries_of(spark, d))


@query
def failed_window_summaries(spark, d):
    """Summaries when the analysis of every fifth hour failed."""
    windows = summaries.window_aggregates(logs_of(spark, d), ANALYSIS, ANALYSIS_SLIDE)
    failed = F.hour("window_start") % 5 == 0
    return flat(summaries.finish_summaries(review.failed_window_review(review.review_windows(windows), failed)))


# ---- joins --------------------------------------------------------------


@query
def logs_near_alerts(spark, d):
    return flat(related.near_alerts(logs_of(spark, d), alerts_of(spark, d)).select("ord", "ts", "service"))


@query
def logs_near_alerts_wide(spark, d):
    found = related.near_alerts(logs_of(spark, d), alerts_of(spark, d).where("category = 'latency'"), gap_sec=300)
    return flat(found.select("ord", "ts", "service"))


@query
def related_alerts(spark, d):
    r = related.related_alerts(logs_of(spark, d), alerts_of(spark, d))
    lines = F.transform("related", lambda a: F.concat_ws(" ", a["ts"], a["service"], a["category"]))
    return flat(r.select("ord", lines.alias("related")))


@query
def alerts_as_of_window(spark, d):
    ticks = summaries.window_aggregates(logs_of(spark, d), ANALYSIS, ANALYSIS_SLIDE).select("window_end")
    seen = asof.as_of_last(alerts_of(spark, d), ticks, 10, ["ord"], "seen", at="window_end")
    return flat(seen.select("window_end", F.transform("seen", lambda a: a["ord"].cast("string")).alias("seen")))


@query
def service_alerts_as_of_window(spark, d):
    """The same per service: the scope key of the as-of lookup."""
    ticks = metrics_of(spark, d).where(F.col("window_sec") == SHORT).select("service", "window_end")
    seen = asof.as_of_last(alerts_of(spark, d), ticks, 3, ["ord"], "seen", at="window_end", keys=["service"])
    return flat(seen.select("service", "window_end", F.transform("seen", lambda a: a["ord"].cast("string")).alias("seen")))


@query
def alerts_as_of_any_time(spark, d):
    """The last alerts and spans of the service at the very time of every event, off any grid."""
    ticks = logs_of(spark, d).select("ord", "service", (F.col("event_ts") + F.make_dt_interval(secs=F.lit(0.25))).alias("tick"))
    owner = F.when(F.col("service") == "backend", "api").when(F.col("service") == "gateway", "auth").otherwise("db")
    seen = asof.as_of_merge(
        cut_lineage(ticks),
        {
            "alerts": asof.Source(alerts_of(spark, d), 3, ["ord"]),
            "spans": asof.Source(view(spark, d, "spans").withColumn("service", owner), 2, ["span_id"]),
        },
        keys=["service"],
    )
    return flat(
        seen.select("ord", F.transform("alerts", lambda a: a["ord"].cast("string")).alias("alerts"), F.transform("spans", lambda s: s["span_id"]).alias("spans"))
    )


# ---- embeddings ---------------------------------------------------------


@query
def document_embeddings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    return flat(docs.select("doc_id", F.posexplode("v").alias("slot", "weight")).where("weight <> 0"))


@query
def document_token_hashes(spark, d):
    token = F.explode(VEC.tokens(F.col("text"))).alias("token")
    words = table(spark, d, "documents").select(token).distinct()
    return words.select("token", VEC.string_hash(F.col("token")).alias("hash"))


@query
def normalized_vectors(spark, d):
    v = F.col("embedding").cast("array<double>")
    unit = table(spark, d, "embeddings").select("vec_id", VEC.l2_normalize(v).alias("v"))
    return flat(unit.select("vec_id", F.posexplode("v").alias("slot", "value")))


@query
def vector_texts(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", VEC.vector_text(v).alias("text"))


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


@query
def nearest_vectors(spark, d):
    v = _vectors(spark, d)
    hits = similarity.nearest(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "id"), 5)
    return flat(hits)


@query
def nearest_earlier_vectors(spark, d):
    """Ids stand in for times: only vectors with a smaller id qualify."""
    v = _vectors(spark, d).withColumn("at", F.timestamp_seconds("vec_id"))
    hits = similarity.nearest(
        v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "id"), 5, earlier_only=True, block_rows=200
    )
    return flat(hits)


# ---- incidents ----------------------------------------------------------


@query
def incident_contexts(spark, d):
    anomalies = incidents.new_anomalies(summaries_of(spark, d))
    contexts = incidents.incident_contexts(anomalies, alerts_of(spark, d))
    return flat(contexts.select("window_end", "context"))


@query
def incident_reports(spark, d):
    return flat(incidents_of(spark, d).drop("embedding"))


@query
def incident_embeddings(spark, d):
    i = incidents_of(spark, d).select("id", F.posexplode("embedding").alias("slot", "weight"))
    return flat(i.where("weight <> 0"))


@query
def unreported_anomalies(spark, d):
    """Anomalies left when the even hours are reported already."""
    s = cut_lineage(summaries_of(spark, d))
    known = s.where("is_anomaly and hour(window_end) % 2 = 0").select(
        F.col("window_end").alias("event_ts"), "category", "severity", "summary"
    )
    twice = s.unionByName(s)
    return flat(incidents.new_anomalies(twice, known).select("window_end", "category", "severity", "summary"))


@query
def similar_incidents(spark, d):
    """The closest reports for every distinct log message without its numbers."""
    store = cut_lineage(incidents_of(spark, d))
    message = F.regexp_replace("message", "[0-9]+", "N")
    texts = logs_of(spark, d).select(message.alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    hits = jobs.similar_incidents(texts, store)
    return flat(hits.select("query_id", "position", "id", "ts", "title", "summary", "severity", "category", "score"))


@query
def incident_table_rows(spark, d):
    """Relational form of the reports and back, every fourth list unreadable."""
    rows = incidents.to_table_rows(incidents_of(spark, d))
    broken = F.when(F.hour(F.to_timestamp("ts")) % 4 == 0, "not json").otherwise(F.col("evidence_json"))
    return flat(incidents.from_table_rows(rows.withColumn("evidence_json", broken)))


def _saves(spark, d) -> DataFrame:
    """Repeated saves of reports: one row per event, the user being the report."""
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("r"), "user_id").alias("id"), F.col("event_type").alias("title"), F.col("event_id").alias("version")
    )


@query
def merged_incidents(spark, d):
    saves = _saves(spark, d)
    early = saves.where("title = 'view' or title = 'error'")
    late = saves.where("title <> 'view' and title <> 'error'")
    base = latest_per_key(early, ["id"], [F.col("version").desc()], 1).drop("_rank")
    return incidents.merge_incidents(base, late)


@query
def newest_saved_incidents(spark, d):
    return incidents.newest_saved(_saves(spark, d), 40)


@query
def latest_incidents(spark, d):
    found = ranking.latest(tables.read_incidents(spark, _incident_table(spark, d)), 10, ranking.INCIDENT_ORDER)
    return flat(found.select("id", "ts", "title"))


@query
def incident_by_id(spark, d):
    """Point lookup, in the incident table, of the report of the last anomalous window."""
    at = _incident_table(spark, d)
    last = ranking.latest(tables.read_incidents(spark, at), 1, ranking.INCIDENT_ORDER).select("id").first()
    # Without an anomalous window there is no report, and no id to look up.
    found = tables.incident_by_id(spark, at, last["id"]) if last else spark.createDataFrame([], schemas.INCIDENT)
    return flat(found.select("id", "ts", "title", "severity", "category"))


def _incident_table(spark, d) -> str:
    """The reports as a table of four batches, two of them saved again with another title first, then compacted."""
    at = _folder(spark)
    reports = cut_lineage(incidents_of(spark, d))
    part = F.pmod(F.xxhash64("id"), F.lit(4))
    tables.write_incidents(reports.where(part < 2).withColumn("title", F.lit("early")), at, 0)
    for i in range(4):
        tables.write_incidents(reports.where(part == i), at, i + 1)
    tables.compact_incidents(spark, at, fan=3)
    return at


@query
def stored_incidents(spark, d):
    """The incident table after saves, repeated saves and a merge: the newest version of each report."""
    found = tables.read_incidents(spark, _incident_table(spark, d))
    return flat(found.select("id", "ts", "title", "severity", "category"))


# ---- latest rows --------------------------------------------------------


@query
def latest_alerts(spark, d):
    return flat(ranking.latest(alerts_of(spark, d), 20, ranking.ALERT_ORDER).select("ord", "ts", "service", "category"))


@query
def latest_summary(spark, d):
    return flat(ranking.latest(summaries_of(spark, d), 1, ranking.SUMMARY_ORDER).select("window_end", "total_logs", "summary"))


@query
def latest_metrics(spark, d):
    m = ranking.latest(metrics_of(spark, d), 100, ranking.METRIC_ORDER)
    return flat(m.select("window_end", "window_sec", "service", "total_count"))


@query
def latest_spans(spark, d):
    return flat(ranking.latest(view(spark, d, "spans"), 100, ranking.SPAN_ORDER).select("ord", "span_id", "name", "duration_ms"))


@query
def span_errors(spark, d):
    """Attributes of slow spans get an error entry."""
    s = view(spark, d, "spans").withColumn("attributes", F.create_map(F.lit("topic"), F.lit("logs.raw")))
    s = spans.with_errors(s, F.when(F.col("duration_ms") > 1000, F.concat(F.lit("slow "), F.col("name"))))
    return s.select("ord", F.col("attributes")["topic"].alias("topic"), F.col("attributes")["error"].alias("error"))


# ---- root cause ---------------------------------------------------------


def _graphs(spark, d):
    """Graphs at every window end and one slide before each, so the first ones see no summary."""
    s = cut_lineage(summaries_of(spark, d))
    reports = jobs.build_incidents(s, alerts_of(spark, d), view(spark, d, "draft_replies"))
    ends = s.select(F.explode(F.array("window_end", F.col("window_end") - F.make_dt_interval(hours=F.lit(4)))).alias("tick")).distinct()
    requests = ends.select(L.iso_text(F.col("tick")).alias("incident_id"), "tick")
    return jobs.root_cause(
        s, alerts_of(spark, d), view(spark, d, "spans"), metrics_of(spark, d), reports, requests
    )


@query
def root_cause_headers(spark, d):
    return flat(_graphs(spark, d).headers)


@query
def root_cause_nodes(spark, d):
    return flat(_graphs(spark, d).nodes)


@query
def root_cause_edges(spark, d):
    return flat(_graphs(spark, d).edges)


# ---- dashboard ----------------------------------------------------------


@query
def dashboard_kpis(spark, d):
    return flat(jobs.dashboard_kpis(logs_of(spark, d), alerts_of(spark, d)))


@query
def active_alerts(spark, d):
    """Alerts that nobody took; security alerts count as taken here."""
    a = alerts_of(spark, d).withColumn("status", F.when(F.col("category") == "security", "TAKEN").otherwise(F.col("status")))
    return flat(dashboard.active_alerts(a).select("ord", "service", "category"))


@query
def distinct_services(spark, d):
    return dashboard.distinct_services(logs_of(spark, d))


@query
def search_recent_logs(spark, d):
    found = jobs.search_logs(logs_of(spark, d), alerts_of(spark, d), query=" QUERY ", level="INFO", anomaly_only=True, recent=600)
    return flat(found.select("ord", "ts", "service", "level", "message"))


@query
def search_all_logs(spark, d):
    found = jobs.search_logs(logs_of(spark, d), query="heap at 4", service="db", recent=None)
    return flat(found.select("ord", "ts", "service", "level", "message"))


@query
def question_prompts(spark, d):
    """One question per log, every tenth blank, every fourth about the overview."""
    o = F.col("ord")
    questions = logs_of(spark, d).select(
        "ord",
        F.when(o % 10 == 9, "  ").otherwise(F.concat(F.lit("What about "), F.col("message"), F.lit("?"))).alias("question"),
        F.when(o % 4 == 0, "overview").otherwise("log").alias("mode"),
        F.when(o % 8 != 1, F.struct("ts", "service", "level", "message", "latency_ms", "stacktrace")).alias("log"),
    )
    asked = jobs.ask_context(questions, logs_of(spark, d), alerts_of(spark, d), summaries_of(spark, d))
    return asked.select("ord", "mode", "prompt")


@query
def feed_messages(spark, d):
    f = jobs.feed_messages(logs_of(spark, d), alerts_of(spark, d), summaries_of(spark, d))
    return flat(f.withColumn("message", feed.envelope(F.lit("t"), F.col("type"), F.col("data"))).drop("data"))


@query
def feed_snapshot(spark, d):
    return jobs.feed_snapshot(logs_of(spark, d), alerts_of(spark, d), summaries_of(spark, d))


@query
def notifications(spark, d):
    """Summaries notified when repeats within five hours are held back."""
    sent = jobs.throttle_notifications(summaries_of(spark, d), gap_ms=5 * HOUR * 1000)
    return flat(sent.select("window_start", "category", "severity"))


@query
def scoped_notifications(spark, d):
    """The same rule over all events: the user group is the scope, the type the key."""
    e = table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 3).alias("scope"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("category"), F.lit("low").alias("severity"),
        F.lit(True).alias("is_anomaly"),
    )
    sent = jobs.throttle_notifications(e, gap_ms=HOUR * 1000, scope=["scope"], at="at", tie=["event_id"])
    return sent.select("event_id")


# ---- reviewers ----------------------------------------------------------


def _log_reviewer(lines):
    """Replies that depend on the line alone; some calls fail, some replies cannot be read."""
    if any(len(line) % 13 == 0 for line in lines):
        raise RuntimeError("no reply")
    return [
        "no idea" if len(line) % 5 == 0
        else f'{{"is_anomaly":{"true" if len(line) % 2 else "false"},"score":0.{len(line) % 10},"category":"latency","explanation":"length {len(line)}"}}'
        for line in lines
    ]


@query
def reviewer_log_reviews(spark, d):
    r = jobs.reviewed_logs(raw_lines(spark, d), ingest_ts=F.col("source_ts"), reviewer=_log_reviewer)
    return flat(r.select("ord", "review.is_anomaly", "review.score", "review.category", "review.explanation"))


def _window_reviewer(payloads):
    if any(len(p) % 7 == 0 for p in payloads):
        raise RuntimeError("no reply")
    return [
        f'Review: {{"is_anomaly":true,"severity":"high","category":"security","summary":"payload {len(p)}","top_signals":["a","b"],"recommended_actions":[]}}'
        if len(p) % 3 else f"unsure about {len(p)}"
        for p in payloads
    ]


@query
def reviewer_window_reviews(spark, d):
    """Windows reviewed from their payload by a callable."""
    windows = summaries.window_payloads(logs_of(spark, d), ANALYSIS, ANALYSIS_SLIDE)
    found = summaries.finish_summaries(review.review_windows(review.call_reviewer(windows, "payload", _window_reviewer)))
    return flat(found.select("window_start", "is_anomaly", "severity", "category", "summary", "top_signals"))


def _drafter(contexts):
    if any(len(c) % 11 == 0 for c in contexts):
        raise RuntimeError("no reply")
    return [f'{{"title":"Draft of {len(c)}","impact":"","timeline":["t{len(c) % 4}"],"evidence":["e"],"recommended_actions":["look"]}}' for c in contexts]


@query
def drafter_incident_reports(spark, d):
    """Reports drafted from their context by a callable."""
    found = jobs.build_incidents(summaries_of(spark, d), alerts_of(spark, d), drafter=_drafter)
    return flat(found.select("event_ts", "title", "impact", "timeline", "evidence", "recommended_actions"))


def _answerer(prompts):
    if any(len(p) % 17 == 0 for p in prompts):
        raise RuntimeError("no reply")
    return [" " if len(p) % 9 == 0 else f"Answer of {len(p)}" for p in prompts]


@query
def answered_questions(spark, d):
    """Questions to answers; those of equal prompts share one request."""
    o = F.col("ord")
    questions = logs_of(spark, d).select(
        "ord",
        F.when(o % 10 == 9, "  ").otherwise(F.concat(F.lit("What about "), F.regexp_replace("message", "[0-9]+", "N"), F.lit("?"))).alias("question"),
        F.when(o % 4 == 0, "overview").otherwise("log").alias("mode"),
        F.when(o % 8 != 1, F.struct("ts", "service", "level", "message", "latency_ms", "stacktrace")).alias("log"),
    )
    found = jobs.answered_questions(questions, logs_of(spark, d), alerts_of(spark, d), summaries_of(spark, d), _answerer)
    return found.select("ord", "prompt", "reply_failed", "answer")


# ---- Kafka shapes -------------------------------------------------------


def _kafka_rows(spark, d) -> DataFrame:
    """The raw lines as a topic of three partitions with one broker time per hour."""
    raw = raw_lines(spark, d)
    return raw.select(
        F.lit(None).cast("binary").alias("key"), F.col("raw").cast("binary").alias("value"), (F.col("ord") % 3).cast("int").alias("partition"),
        F.floor(F.col("ord") / 3).cast("long").alias("offset"), F.date_trunc("hour", "source_ts").alias("timestamp"),
    )


@query
def kafka_log_lines(spark, d):
    """Logs of a topic, with their place in the order of arrival within the hour."""
    logs = jobs.parse_logs(kafka.raw_lines(_kafka_rows(spark, d)), ingest_ts=F.col("source_ts"))
    order = Window.partitionBy(F.col("ord.timestamp")).orderBy("ord")
    return flat(logs.select("ord.timestamp", "ord.partition", "ord.offset", F.row_number().over(order).alias("place"), "service", "level", "message"))


@query
def kafka_log_messages(spark, d):
    """Logs written to a topic and parsed again: key, JSON and what comes back."""
    sent = kafka.log_messages(logs_of(spark, d))
    back = jobs.parse_logs(sent.withColumnRenamed("value", "raw"), ingest_ts=F.lit(None).cast("timestamp"))
    return flat(back.select("key", F.col("raw").alias("value"), "ts", "service", "level", "message", "latency_ms"))


# ---- streams ------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _canonical_lines(spark, d) -> DataFrame:
    """The logs as the JSON lines that a log sink writes."""
    logs = logs_of(spark, d)
    return logs.select("ord", F.col("event_ts").alias("source_ts"), F.to_json(summaries.log_struct(), {"ignoreNullFields": "false"}).alias("raw"))


def _landed(spark, raw: DataFrame) -> str:
    """Raw lines as files, ingested by a stream into logs, alerts, tails and panes."""
    at = _folder(spark)
    raw.write.parquet(f"{at}/raw")
    stream = spark.readStream.schema(raw.schema).parquet(f"{at}/raw")
    streams.start_ingest(stream, f"{at}/out", f"{at}/ingest", pane_sec=HOUR, ingest_ts=F.col("source_ts")).awaitTermination()
    return at


def _drained(df: DataFrame, at: str, name: str) -> DataFrame:
    """Run a stream until its input is used up, and read what it has written."""
    sink = df.writeStream.format("parquet").option("path", f"{at}/{name}").outputMode("append")
    streams.start(sink, f"{at}/{name}-progress").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")


@query
def streamed_service_metrics(spark, d):
    """Ingest, panes and closed windows of both sizes, as streams; a window closes six hours behind the newest."""
    at = _landed(spark, _canonical_lines(spark, d))
    panes = tables.stream_batches(spark, f"{at}/out/panes", schemas.PANE)
    return flat(_drained(streams.metric_stream(panes, SHORT, LONG, SLIDE, delay_sec=0), at, "metrics"))


@query
def streamed_alerts(spark, d):
    """The alert table that ingestion writes, as a stream of its own reads it."""
    at = _landed(spark, raw_lines(spark, d))
    return flat(_drained(tables.stream_batches(spark, f"{at}/out/alerts", schemas.ALERT), at, "seen").drop("batch_id"))


@query
def streamed_summaries(spark, d):
    """Summaries of the windows that a stream of counts closes, with samples from the tails of their days."""
    at = _landed(spark, _canonical_lines(spark, d))
    counts = streams.service_count_stream(tables.stream_batches(spark, f"{at}/out/panes", schemas.PANE), ANALYSIS, ANALYSIS_SLIDE, delay_sec=0)
    streams.start_summaries(
        counts, f"{at}/out/tails", f"{at}/summaries", f"{at}/summaries-progress",
        window_sec=ANALYSIS, slide_sec=ANALYSIS_SLIDE, reviewer=_window_reviewer,
    ).awaitTermination()
    found = tables.read_batches(spark, f"{at}/summaries", schemas.SUMMARY)
    return flat(found.select("window_start", "window_end", "total_logs", "error_count", "services_top", "summary", "top_signals"))


@query
def streamed_new_summaries(spark, d):
    """Anomalous summaries of a stream in which every one comes twice."""
    at = _folder(spark)
    rows = cut_lineage(summaries_of(spark, d))
    for part in range(2):
        rows.write.mode("append").parquet(f"{at}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/rows")
    found = _drained(streams.new_summaries(stream, delay_sec=10**9), at, "new")
    return flat(found.select("window_end", "category", "severity", "summary"))
