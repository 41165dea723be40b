"""The same results in plain DuckDB SQL, written the direct way.

Windows are enumerated per row, as-of lookups join every earlier row, nearest
neighbours compare every pair: slow and obvious, to check the Spark plans.
"""

from __future__ import annotations

from loglantern.checks.fixtures import _NEEDS, _VIEWS, HOUR
from loglantern import fixed_values as V

ISO = "%Y-%m-%dT%H:%M:%S.%fZ"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def iso(c: str) -> str:
    return f"strftime({c}, '{ISO}')"


def joined(c: str) -> str:
    return f"coalesce(array_to_string({c}, ' | '), '')"


def distinct_in_order(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def text_list(j: str) -> str:
    """A JSON array as list of texts, anything else as an empty list."""
    return f"CASE WHEN json_type({j}) = 'ARRAY' THEN CAST({j} AS VARCHAR[]) ELSE []::VARCHAR[] END"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


# name -> (needed fragments, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    name: (needs, _VIEWS[name].replace("{TSTEXT}", iso("ts")).replace("{STR}", "VARCHAR"))
    for name, needs in _NEEDS.items()
}


def part(name: str, needs: tuple[str, ...], sql: str) -> None:
    PARTS[name] = (needs, sql)


def with_(names: tuple[str, ...], select: str) -> str:
    done: list[str] = []

    def add(n: str) -> None:
        for need in PARTS[n][0]:
            add(need)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]}\n)" for n in done) + "\n" + select


part("lines", ("rawlogs",), "SELECT ord, event_ts AS source_ts, raw, CASE WHEN json_valid(raw) THEN raw END AS j FROM rawlogs")
part("fields", ("lines",), """
SELECT ord, source_ts, raw, j,
  coalesce(j->>'ts', j->>'timestamp') AS f_ts,
  coalesce(j->>'service', j->>'app', j->>'serviceName', j->>'service_name') AS f_service,
  coalesce(j->>'level', j->>'severity') AS f_level,
  coalesce(j->>'message', j->>'msg') AS f_message,
  coalesce(j->>'latencyMs', j->>'latency', j->>'latency_ms', j->>'responseTimeMs') AS f_latency
FROM lines""")
part("parsed", ("fields",), f"""
SELECT ord, raw, j, parse_tier, coalesce(f_ts, {iso('source_ts')}) AS ts, coalesce(f_service, 'unknown') AS service,
  CASE WHEN parse_tier = 1 THEN f_level ELSE upper(coalesce(f_level, 'INFO')) END AS level,
  coalesce(f_message, raw) AS message,
  CASE WHEN f_latency IS NOT NULL THEN coalesce(TRY_CAST(f_latency AS BIGINT), 0) END AS latency_ms,
  CAST(coalesce(f_ts, {iso('source_ts')}) AS TIMESTAMP) AS event_ts
FROM (SELECT *, CASE WHEN j IS NULL THEN 3
    WHEN f_ts IS NOT NULL AND f_service IS NOT NULL AND f_level IS NOT NULL AND f_message IS NOT NULL
      AND (f_latency IS NULL OR TRY_CAST(f_latency AS INT) IS NOT NULL) THEN 1 ELSE 2 END AS parse_tier FROM fields) f""")
part("judged", ("lines",), f"""
SELECT ord, raw, CASE
    WHEN j IS NULL THEN CASE WHEN {any_of('lower(raw)', V.TEXT_WORDS)} THEN 'other' ELSE 'normal' END
    WHEN lower(coalesce(j->>'service', '')) = 'auth' OR {any_of("lower(coalesce(j->>'message', ''))", V.AUTH_WORDS)} THEN 'security'
    WHEN coalesce(TRY_CAST(j->>'latencyMs' AS INT), 0) >= 1500 OR {any_of("lower(coalesce(j->>'message', ''))", V.LATENCY_WORDS)} THEN 'latency'
    WHEN {any_of("lower(coalesce(j->>'message', ''))", V.RESOURCE_WORDS)} THEN 'resource'
    WHEN upper(coalesce(j->>'level', '')) = 'ERROR' OR {any_of("lower(coalesce(j->>'message', ''))", V.ERROR_WORDS)} THEN 'error_spike'
    ELSE 'normal' END AS category, j IS NULL AS is_text
FROM lines""")
part("reviews", ("judged",), f"""
SELECT ord, raw, category <> 'normal' AS is_anomaly, category, is_text,
  CASE WHEN is_text THEN CASE category WHEN 'other' THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END
    ELSE CASE category {' '.join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in V.CATEGORY_SCORES.items())} END END AS score,
  concat({q(V.NOTE_NO_REVIEWER)}, CASE WHEN is_text THEN {q(V.NOTE_TEXT_SUFFIX)} ELSE '' END) AS explanation
FROM judged""")
part("alerts", ("reviews", "parsed"), """
SELECT p.ord, p.event_ts, p.ts, p.service, r.category, r.score, p.level, p.message, r.explanation, 'NEW' AS status
FROM parsed p JOIN reviews r ON p.ord = r.ord WHERE r.is_anomaly AND r.score >= 0.6""")


def windowed(source: str, size: str, slide: int) -> str:
    """Each row once per window holding it; ``ws`` is the start in epoch seconds."""
    newest = f"CAST(floor(epoch(event_ts) / {slide}) * {slide} AS BIGINT)"
    return f"""(SELECT * FROM (SELECT *, unnest(generate_series({newest}, {newest} - {size} + 1, -{slide})) AS ws FROM {source}) w
    WHERE ws + {size} > epoch(event_ts))"""


part("hinted", ("logs",), rf"""
SELECT *, nullif(regexp_extract(message, '\bip=([^\s]+)', 1), '') AS ip,
  nullif(regexp_extract(message, '\b(GET|POST|PUT|DELETE|PATCH)\s+([^\s]+)', 2), '') AS endpoint FROM logs""")
part("metrics", ("hinted",), f"""
SELECT make_timestamp(ws * 1000000) AS window_start, make_timestamp((ws + window_sec) * 1000000) AS window_end, window_sec,
  arg_max(ts, ord) AS ts, service, count(*) AS total_count,
  count(*) FILTER (WHERE upper(level) = 'ERROR') AS error_count, count(*) FILTER (WHERE upper(level) = 'WARN') AS warn_count,
  coalesce(CAST(sum(latency_ms) AS DOUBLE) / nullif(count(latency_ms), 0), 0) AS avg_latency_ms,
  CAST(greatest(coalesce(max(latency_ms), 0), 0) AS BIGINT) AS max_latency_ms,
  arg_max(endpoint, ord) FILTER (WHERE endpoint IS NOT NULL) AS endpoint_hint,
  coalesce((list(ip ORDER BY ord) FILTER (WHERE ip IS NOT NULL))[-5:], []) AS last_ips
FROM {windowed(f"(SELECT * FROM hinted, (VALUES ({HOUR}::BIGINT), ({6 * HOUR}::BIGINT)) sizes(window_sec))", "window_sec", HOUR)}
GROUP BY ws, window_sec, service""")
part("window_logs", ("logs",), f"SELECT * FROM {windowed('logs', str(3 * HOUR), HOUR)}")
part("aggregates", ("window_logs",), f"""
SELECT make_timestamp(t.ws * 1000000) AS window_start, make_timestamp((t.ws + {3 * HOUR}) * 1000000) AS window_end,
  {3 * HOUR}::BIGINT AS window_sec, total_logs, error_count, warn_count, services_top
FROM (SELECT ws, count(*) AS total_logs, count(*) FILTER (WHERE upper(level) = 'ERROR') AS error_count,
        count(*) FILTER (WHERE upper(level) = 'WARN') AS warn_count FROM window_logs GROUP BY ws) t
JOIN (SELECT ws, list(concat(service, '(', n, ')') ORDER BY rk) AS services_top
      FROM (SELECT ws, service, n, row_number() OVER (PARTITION BY ws ORDER BY n DESC, first_ord) AS rk
            FROM (SELECT ws, service, count(*) AS n, min(ord) AS first_ord FROM window_logs GROUP BY ws, service) c) r
      WHERE rk <= 3 GROUP BY ws) s ON t.ws = s.ws""")
part("window_bodies", ("window_replies",), r"""
SELECT window_start, reply, CASE WHEN json_valid(body) THEN body END AS b
FROM (SELECT window_start, reply, nullif(regexp_extract(reply, '(?s)\{.*\}'), '') AS body FROM window_replies) r""")
part("summaries", ("aggregates", "window_bodies"), f"""
SELECT a.*, coalesce(CAST(b->>'is_anomaly' AS BOOLEAN), false) AS is_anomaly,
  CASE WHEN b IS NULL THEN 'low' ELSE coalesce(b->>'severity', 'low') END AS severity,
  CASE WHEN reply IS NULL THEN 'normal' WHEN b IS NULL THEN 'other' ELSE coalesce(b->>'category', 'other') END AS category,
  CASE WHEN reply IS NULL THEN {q(V.WINDOW_NO_REVIEWER_SUMMARY)} WHEN b IS NULL THEN {q(V.WINDOW_BAD_REPLY_SUMMARY)}
    ELSE coalesce(b->>'summary', '') END AS summary,
  CASE WHEN reply IS NULL THEN []::VARCHAR[] WHEN b IS NULL THEN [reply] ELSE ({text_list("b->'top_signals'")}) END AS top_signals,
  CASE WHEN reply IS NULL THEN [{q(V.WINDOW_NO_REVIEWER_ACTIONS[0])}] WHEN b IS NULL THEN []::VARCHAR[]
    ELSE ({text_list("b->'recommended_actions'")})[1:6] END AS recommended_actions
FROM aggregates a LEFT JOIN window_bodies USING (window_start)""")

SUMMARY_FLAT = f"""{iso('window_start')} AS window_start, {iso('window_end')} AS window_end, window_sec, total_logs, error_count, warn_count,
  {joined('services_top')} AS services_top, is_anomaly, severity, category, summary, {joined('top_signals')} AS top_signals,
  {joined('recommended_actions')} AS recommended_actions"""
LOG_STRUCT = "{'ts': ts, 'service': service, 'level': level, 'message': message, 'latencyMs': latency_ms, 'stacktrace': stacktrace}"
ALERT_STRUCT = "{" + ", ".join(f"'{c}': {c}" for c in ("ts", "service", "category", "score", "level", "message", "explanation", "status")) + "}"
SUMMARY_STRUCT = (
    f"{{'ts': {iso('window_end')}, 'windowSec': window_sec, 'totalLogs': total_logs, 'errorCount': error_count, 'warnCount': warn_count, "
    "'servicesTop': services_top, 'isAnomaly': is_anomaly, 'severity': severity, 'category': category, 'summary': summary, "
    "'topSignals': top_signals, 'recommendedActions': recommended_actions}"
)

SQL: dict[str, str] = {}

SQL["parse_logs"] = with_(("parsed",), f"""
SELECT ord, parse_tier::BIGINT AS parse_tier, ts, service, level, message, latency_ms, CAST(NULL AS VARCHAR) AS stacktrace, {iso('event_ts')} AS event_ts FROM parsed""")
SQL["message_hints"] = with_(("hinted",), "SELECT ord, ip, endpoint FROM hinted")
SQL["normalized_addresses"] = """
SELECT event_id, CASE user_id % 5 WHEN 0 THEN concat(' 203.0.113.', user_id % 300) WHEN 1 THEN concat('010.0.', user_id % 256, '.07')
    WHEN 2 THEN concat('2001:DB8::', lower(to_hex(user_id % 65536))) WHEN 3 THEN concat('host-', user_id)
    ELSE concat('::ffff:10.0.0.', user_id % 256) END AS written,
  CASE user_id % 5 WHEN 0 THEN CASE WHEN user_id % 300 <= 255 THEN concat('203.0.113.', user_id % 300) END
    WHEN 1 THEN concat('10.0.', user_id % 256, '.7') WHEN 2 THEN concat('2001:db8:0:0:0:0:0:', lower(to_hex(user_id % 65536)))
    WHEN 4 THEN concat('10.0.0.', user_id % 256) END AS ip FROM events"""
SQL["serialized_logs"] = with_(("logs",), f"SELECT ord, CAST(to_json({LOG_STRUCT}) AS VARCHAR) AS value FROM logs")
SQL["display_logs"] = with_(("logs",), """
SELECT ord, CASE WHEN length(message) > 20 THEN concat(left(message, 20), '…') ELSE message END AS short_message,
  strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS shown_at FROM logs""")

SQL["reviewed_logs"] = with_(("reviews",), "SELECT ord, is_anomaly, score, category, explanation FROM reviews")
SQL["replied_log_reviews"] = with_(("reviews", "logs"), f"""
SELECT r.ord,
  CASE r.ord % 7 WHEN 2 THEN true WHEN 3 THEN true WHEN 5 THEN false WHEN 6 THEN true ELSE r.is_anomaly END AS is_anomaly,
  CASE r.ord % 7 WHEN 2 THEN (r.ord % 10) / 10.0 WHEN 3 THEN 0.75 WHEN 5 THEN 0.0 WHEN 6 THEN 1.0 ELSE r.score END AS score,
  CASE r.ord % 7 WHEN 2 THEN 'latency' WHEN 3 THEN 'other' WHEN 5 THEN 'other' WHEN 6 THEN 'security' ELSE r.category END AS category,
  CASE r.ord % 7 WHEN 2 THEN l.message WHEN 3 THEN 'No explanation' WHEN 5 THEN '' WHEN 6 THEN CAST(r.ord AS VARCHAR)
    ELSE concat(CASE WHEN r.ord % 21 = 7 THEN {q(V.NOTE_FAILED_CALL)} WHEN r.ord % 7 = 0 THEN {q(V.NOTE_NO_REVIEWER)} ELSE {q(V.NOTE_BAD_REPLY)} END,
      CASE WHEN is_text THEN {q(V.NOTE_TEXT_SUFFIX)} ELSE '' END) END AS explanation
FROM reviews r JOIN logs l ON r.ord = l.ord""")
SQL["alerts"] = with_(("alerts",), f"SELECT * REPLACE ({iso('event_ts')} AS event_ts) FROM alerts")
SQL["alert_category_counts"] = with_(("alerts",), "SELECT service, category, count(*) AS n FROM alerts GROUP BY ALL")
SQL["agent_answers"] = with_(("window_bodies",), f"""
SELECT {iso('window_start')} AS window_start, coalesce(r, {q(V.ANSWER_NO_REVIEWER)}) AS answer,
  CASE WHEN r IS NULL THEN {q(V.ANSWER_NO_REVIEWER)} WHEN b IS NULL THEN r ELSE b->>'summary' END AS agent_answer,
  {joined(f'''CASE WHEN b IS NULL THEN []::VARCHAR[] ELSE {text_list("b->'top_signals'")} END''')} AS steps, '' AS commands,
  CASE WHEN r IS NULL THEN {q(V.ANSWER_NO_REVIEWER_CAUTION)} WHEN b IS NULL THEN {q(V.ANSWER_NOT_JSON_CAUTION)} ELSE '' END AS cautions
FROM (SELECT window_start, b, replace(replace(reply, '"summary"', '"answer"'), '"top_signals"', '"steps"') AS r FROM window_bodies) x""")
SQL["envelope_contents"] = with_(("window_replies",), f"SELECT {iso('window_start')} AS window_start, reply AS content FROM window_replies WHERE reply IS NOT NULL")

SQL["service_metrics"] = with_(("metrics",), f"""
SELECT {iso('window_start')} AS window_start, {iso('window_end')} AS window_end, window_sec, ts, service, total_count, error_count, warn_count,
  round(avg_latency_ms, 6) AS avg_latency_ms, max_latency_ms, endpoint_hint, {joined(distinct_in_order('last_ips'))} AS failed_ips FROM metrics""")
SQL["metric_messages"] = with_(("metrics", "lines"), f"""
SELECT ts, service, window_sec, total_count, error_count, warn_count, round(avg_latency_ms, 6) AS avg_latency_ms, max_latency_ms, endpoint_hint,
  {joined(distinct_in_order('last_ips'))} AS failed_ips FROM metrics
UNION ALL SELECT j->>'ts', j->>'service', 0, 0, 0, 0, 0.0, 0, NULL, '' FROM lines WHERE j->>'ts' IS NOT NULL AND j->>'service' IS NOT NULL""")
SQL["metric_error_ratios"] = with_(("metrics",), f"""
SELECT {iso('window_start')} AS window_start, window_sec, service, round(error_count::DOUBLE / total_count, 6) AS ratio FROM metrics""")
SQL["window_aggregates"] = with_(("aggregates",), f"""
SELECT {iso('window_start')} AS window_start, {iso('window_end')} AS window_end, window_sec, total_logs, error_count, warn_count,
  {joined('services_top')} AS services_top FROM aggregates""")
SQL["window_payloads"] = with_(("aggregates", "window_logs"), f"""
SELECT {iso('window_start')} AS window_start, CAST(to_json({{'ts': {iso('window_end')}, 'window_sec': window_sec,
  'counts': {{'total': total_logs, 'error': error_count, 'warn': warn_count}}, 'services_top': services_top, 'sample_logs': sample}}) AS VARCHAR) AS payload
FROM aggregates JOIN (SELECT make_timestamp(ws * 1000000) AS window_start, list({LOG_STRUCT} ORDER BY ord) AS sample
  FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY ord DESC) AS rk FROM window_logs) r WHERE rk <= 10 GROUP BY ws) s USING (window_start)""")
SQL["window_summaries"] = with_(("summaries",), f"SELECT {SUMMARY_FLAT} FROM summaries")
SQL["failed_window_summaries"] = with_(("aggregates",), f"""
SELECT {iso('window_start')} AS window_start, {iso('window_end')} AS window_end, window_sec, total_logs, error_count, warn_count,
  {joined('services_top')} AS services_top, false AS is_anomaly, 'low' AS severity, CASE WHEN failed THEN 'other' ELSE 'normal' END AS category,
  CASE WHEN failed THEN {q(V.WINDOW_FAILED_JOB_SUMMARY)} ELSE {q(V.WINDOW_NO_REVIEWER_SUMMARY)} END AS summary,
  CASE WHEN failed THEN {q(V.WINDOW_FAILED_JOB_SIGNALS[0])} ELSE '' END AS top_signals,
  CASE WHEN failed THEN {q(' | '.join(V.WINDOW_FAILED_JOB_ACTIONS))} ELSE {q(V.WINDOW_NO_REVIEWER_ACTIONS[0])} END AS recommended_actions
FROM (SELECT *, hour(window_start) % 5 = 0 AS failed FROM aggregates) a""")


def near(condition: str, gap_ms: int) -> str:
    return with_(("alerts", "logs"), f"""
SELECT ord, ts, service FROM logs l WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.service = l.service AND {condition}
  AND abs(epoch_ms(a.event_ts) - epoch_ms(l.event_ts)) < {gap_ms})""")


SQL["logs_near_alerts"] = near("true", 60000)
SQL["logs_near_alerts_wide"] = near("a.category = 'latency'", 300000)
SQL["related_alerts"] = with_(("alerts", "logs"), """
SELECT l.ord, coalesce(related, '') AS related FROM logs l LEFT JOIN (
  SELECT service, array_to_string(list(concat_ws(' ', ts, service, category) ORDER BY rk), ' | ') AS related
  FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY event_ts DESC, ord DESC) AS rk FROM alerts) a
  WHERE rk <= 5 GROUP BY service) r USING (service)""")


def as_of(ticks: str, events: str, n: int, row: str, order: str, at: str, on: str = "true") -> str:
    """Ticks with the newest rows at or before them, newest first."""
    desc = ", ".join(f"e.{o} DESC" for o in order.split())
    return f"""(SELECT t.*, (SELECT coalesce(list(r ORDER BY rk), []) FROM (SELECT {row} AS r, row_number() OVER (ORDER BY {desc}) AS rk
    FROM {events} e WHERE e.{order.split()[0]} <= t.{at} AND {on}) x WHERE rk <= {n}) AS seen FROM {ticks} t)"""


SQL["alerts_as_of_window"] = with_(("aggregates", "alerts"), f"""
SELECT {iso('window_end')} AS window_end, {joined('seen')} AS seen
FROM {as_of('(SELECT window_end FROM aggregates)', 'alerts', 10, 'CAST(e.ord AS VARCHAR)', 'event_ts ord', 'window_end')} s""")
SQL["service_alerts_as_of_window"] = with_(("metrics", "alerts"), f"""
SELECT service, {iso('window_end')} AS window_end, {joined('seen')} AS seen
FROM {as_of(f'(SELECT service, window_end FROM metrics WHERE window_sec = {HOUR})', 'alerts', 3, 'CAST(e.ord AS VARCHAR)', 'event_ts ord', 'window_end', 'e.service = t.service')} s""")

# Every earlier row of the service, ranked.
SQL["alerts_as_of_any_time"] = with_(("logs", "alerts", "spans"), """
, ticks AS (SELECT ord, service, event_ts + INTERVAL 250 MILLISECOND AS tick FROM logs),
owned AS (SELECT span_id, ord, event_ts, CASE service WHEN 'backend' THEN 'api' WHEN 'gateway' THEN 'auth' ELSE 'db' END AS service FROM spans),
seen_alerts AS (SELECT t.ord, list(CAST(a.ord AS VARCHAR) ORDER BY a.event_ts DESC, a.ord DESC)[1:3] AS l
  FROM ticks t JOIN alerts a ON a.service = t.service AND a.event_ts <= t.tick GROUP BY t.ord),
seen_spans AS (SELECT t.ord, list(s.span_id ORDER BY s.event_ts DESC, s.ord DESC)[1:2] AS l
  FROM ticks t JOIN owned s ON s.service = t.service AND s.event_ts <= t.tick GROUP BY t.ord)
SELECT t.ord, coalesce(array_to_string(a.l, ' | '), '') AS alerts, coalesce(array_to_string(s.l, ' | '), '') AS spans
FROM ticks t LEFT JOIN seen_alerts a USING (ord) LEFT JOIN seen_spans s USING (ord)""")


HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(tok, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295)"


def embedded(source: str, key: str, text: str) -> str:
    """(key, slot, weight) of the normalised embedding, zero slots left out."""
    return f"""
SELECT {key}, slot, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM (
  SELECT {key}, CAST((xor({HASH}, (i * 31)::BIGINT) & 2147483647) % 64 AS BIGINT) AS slot, sum(24 + least(length(tok), 16)) / 24.0 AS w
  FROM (SELECT {key}, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS i FROM (
    SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9._/-]+'), lambda t: t <> '') AS toks FROM {source}) a) b
  GROUP BY ALL) c"""


SQL["document_embeddings"] = f"SELECT doc_id, slot, round(weight, 6) AS weight FROM ({embedded('documents', 'doc_id', 'text')}) e"
SQL["document_token_hashes"] = f"""
SELECT tok AS token, {HASH} AS hash FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9._/-]+'), lambda t: t <> '')) AS tok FROM documents) d"""
SQL["normalized_vectors"] = """
SELECT vec_id, unnest(range(64)) AS slot, unnest(list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6))) AS value
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e"""
SQL["vector_texts"] = """
SELECT vec_id, concat('[', array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: printf('%.6f', x)), ','), ']') AS text FROM embeddings"""


def nearest_sql(on: str) -> str:
    return f"""
WITH u AS MATERIALIZED (SELECT vec_id, CAST(CAST(embedding AS DOUBLE[]) AS DOUBLE[64]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(array_cosine_similarity(a.v, b.v), 9) AS score FROM u a JOIN u b ON {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s)
SELECT query_id, id, round(score, 6) AS score, position FROM r WHERE position <= 5"""


SQL["nearest_vectors"] = nearest_sql("true")
SQL["nearest_earlier_vectors"] = nearest_sql("b.vec_id < a.vec_id")

# ---- incidents ------------------------------------------------------------

part("anomalies", ("summaries", "alerts"), f"""
SELECT s.* FROM {as_of("(SELECT * FROM summaries WHERE is_anomaly)", 'alerts', 10,
  "{'ts': e.ts, 'service': e.service, 'category': e.category, 'score': e.score, 'level': e.level, 'message': e.message, 'explanation': e.explanation, 'status': e.status}",
  'event_ts ord', 'window_end')} s""")
part("drafts", ("draft_replies",), r"""
SELECT window_start, reply, CASE WHEN json_valid(body) THEN body END AS b
FROM (SELECT window_start, reply, nullif(regexp_extract(reply, '(?s)\{.*\}'), '') AS body FROM draft_replies) r""")
part("drafted", ("anomalies", "drafts"), f"""
SELECT a.*, CASE WHEN b IS NULL THEN {q(V.DRAFT_TITLE)} ELSE coalesce(b->>'title', {q(V.DRAFT_REPLY_TITLE)}) END AS d_title,
  CASE WHEN reply IS NULL THEN {q(V.DRAFT_NO_REVIEWER_IMPACT)} WHEN b IS NULL THEN {q(V.DRAFT_BAD_REPLY_IMPACT)} ELSE coalesce(b->>'impact', '') END AS d_impact,
  CASE WHEN reply IS NULL THEN [{q(V.DRAFT_NO_REVIEWER_TIMELINE[0])}] WHEN b IS NULL THEN []::VARCHAR[] ELSE {text_list("b->'timeline'")} END AS d_timeline,
  CASE WHEN reply IS NULL THEN [{q(V.DRAFT_NO_REVIEWER_EVIDENCE[0])}] WHEN b IS NULL THEN [reply] ELSE {text_list("b->'evidence'")} END AS d_evidence,
  CASE WHEN reply IS NULL THEN [{q(V.DRAFT_NO_REVIEWER_ACTIONS[0])}] WHEN b IS NULL THEN [{q(V.DRAFT_BAD_REPLY_ACTIONS[0])}] ELSE {text_list("b->'recommended_actions'")} END AS d_actions
FROM anomalies a LEFT JOIN drafts USING (window_start)""")
part("merged", ("drafted",), f"""
SELECT *, list_concat(list_concat(top_signals, d_evidence), list_transform(seen[1:3], lambda a: concat(a.service, ': ', a.message))) AS all_evidence,
  list_concat(recommended_actions, d_actions) AS all_actions FROM drafted""")
part("reports", ("merged",), f"""
SELECT sha256(CAST(to_json([{iso('window_end')}, category, severity, summary]) AS VARCHAR)) AS id, window_end AS event_ts, {iso('window_end')} AS ts,
  CASE WHEN regexp_matches(d_title, '^[\\s\\p{{Z}}]*$') THEN concat(replace(category, '_', ' '), ' incident') ELSE d_title END AS title, severity, category, summary,
  CASE WHEN regexp_matches(d_impact, '^[\\s\\p{{Z}}]*$') THEN concat('Incident affects ', array_to_string(services_top, ', '), '.') ELSE d_impact END AS impact,
  CASE WHEN len(d_timeline) > 0 THEN d_timeline ELSE [{q(V.DEFAULT_TIMELINE_FIRST)}, concat('Category=', category, ', severity=', severity)] END AS timeline,
  {distinct_in_order('all_evidence')} AS evidence, {distinct_in_order('all_actions')} AS recommended_actions,
  array_to_string(list_concat([summary], top_signals), ' ') AS query_text FROM merged""")
part("report_texts", ("reports",), """
SELECT id, event_ts, concat_ws(' ', title, summary, impact, category, severity, array_to_string(timeline, ' '), array_to_string(evidence, ' '),
  array_to_string(recommended_actions, ' ')) AS text FROM reports""")
part("report_vectors", ("report_texts",), embedded("report_texts", "id", "text"))
part("query_vectors", ("reports",), embedded("reports", "id", "query_text"))
part("prior", ("reports", "report_vectors", "query_vectors"), """
SELECT query_id, list(id ORDER BY rk) AS ids FROM (
  SELECT p.query_id, p.id, row_number() OVER (PARTITION BY p.query_id ORDER BY round(coalesce(score, 0), 9) DESC, p.id) AS rk
  FROM (SELECT a.id AS query_id, b.id FROM reports a JOIN reports b ON b.event_ts < a.event_ts) p
  LEFT JOIN (SELECT x.id AS query_id, y.id, sum(x.weight * y.weight) AS score FROM query_vectors x JOIN report_vectors y USING (slot) GROUP BY ALL) d
    ON p.query_id = d.query_id AND p.id = d.id) r WHERE rk <= 3 GROUP BY query_id""")
part("incidents", ("reports", "prior"), """
SELECT r.*, coalesce(ids, []::VARCHAR[]) AS similar_incident_ids FROM reports r LEFT JOIN prior ON r.id = prior.query_id""")
part("saves", (), "SELECT concat('r', user_id) AS id, event_type AS title, event_id AS version FROM events")

SQL["incident_contexts"] = with_(("anomalies",), f"""
SELECT {iso('window_end')} AS window_end, CAST(to_json({{'summary': {SUMMARY_STRUCT}, 'alerts': seen[1:8]}}) AS VARCHAR) AS context FROM anomalies""")
REPORT_FLAT = f"id, ts, title, severity, category, summary, impact, {joined('timeline')} AS timeline, {joined('evidence')} AS evidence, {joined('recommended_actions')} AS recommended_actions, {joined('similar_incident_ids')} AS similar_incident_ids"
SQL["incident_reports"] = with_(("incidents",), f"SELECT {REPORT_FLAT}, {iso('event_ts')} AS event_ts FROM incidents")
SQL["incident_embeddings"] = with_(("report_vectors",), "SELECT id, slot, round(weight, 6) AS weight FROM report_vectors")
SQL["unreported_anomalies"] = with_(("summaries",), f"""
SELECT DISTINCT {iso('window_end')} AS window_end, category, severity, summary FROM summaries WHERE is_anomaly AND hour(window_end) % 2 <> 0""")
SQL["similar_incidents"] = with_(("incidents", "report_vectors"), f"""
, texts AS MATERIALIZED (SELECT DISTINCT regexp_replace(message, '[0-9]+', 'N', 'g') AS query_id FROM logs),
text_vectors AS MATERIALIZED ({embedded('texts', 'query_id', 'query_id')}),
scores AS (SELECT x.query_id, y.id, sum(x.weight * y.weight) AS score FROM text_vectors x JOIN report_vectors y USING (slot) GROUP BY ALL),
ranked AS (SELECT t.query_id, i.*, round(coalesce(s.score, 0), 9) AS score,
    row_number() OVER (PARTITION BY t.query_id ORDER BY round(coalesce(s.score, 0), 9) DESC, i.id) AS position
  FROM texts t CROSS JOIN incidents i LEFT JOIN scores s ON s.query_id = t.query_id AND s.id = i.id)
SELECT query_id, position, id, ts, title, summary, severity, category, round(score, 6) AS score FROM ranked WHERE position <= 5""")
SQL["incident_table_rows"] = with_(("incidents",), f"""
SELECT id, ts, title, severity, category, summary, impact, {joined('timeline')} AS timeline,
  CASE WHEN hour(event_ts) % 4 = 0 THEN '' ELSE {joined('evidence')} END AS evidence, {joined('recommended_actions')} AS recommended_actions,
  {joined('similar_incident_ids')} AS similar_incident_ids FROM incidents""")
SQL["merged_incidents"] = with_(("saves",), """
SELECT id, title, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rk FROM saves) s WHERE rk = 1""")
SQL["newest_saved_incidents"] = with_(("saves",), """
SELECT id, title, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rk FROM saves) s WHERE rk = 1
ORDER BY version DESC LIMIT 40""")
SQL["latest_incidents"] = with_(("incidents",), "SELECT id, ts, title FROM incidents ORDER BY event_ts DESC, id DESC LIMIT 10")
SQL["stored_incidents"] = with_(("incidents",), "SELECT id, ts, title, severity, category FROM incidents")
SQL["incident_by_id"] = with_(("incidents",), "SELECT id, ts, title, severity, category FROM incidents ORDER BY event_ts DESC, id DESC LIMIT 1")

# ---- latest rows ----------------------------------------------------------

SQL["latest_alerts"] = with_(("alerts",), "SELECT ord, ts, service, category FROM alerts ORDER BY event_ts DESC, ord DESC LIMIT 20")
SQL["latest_summary"] = with_(("summaries",), f"SELECT {iso('window_end')} AS window_end, total_logs, summary FROM summaries ORDER BY summaries.window_end DESC LIMIT 1")
SQL["latest_metrics"] = with_(("metrics",), f"""
SELECT {iso('window_end')} AS window_end, window_sec, service, total_count FROM metrics ORDER BY metrics.window_end DESC, window_sec DESC, service DESC LIMIT 100""")
SQL["latest_spans"] = with_(("spans",), "SELECT ord, span_id, name, round(duration_ms, 6) AS duration_ms FROM spans ORDER BY event_ts DESC, ord DESC LIMIT 100")
SQL["span_errors"] = with_(("spans",), "SELECT ord, 'logs.raw' AS topic, CASE WHEN duration_ms > 1000 THEN concat('slow ', name) END AS error FROM spans")

# ---- root cause -----------------------------------------------------------

part("requests", ("summaries",), "SELECT DISTINCT unnest([window_end, window_end - INTERVAL 4 HOUR]) AS tick FROM summaries")
part("g_summary", ("requests", "summaries"), f"""
SELECT tick, seen[1] AS s FROM {as_of('requests', 'summaries', 1,
  "{'services_top': e.services_top, 'is_anomaly': e.is_anomaly, 'severity': e.severity, 'category': e.category, 'top_signals': e.top_signals}",
  'window_end window_sec', 'tick')} x""")
part("g_alerts", ("requests", "alerts"), f"""
SELECT tick, seen FROM {as_of('requests', 'alerts', 20, "{'label': concat(e.service, ':', e.category), 'weight': least(1.0, greatest(0.0, e.score))}", 'event_ts ord', 'tick')} x""")
part("g_spans", ("requests", "spans"), f"""
SELECT tick, seen FROM {as_of('requests', 'spans', 20, "{'label': concat(e.service, ':', e.name), 'd': e.duration_ms}", 'event_ts ord', 'tick')} x""")
part("g_metrics", ("requests", "metrics"), f"""
SELECT tick, seen FROM {as_of('requests', 'metrics', 20,
  "{'label': concat(e.service, ' err=', e.error_count, '/', e.total_count), 'weight': least(1.0, greatest(0.15, e.error_count::DOUBLE / e.total_count))}",
  'window_end window_sec service', 'tick')} x""")
part("g_reports", ("requests", "reports"), f"""
SELECT tick, seen FROM {as_of('requests', 'reports', 5, "{'label': e.title}", 'event_ts id', 'tick')} x""")
part("g_nodes", ("g_summary", "g_alerts", "g_spans", "g_metrics", "g_reports"), """
SELECT tick, 'n0' AS id, """ + q(V.GRAPH_EMPTY_LABEL) + """ AS label, 'state' AS type, 0.2 AS weight, '' AS edge FROM g_summary WHERE s IS NULL
UNION ALL SELECT tick, 'incident', concat(s.category, ' (', s.severity, ')'), 'incident', 1.0, '' FROM g_summary WHERE s IS NOT NULL
UNION ALL SELECT tick, concat('svc-', i), l, 'service', 0.95 - i * 0.08, 'affected' FROM (
  SELECT tick, unnest(s.services_top) AS l, generate_subscripts(s.services_top, 1) - 1 AS i FROM g_summary WHERE s IS NOT NULL) a
UNION ALL SELECT tick, concat('sig-', i), l, 'signal', 0.72, 'supports' FROM (
  SELECT tick, unnest(s.top_signals[1:5]) AS l, generate_subscripts(s.top_signals[1:5], 1) - 1 AS i FROM g_summary WHERE s IS NOT NULL) a
UNION ALL SELECT tick, concat('alert-', i), l.label, 'alert', l.weight, 'evidence' FROM (
  SELECT tick, unnest(seen[1:6]) AS l, generate_subscripts(seen[1:6], 1) - 1 AS i FROM g_alerts SEMI JOIN (SELECT tick FROM g_summary WHERE s IS NOT NULL) USING (tick)) a
UNION ALL SELECT tick, concat('trace-', i), label, 'trace', least(1.0, greatest(0.15, d / 2500.0)), 'observed' FROM (
  SELECT tick, l.label, l.d, row_number() OVER (PARTITION BY tick ORDER BY l.d DESC, p) - 1 AS i FROM (
    SELECT tick, unnest(seen) AS l, generate_subscripts(seen, 1) AS p FROM g_spans SEMI JOIN (SELECT tick FROM g_summary WHERE s IS NOT NULL) USING (tick)) a) b WHERE i < 6
UNION ALL SELECT tick, concat('metric-', i), l.label, 'metric', l.weight, 'correlates' FROM (
  SELECT tick, unnest(seen[1:6]) AS l, generate_subscripts(seen[1:6], 1) - 1 AS i FROM g_metrics SEMI JOIN (SELECT tick FROM g_summary WHERE s IS NOT NULL) USING (tick)) a
UNION ALL SELECT tick, 'report-0', seen[1].label, 'report', 0.6, 'matches' FROM g_reports SEMI JOIN (SELECT tick FROM g_summary WHERE s IS NOT NULL) USING (tick) WHERE len(seen) > 0""")
SQL["root_cause_nodes"] = with_(("g_nodes",), f"SELECT {iso('tick')} AS incident_id, id, label, type, round(weight, 6)::DOUBLE AS weight FROM g_nodes")
SQL["root_cause_edges"] = with_(("g_nodes",), f"SELECT {iso('tick')} AS incident_id, id AS \"from\", 'incident' AS \"to\", edge AS label FROM g_nodes WHERE edge <> ''")
SQL["root_cause_headers"] = with_(("g_summary", "g_alerts", "g_spans", "g_metrics"), f"""
SELECT {iso('tick')} AS incident_id, {iso('tick')} AS ts, CASE WHEN s IS NULL THEN {q(V.GRAPH_EMPTY_TITLE)} ELSE {q(V.GRAPH_TITLE)} END AS title,
  CASE WHEN s IS NULL THEN 0.2 ELSE round(least(0.95, CASE WHEN s.is_anomaly THEN 0.35 ELSE 0.1 END + least(len(a.seen), 5) * 0.05
    + least(len(t.seen), 5) * 0.04 + least(len(m.seen), 5) * 0.03), 6) END::DOUBLE AS confidence,
  CASE WHEN s IS NULL THEN {q(V.GRAPH_EMPTY_HYPOTHESIS)} ELSE CASE s.category {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.HYPOTHESES.items())}
    ELSE {q(V.HYPOTHESIS_OTHER)} END END AS hypothesis
FROM g_summary JOIN g_alerts a USING (tick) JOIN g_spans t USING (tick) JOIN g_metrics m USING (tick)""")

# ---- dashboard ------------------------------------------------------------

SQL["dashboard_kpis"] = with_(("logs", "alerts"), """
SELECT CAST(floor(100.0 * count(*) FILTER (WHERE level = 'ERROR') / count(*) + 0.5) AS BIGINT) AS error_rate,
  CAST(quantile_disc(coalesce(latency_ms, 0), 0.95) AS BIGINT) AS p95_latency_ms, CAST(floor(count(*) / 20.0 + 0.5) AS BIGINT) AS throughput,
  (SELECT count(*) FROM alerts WHERE status = 'NEW') AS active_alerts
FROM (SELECT * FROM logs ORDER BY event_ts DESC, ord DESC LIMIT 100) l""")
SQL["active_alerts"] = with_(("alerts",), "SELECT ord, service, category FROM alerts WHERE category <> 'security'")
SQL["distinct_services"] = with_(("logs",), "SELECT DISTINCT service FROM logs")
SQL["search_recent_logs"] = with_(("logs", "alerts"), """
SELECT ord, ts, service, level, message FROM (SELECT * FROM logs ORDER BY event_ts DESC, ord DESC LIMIT 600) l
WHERE level = 'INFO' AND contains(lower(concat_ws(' ', ts, service, level, message, '')), 'query')
  AND EXISTS (SELECT 1 FROM alerts a WHERE a.service = l.service AND abs(epoch_ms(a.event_ts) - epoch_ms(l.event_ts)) < 60000)""")
SQL["search_all_logs"] = with_(("logs",), """
SELECT ord, ts, service, level, message FROM logs WHERE service = 'db' AND contains(lower(concat_ws(' ', ts, service, level, message, '')), 'heap at 4')""")


def record_line(name: str, fields: list[tuple[str, str]]) -> str:
    inner = ", ', ', ".join(f"'{label}=', coalesce(CAST({value} AS VARCHAR), 'null')" for label, value in fields)
    return f"concat('{name}(', {inner}, ')')"


def listed(c: str) -> str:
    return f"concat('[', array_to_string({c}, ', '), ']')"


LOG_LINE = record_line("LogEvent", [(a, b) for a, b in (("ts", "ts"), ("service", "service"), ("level", "level"), ("message", "message"), ("latencyMs", "latency_ms"), ("stacktrace", "stacktrace"))])
ALERT_LINE = record_line("AlertEvent", [(c, c) for c in ("ts", "service", "category", "score", "level", "message", "explanation", "status")])
SUMMARY_LINE = record_line("SummaryEvent", [
    ("ts", iso("window_end")), ("windowSec", "window_sec"), ("totalLogs", "total_logs"), ("errorCount", "error_count"), ("warnCount", "warn_count"),
    ("servicesTop", listed("services_top")), ("isAnomaly", "is_anomaly"), ("severity", "severity"), ("category", "category"), ("summary", "summary"),
    ("topSignals", listed("top_signals")), ("recommendedActions", listed("recommended_actions"))])
part("last_summary", ("summaries",), f"SELECT {SUMMARY_LINE} AS t FROM summaries ORDER BY window_end DESC LIMIT 1")
part("last_alerts", ("alerts",), f"SELECT list({ALERT_LINE} ORDER BY event_ts DESC, ord DESC) AS l FROM (SELECT * FROM alerts ORDER BY event_ts DESC, ord DESC LIMIT 5) a")
part("last_logs", ("logs",), f"SELECT list({LOG_LINE} ORDER BY event_ts, ord) AS l FROM (SELECT * FROM logs ORDER BY event_ts DESC, ord DESC LIMIT 10) a")
part("service_alerts", ("alerts",), f"""
SELECT service, list(line ORDER BY rk) AS l FROM (SELECT service, {ALERT_LINE} AS line, row_number() OVER (PARTITION BY service ORDER BY event_ts DESC, ord DESC) AS rk FROM alerts) a
WHERE rk <= 3 GROUP BY service""")
HEAD = q("\n".join(V.ASK_HEADER) + "\nQuestion: ").replace("\n", "' || chr(10) || '")
SQL["question_prompts"] = with_(("logs", "last_summary", "last_alerts", "last_logs", "service_alerts"), f"""
SELECT ord, mode, concat({HEAD}, 'What about ', message, '?', chr(10), CASE WHEN mode = 'overview'
  THEN concat('Latest summary: ', (SELECT t FROM last_summary), chr(10), 'Recent alerts: ', (SELECT {listed('l')} FROM last_alerts), chr(10),
    'Recent logs: ', (SELECT {listed('l')} FROM last_logs), chr(10))
  ELSE concat('Target log: ', CASE WHEN ord % 8 = 1 THEN 'null' ELSE {LOG_LINE} END, chr(10), 'Related summary: ', (SELECT t FROM last_summary), chr(10),
    'Related alerts: ', CASE WHEN ord % 8 = 1 THEN (SELECT {listed('l[1:3]')} FROM last_alerts) ELSE coalesce({listed('s.l')}, '[]') END, chr(10)) END) AS prompt
FROM (SELECT *, CASE WHEN ord % 4 = 0 THEN 'overview' ELSE 'log' END AS mode FROM logs WHERE ord % 10 <> 9) x LEFT JOIN service_alerts s USING (service)""")
SQL["feed_messages"] = with_(("logs", "alerts", "summaries"), f"""
SELECT {iso('event_ts')} AS event_ts, type, concat('{{"serverTs":"t","payload":{{"type":"', type, '","data":', data, '}}}}') AS message FROM (
  SELECT event_ts, 'log' AS type, CAST(to_json({LOG_STRUCT}) AS VARCHAR) AS data FROM logs
  UNION ALL SELECT event_ts, 'alert', CAST(to_json({ALERT_STRUCT}) AS VARCHAR) FROM alerts
  UNION ALL SELECT window_end, 'summary', CAST(to_json({SUMMARY_STRUCT}) AS VARCHAR) FROM summaries) f""")
SQL["feed_snapshot"] = with_(("logs", "alerts", "summaries"), f"""
SELECT 'snapshot' AS type, CAST(to_json({{
  'logs': (SELECT list({LOG_STRUCT} ORDER BY event_ts, ord) FROM (SELECT * FROM logs ORDER BY event_ts DESC, ord DESC LIMIT 500) l),
  'alerts': (SELECT list({ALERT_STRUCT} ORDER BY event_ts, ord) FROM (SELECT * FROM alerts ORDER BY event_ts DESC, ord DESC LIMIT 200) a),
  'summaries': (SELECT list({SUMMARY_STRUCT} ORDER BY summaries_.window_end) FROM (SELECT * FROM summaries ORDER BY window_end DESC LIMIT 60) summaries_)}}) AS VARCHAR) AS data""")


def throttled(rows: str, gap_ms: int) -> str:
    """Sequential fold per scope: (scope, n) in time order, remembering the last sent."""
    return f"""
WITH RECURSIVE {rows},
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY at_ms, tie) AS n FROM notices),
fold AS (SELECT scope, n, tie, true AS sent, at_ms AS last_ms, k AS last_k FROM numbered WHERE n = 1
  UNION ALL
  SELECT r.scope, r.n, r.tie, NOT (r.at_ms - f.last_ms < {gap_ms} AND r.k = f.last_k),
    CASE WHEN r.at_ms - f.last_ms < {gap_ms} AND r.k = f.last_k THEN f.last_ms ELSE r.at_ms END,
    CASE WHEN r.at_ms - f.last_ms < {gap_ms} AND r.k = f.last_k THEN f.last_k ELSE r.k END
  FROM fold f JOIN numbered r ON r.scope = f.scope AND r.n = f.n + 1)"""


_summaries = with_(("summaries",), "")[len("WITH "):]
SQL["notifications"] = throttled(
    _summaries + """, notices AS (SELECT 0 AS scope, epoch_ms(window_end) AS at_ms, window_start AS tie, concat_ws('|', category, severity) AS k, category, severity
  FROM summaries WHERE is_anomaly)""", 5 * HOUR * 1000) + f"""
SELECT {iso('window_start')} AS window_start, s.category, s.severity FROM fold JOIN summaries s ON s.window_start = fold.tie WHERE sent"""
SQL["scoped_notifications"] = throttled(
    """notices AS (SELECT user_id % 3 AS scope, epoch_ms(ts) AS at_ms, event_id AS tie, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS k FROM events)""",
    HOUR * 1000) + "\nSELECT tie AS event_id FROM fold WHERE sent"

# ---- reviewers ------------------------------------------------------------

SQL["reviewer_log_reviews"] = with_(("reviews", "rawlogs"), f"""
SELECT ord, CASE WHEN usable THEN n % 2 = 1 ELSE is_anomaly END AS is_anomaly, CASE WHEN usable THEN (n % 10) / 10.0 ELSE score END AS score,
  CASE WHEN usable THEN 'latency' ELSE category END AS category,
  CASE WHEN usable THEN concat('length ', n) ELSE concat(CASE WHEN n % 13 = 0 THEN {q(V.NOTE_FAILED_CALL)} ELSE {q(V.NOTE_BAD_REPLY)} END,
    CASE WHEN is_text THEN {q(V.NOTE_TEXT_SUFFIX)} ELSE '' END) END AS explanation
FROM (SELECT r.*, length(x.raw) AS n, length(x.raw) % 13 <> 0 AND length(x.raw) % 5 <> 0 AS usable FROM reviews r JOIN rawlogs x ON r.ord = x.ord) y""")
part("payloads", ("aggregates", "window_logs"), f"""
SELECT a.*, length(CAST(to_json({{'ts': {iso('window_end')}, 'window_sec': window_sec,
  'counts': {{'total': total_logs, 'error': error_count, 'warn': warn_count}}, 'services_top': services_top, 'sample_logs': sample}}) AS VARCHAR)) AS n
FROM aggregates a JOIN (SELECT make_timestamp(ws * 1000000) AS window_start, list({LOG_STRUCT} ORDER BY ord) AS sample
  FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY ord DESC) AS rk FROM window_logs) r WHERE rk <= 10 GROUP BY ws) s USING (window_start)""")
part("window_verdicts", ("payloads",), f"""
SELECT *, n % 7 <> 0 AND n % 3 <> 0 AS usable,
  CASE WHEN n % 7 = 0 THEN {q(V.WINDOW_FAILED_CALL_SUMMARY)} WHEN n % 3 = 0 THEN {q(V.WINDOW_BAD_REPLY_SUMMARY)} ELSE concat('payload ', n) END AS summary,
  CASE WHEN n % 7 = 0 THEN '' WHEN n % 3 = 0 THEN concat('unsure about ', n) ELSE 'a | b' END AS top_signals FROM payloads""")
SQL["reviewer_window_reviews"] = with_(("window_verdicts",), f"""
SELECT {iso('window_start')} AS window_start, usable AS is_anomaly, CASE WHEN usable THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN usable THEN 'security' ELSE 'other' END AS category, summary, top_signals FROM window_verdicts""")
SQL["drafter_incident_reports"] = with_(("anomalies",), f"""
SELECT {iso('window_end')} AS event_ts, CASE WHEN failed THEN {q(V.DRAFT_TITLE)} ELSE concat('Draft of ', n) END AS title,
  CASE WHEN failed THEN {q(V.DRAFT_FAILED_CALL_IMPACT)} ELSE concat('Incident affects ', array_to_string(services_top, ', '), '.') END AS impact,
  CASE WHEN failed THEN concat({q(V.DEFAULT_TIMELINE_FIRST)}, ' | Category=', category, ', severity=', severity) ELSE concat('t', n % 4) END AS timeline,
  {joined(distinct_in_order('all_evidence'))} AS evidence, {joined(distinct_in_order('all_actions'))} AS recommended_actions
FROM (SELECT *, list_concat(list_concat(top_signals, CASE WHEN failed THEN [{q(V.DRAFT_FAILED_CALL_EVIDENCE[0])}] ELSE ['e'] END),
    list_transform(seen[1:3], lambda a: concat(a.service, ': ', a.message))) AS all_evidence,
    list_concat(recommended_actions, CASE WHEN failed THEN [{q(V.DRAFT_FAILED_CALL_ACTIONS[0])}] ELSE ['look'] END) AS all_actions
  FROM (SELECT *, n % 11 = 0 AS failed FROM (
    SELECT *, length(CAST(to_json({{'summary': {SUMMARY_STRUCT}, 'alerts': seen[1:8]}}) AS VARCHAR)) AS n FROM anomalies) c) d) e""")
SQL["answered_questions"] = f"""
SELECT ord, prompt, length(prompt) % 17 = 0 AS reply_failed,
  CASE WHEN length(prompt) % 17 = 0 THEN {q(V.ANSWER_FAILED_CALL)} WHEN length(prompt) % 9 = 0 THEN {q(V.ANSWER_BLANK)}
    ELSE concat('Answer of ', length(prompt)) END AS answer
FROM ({SQL["question_prompts"].replace("'What about ', message, '?'", "'What about ', regexp_replace(message, '[0-9]+', 'N', 'g'), '?'")}) asked"""

# ---- Kafka shapes ---------------------------------------------------------

SQL["kafka_log_lines"] = with_(("parsed", "rawlogs"), f"""
SELECT {iso('"timestamp"')} AS "timestamp", "partition", "offset",
  row_number() OVER (PARTITION BY "timestamp" ORDER BY "partition", "offset") AS place, service, level, message
FROM (SELECT p.*, date_trunc('hour', r.event_ts) AS "timestamp", p.ord % 3 AS "partition", p.ord // 3 AS "offset"
  FROM parsed p JOIN rawlogs r ON p.ord = r.ord) x""")
SQL["kafka_log_messages"] = with_(("logs",), f"""
SELECT CAST(NULL AS VARCHAR) AS key, CAST(to_json({LOG_STRUCT}) AS VARCHAR) AS value, ts, service, level, message, CAST(latency_ms AS BIGINT) AS latency_ms FROM logs""")

# ---- streams: the windows that a watermark one longest window behind closes ----

SQL["streamed_service_metrics"] = SQL["service_metrics"] + f" WHERE metrics.window_end <= (SELECT max(window_end) FROM metrics) - INTERVAL {6 * HOUR} SECOND"
SQL["streamed_alerts"] = SQL["alerts"]
SQL["streamed_summaries"] = with_(("window_verdicts",), f"""
SELECT {iso('window_start')} AS window_start, {iso('window_end')} AS window_end, total_logs, error_count, {joined('services_top')} AS services_top, summary, top_signals
FROM window_verdicts WHERE window_verdicts.window_end <= (SELECT max(window_end) FROM window_verdicts) - INTERVAL {3 * HOUR} SECOND""")
SQL["streamed_new_summaries"] = with_(("summaries",), f"""
SELECT DISTINCT {iso('window_end')} AS window_end, category, severity, summary FROM summaries WHERE is_anomaly""")
