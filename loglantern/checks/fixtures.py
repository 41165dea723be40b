"""Log-shaped views over the given tables, one SQL text for both engines.

``logs`` and its companions do not exist as files; they are projections of
``events``. ``{TSTEXT}`` and ``{STR}`` are the only dialect differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglantern.session import configure

HOUR = 3600

LOGS = """
SELECT event_id AS ord, ts AS event_ts, {TSTEXT} AS ts,
  CASE user_id % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'auth' WHEN 2 THEN 'db' WHEN 3 THEN 'worker' ELSE 'web' END AS service,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'warn' ELSE 'INFO' END AS level,
  CASE event_id % 6
    WHEN 0 THEN concat('POST /cart/', user_id % 10, ' 500 IllegalStateException: no stock')
    WHEN 1 THEN concat('gateway: failed login, account locked ip=198.51.100.', user_id % 255)
    WHEN 2 THEN concat('slow query on table stock, key ', user_id)
    WHEN 3 THEN concat('JVM heap at ', event_id % 100, ' percent after gc')
    WHEN 4 THEN 'GET /status/ready 204'
    ELSE concat('tick ', event_id) END AS message,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value * 20) AS INT) END AS latency_ms,
  CAST(NULL AS {STR}) AS stacktrace
FROM events"""

RAWLOGS = """
SELECT ord, event_ts, CASE ord % 5
  WHEN 0 THEN concat('{"ts":"', ts, '","service":"', service, '","level":"', level, '","message":"', message, '","latencyMs":', coalesce(CAST(latency_ms AS {STR}), 'null'), '}')
  WHEN 1 THEN concat('{"timestamp":"', ts, '","app":"', service, '","severity":"', level, '","msg":"', message, '","latency_ms":', coalesce(CAST(latency_ms AS {STR}), 'null'), ',"extra":[1]}')
  WHEN 2 THEN concat('{"ts":"', ts, '","service_name":"', service, '","message":"', message, '"}')
  WHEN 3 THEN concat(ts, ' ', level, ' ', message)
  ELSE concat('{"ts":"', ts, '","service":"', service, '","level":"error","message":"', message, '","latency":"abc"}') END AS raw
FROM logs"""

SPANS = """
SELECT ts AS event_ts, event_id AS ord, md5(CAST(event_id AS {STR})) AS trace_id, left(md5(concat('s', event_id)), 16) AS span_id,
  CAST(NULL AS {STR}) AS parent_span_id, CASE event_type WHEN 'view' THEN 'consume-log' ELSE 'window-analysis' END AS name,
  CASE user_id % 3 WHEN 0 THEN 'backend' WHEN 1 THEN 'gateway' ELSE 'db' END AS service, value * 25 AS duration_ms
FROM events WHERE event_type IN ('view', 'click')"""

WINDOW_REPLIES = """
SELECT ws AS window_start, CASE
    WHEN (day(ws) * 24 + hour(ws)) % 11 = 0 THEN NULL
    WHEN (day(ws) * 24 + hour(ws)) % 7 = 0 THEN concat('I could not decide. errors=', err)
    ELSE concat('Sure: {"is_anomaly":', CASE WHEN err * 10 >= total * 3 THEN 'true' ELSE 'false' END,
      ',"severity":"', CASE WHEN err * 2 >= total THEN 'high' WHEN err * 10 >= total * 3 THEN 'medium' ELSE 'low' END,
      '","category":"', CASE hour(ws) % 4 WHEN 0 THEN 'error_spike' WHEN 1 THEN 'latency' WHEN 2 THEN 'security' ELSE 'resource' END,
      '","summary":"', err, ' errors in ', total, ' logs","top_signals":["errors=', err, '","total=', total,
      '"],"recommended_actions":["check logs"]} done') END AS reply
FROM (SELECT date_trunc('hour', event_ts) AS ws, count(*) AS total, count(CASE WHEN upper(level) = 'ERROR' THEN 1 END) AS err
      FROM logs GROUP BY 1) w"""

# Keyed like the window replies; every pattern of a draft reply occurs.
DRAFT_REPLIES = """
SELECT window_start, CASE
    WHEN (day(window_start) * 24 + hour(window_start)) % 5 = 0 THEN NULL
    WHEN (day(window_start) * 24 + hour(window_start)) % 7 = 0 THEN concat('No draft for day ', day(window_start))
    ELSE concat('Draft {"title":"', CASE WHEN (day(window_start) * 24 + hour(window_start)) % 6 = 0 THEN '  '
        ELSE concat('Errors on day ', day(window_start)) END,
      '","impact":"', CASE hour(window_start) % 3 WHEN 0 THEN '' ELSE 'Some requests fail.' END,
      '","timeline":', CASE hour(window_start) % 4 WHEN 0 THEN '[]' ELSE '["first errors seen","errors rise"]' END,
      ',"evidence":["total=', hour(window_start), '","check hour ', hour(window_start), '","check hour ', hour(window_start),
      '"],"recommended_actions":["check logs","roll back"]} end') END AS reply
FROM window_replies"""

_VIEWS = {"logs": LOGS, "rawlogs": RAWLOGS, "spans": SPANS, "window_replies": WINDOW_REPLIES, "draft_replies": DRAFT_REPLIES}
_NEEDS = {"logs": (), "rawlogs": ("logs",), "spans": (), "window_replies": ("logs",), "draft_replies": ("logs", "window_replies")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the log-shaped views as a DataFrame (times as TIMESTAMP)."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return view_over(events, name)


def view_over(events: DataFrame, name: str) -> DataFrame:
    spark = events.sparkSession
    events.createOrReplaceTempView("loglantern_events")
    text = _VIEWS[name].replace("{TSTEXT}", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")").replace("{STR}", "STRING")
    text = text.replace("FROM events", "FROM loglantern_events")
    for need in _NEEDS[name]:
        view_over(events, need).createOrReplaceTempView(f"loglantern_{need}")
        text = text.replace(f"FROM {need}", f"FROM loglantern_{need}")
    return spark.sql(text)
