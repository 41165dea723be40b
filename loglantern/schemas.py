"""Explicit schemas of the records; nothing is ever inferred."""

from pyspark.sql import types as T

_S, _L, _D, _I, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.TimestampType()
_LIST = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW_LOG = _struct(("ord", _L), ("raw", _S))

LOG = _struct(
    ("ord", _L), ("event_ts", _TS), ("ts", _S), ("service", _S), ("level", _S),
    ("message", _S), ("latency_ms", _I), ("stacktrace", _S),
)

ALERT = _struct(
    ("ord", _L), ("event_ts", _TS), ("ts", _S), ("service", _S), ("category", _S), ("score", _D),
    ("level", _S), ("message", _S), ("explanation", _S), ("status", _S),
)

METRIC = _struct(
    ("window_start", _TS), ("window_end", _TS), ("window_sec", _I), ("ts", _S), ("service", _S),
    ("total_count", _L), ("error_count", _L), ("warn_count", _L), ("avg_latency_ms", _D),
    ("max_latency_ms", _I), ("endpoint_hint", _S), ("failed_ips", _LIST),
)

# The message form of a metric; names as on the metric topic.
METRIC_MESSAGE = _struct(
    ("ts", _S), ("windowSec", _I), ("service", _S), ("totalCount", _L), ("errorCount", _L),
    ("warnCount", _L), ("avgLatencyMs", _D), ("maxLatencyMs", _I), ("endpointHint", _S),
    ("failedIpsTop", _LIST),
)

SUMMARY = _struct(
    ("window_start", _TS), ("window_end", _TS), ("window_sec", _I), ("total_logs", _L),
    ("error_count", _L), ("warn_count", _L), ("services_top", _LIST), ("is_anomaly", T.BooleanType()),
    ("severity", _S), ("category", _S), ("summary", _S), ("top_signals", _LIST),
    ("recommended_actions", _LIST),
)

INCIDENT = _struct(
    ("id", _S), ("event_ts", _TS), ("ts", _S), ("title", _S), ("severity", _S), ("category", _S),
    ("summary", _S), ("impact", _S), ("timeline", _LIST), ("evidence", _LIST),
    ("recommended_actions", _LIST), ("similar_incident_ids", _LIST), ("embedding", T.ArrayType(_D)),
)

SPAN = _struct(
    ("event_ts", _TS), ("ord", _L), ("trace_id", _S), ("span_id", _S), ("parent_span_id", _S),
    ("name", _S), ("service", _S), ("duration_ms", _D), ("attributes", T.MapType(_S, _S)),
)

NODE = _struct(("incident_id", _S), ("id", _S), ("label", _S), ("type", _S), ("weight", _D))
EDGE = _struct(("incident_id", _S), ("from", _S), ("to", _S), ("label", _S))

# Mergeable pre-aggregates of a stream: one row per micro-batch, pane and service.
PANE = _struct(
    ("pane_start", _TS), ("service", _S), ("total", _L), ("errors", _L), ("warns", _L), ("latency_sum", _L),
    ("latency_count", _L), ("latency_max", _I), ("last", _struct(("ord", _L), ("ts", _S))),
    ("last_endpoint", _struct(("ord", _L), ("endpoint", _S))),
    ("ips", T.ArrayType(_struct(("ord", _L), ("ip", _S)))), ("first_ord", _L),
)

# The last logs of each pane.
TAIL = _struct(
    ("pane_start", _TS), ("ord", _L), ("ts", _S), ("service", _S), ("level", _S), ("message", _S),
    ("latency_ms", _I), ("stacktrace", _S),
)


#: Arrival order of Kafka rows.
KAFKA_ORD = _struct(("timestamp", _TS), ("partition", _I), ("offset", _L))


def arrived(kind: T.DataType, order: T.DataType = KAFKA_ORD) -> T.DataType:
    """``kind`` with arrival numbers (ord, first_ord) of the type ``order``."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(arrived(kind.elementType, order), kind.containsNull)
    if not isinstance(kind, T.StructType):
        return kind
    return _struct(*((f.name, order if f.name in ("ord", "first_ord") else arrived(f.dataType, order)) for f in kind.fields))
