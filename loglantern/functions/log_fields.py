"""Columns of the three-tier log parse and of the message hints.

Tier 1  an object with all four required fields, correctly typed
Tier 2  any other JSON value; per-field fallbacks, level upper-cased
Tier 3  text that is not JSON; the whole line is the message

Duplicate aliases inside one object are resolved by the fixed precedence of
the name lists in every tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loglantern import fixed_values as V
from loglantern.functions import json_text as J
from loglantern.functions.binding import computed_once
from loglantern.functions.net import normalize_ip

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
_INSTANT = r"(?i)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{0,9})?(Z|[+-]\d{2}:\d{2})$"
_ALL_NAMES = (
    *V.TS_NAMES, *V.SERVICE_NAMES, *V.LEVEL_NAMES, *V.MESSAGE_NAMES, *V.LATENCY_NAMES, *V.STACKTRACE_NAMES,
)
JSON_COLUMN = "_json"
IS_JSON_COLUMN = "_is_json"


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def instant(text: Column) -> Column:
    """ISO-8601 instant or null. The guard keeps out dates and bare numbers the cast accepts."""
    return F.when(text.rlike(_INSTANT), F.upper(text).try_cast("timestamp"))


def with_json(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the shared typed parse of the raw line, once for parsing and review."""
    parsed = df.withColumn(JSON_COLUMN, J.parse_object(F.col(raw), _ALL_NAMES))
    line = F.coalesce(F.col(raw), F.lit(""))
    return parsed.withColumn(IS_JSON_COLUMN, J.is_json(line, F.col(JSON_COLUMN)))


def with_log_fields(df: DataFrame, raw: str = "raw", ingest_ts: Column | None = None) -> DataFrame:
    """Add ts, event_ts, service, level, message, latency_ms, stacktrace, parse_tier.

    ``ingest_ts`` (TIMESTAMP) stands in for a missing time; it defaults to the
    current time, which in a stream is fixed per micro-batch.
    """
    line, j = F.coalesce(F.col(raw), F.lit("")), F.col(JSON_COLUMN)
    now = iso_text(F.current_timestamp() if ingest_ts is None else ingest_ts)
    names = {
        "_ts": V.TS_NAMES,
        "_service": V.SERVICE_NAMES,
        "_level": V.LEVEL_NAMES,
        "_message": V.MESSAGE_NAMES,
        "_stacktrace": V.STACKTRACE_NAMES,
        "_latency": V.LATENCY_NAMES,
    }
    found = df.withColumns({c: J.first_field(line, j, n) for c, n in names.items()})
    texts = ("_ts", "_service", "_level", "_message", "_stacktrace")
    checked = found.withColumns({f"{c}_nested": J.is_container(line, F.col(c)) for c in texts})

    complete = J.is_object(j) & _latency_is_typed(line, F.col("_latency"))
    for c in texts:
        complete = complete & ~F.col(f"{c}_nested")
        if c != "_stacktrace":
            complete = complete & F.col(c).isNotNull()
    tiered = checked.withColumn(
        "parse_tier", F.when(complete, 1).when(F.col(IS_JSON_COLUMN), 2).otherwise(3)
    )

    tier = F.col("parse_tier")

    def text(c: str) -> Column:
        value = F.when(F.col(f"{c}_nested"), F.lit("")).otherwise(F.col(c)["value"])
        return F.when(tier < 3, value)

    level = F.coalesce(text("_level"), F.lit(V.DEFAULT_LEVEL))
    latency = F.col("_latency")["value"]
    blank_latency = (tier == 1) & (F.trim(latency) == "")
    parsed = computed_once(
        tiered.withColumn("_ts_text", F.coalesce(text("_ts"), now)),
        {
            "ts": F.col("_ts_text"),
            "event_ts": instant(F.col("_ts_text")),
            "service": F.coalesce(text("_service"), F.lit(V.DEFAULT_SERVICE)),
            "level": F.when(tier > 1, F.upper(level)).otherwise(level),
            "message": F.coalesce(text("_message"), line),
            "latency_ms": F.when((tier < 3) & ~F.coalesce(blank_latency, F.lit(False)), J.int_value(latency)),
            "stacktrace": text("_stacktrace"),
        },
    )
    return parsed.drop(*names, *[f"{c}_nested" for c in texts], "_ts_text")


def _latency_is_typed(line: Column, field: Column) -> Column:
    """Whether the strict reader would take the latency as an integer."""
    value = field["value"]
    return (
        field.isNull()
        | (F.trim(value) == "")
        | (value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("int").isNotNull())
        | (value.try_cast("double").isNotNull() & value.try_cast("double").try_cast("int").isNotNull()
           & J.is_number(line, field))
    )


def message_ip(message: Column) -> Column:
    """Canonical address of the first ``ip=`` in the message, or null."""
    found = F.regexp_extract(message, V.IP_PATTERN, 1)
    return F.when(message.contains("ip=") & (found != ""), normalize_ip(found))


def message_endpoint(message: Column) -> Column:
    """Path of the first HTTP-like request in the message, or null."""
    return F.nullif(F.regexp_extract(message, V.ENDPOINT_PATTERN, 2), F.lit(""))


def is_level(level: Column, name: str) -> Column:
    """Level test ignoring case."""
    return F.upper(level) == name
