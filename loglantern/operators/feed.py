"""The live feed as a tagged union, and its snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loglantern import fixed_values as V
from loglantern.operators.incidents import ALERT_FIELDS, summary_struct
from loglantern.operators.ranking import ALERT_ORDER, SUMMARY_ORDER, latest
from loglantern.operators.summaries import log_struct

_NULLS = {"ignoreNullFields": "false"}


def alert_struct() -> Column:
    return F.struct(*ALERT_FIELDS)


def feed_messages(logs: DataFrame, alerts: DataFrame, summaries: DataFrame) -> DataFrame:
    """(type, data) rows of all three kinds; works on batch and streaming inputs."""

    def tagged(df: DataFrame, kind: str, at: str, record: Column) -> DataFrame:
        return df.select(F.col(at).alias("event_ts"), F.lit(kind).alias("type"), F.to_json(record, _NULLS).alias("data"))

    return (
        tagged(logs, "log", "event_ts", log_struct())
        .unionByName(tagged(alerts, "alert", "event_ts", alert_struct()))
        .unionByName(tagged(summaries, "summary", "window_end", summary_struct()))
    )


def envelope(server_ts: Column, kind: Column, data: Column) -> Column:
    """The message as sent: payload and server time."""
    return F.concat(
        F.lit('{"serverTs":"'), server_ts, F.lit('","payload":{"type":"'), kind, F.lit('","data":'), data, F.lit("}}")
    )


def feed_snapshot(
    logs: DataFrame,
    alerts: DataFrame,
    summaries: DataFrame,
    n_logs: int = V.FEED_LOGS,
    n_alerts: int = V.FEED_ALERTS,
    n_summaries: int = V.FEED_SUMMARIES,
) -> DataFrame:
    """One row (type, data): the newest rows of each kind, oldest to newest inside their list."""

    def ring(df: DataFrame, n: int, order: tuple[str, ...], record: Column) -> Column:
        rows = latest(df, n, order).agg(
            F.sort_array(F.collect_list(F.struct(*order, record.alias("row")))).alias("_l")
        )
        return rows.select(F.transform("_l", lambda x: x["row"])).scalar()

    data = F.struct(
        ring(logs, n_logs, ALERT_ORDER, log_struct()).alias("logs"),
        ring(alerts, n_alerts, ALERT_ORDER, alert_struct()).alias("alerts"),
        ring(summaries, n_summaries, SUMMARY_ORDER, summary_struct()).alias("summaries"),
    )
    return logs.sparkSession.range(1).select(F.lit("snapshot").alias("type"), F.to_json(data, _NULLS).alias("data"))
