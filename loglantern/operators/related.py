"""Joins between logs and alerts that never enumerate pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loglantern.operators.panes import latest_per_key


def _bucket(ts: Column, gap_ms: int) -> Column:
    return F.floor(F.unix_millis(ts) / gap_ms).cast("bigint")


def alert_reach(alerts: DataFrame, gap_ms: int, keys: Sequence[str] = ("service",)) -> DataFrame:
    """Per key and time bucket: what the neighbouring alerts can match.

    Buckets are ``gap_ms`` wide, so an alert in the bucket itself always
    matches, the bucket before matters through its latest alert only, and the
    one after through its earliest. Two numbers per bucket decide the join, and
    the table has one row per key and bucket whatever the number of alerts.
    """
    ms = F.unix_millis("event_ts")
    spans = (
        alerts.where(F.col("event_ts").isNotNull())
        .groupBy(*keys, _bucket(F.col("event_ts"), gap_ms).alias("bucket"))
        .agg(F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))
    )
    return (
        spans.withColumn("_offset", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .groupBy(*keys, (F.col("bucket") + F.col("_offset")).alias("bucket"))
        .agg(
            F.max(F.when(F.col("_offset") == 1, F.col("last_ms"))).alias("before_ms"),
            F.max(F.when(F.col("_offset") == 0, F.lit(True))).alias("inside"),
            F.min(F.when(F.col("_offset") == -1, F.col("first_ms"))).alias("after_ms"),
        )
    )


def near_alerts(
    logs: DataFrame, alerts: DataFrame, gap_sec: int = 60, keys: Sequence[str] = ("service",)
) -> DataFrame:
    """Logs with some alert of the same service strictly less than ``gap_sec`` away.

    A left-semi join on (service, bucket) against unique rows: the log side is
    never multiplied and adaptive execution can split a hot bucket of it.
    Times are compared in whole milliseconds.
    """
    gap_ms = gap_sec * 1000
    reach = alert_reach(alerts, gap_ms, keys).select(
        *[F.col(k).alias(f"_a_{k}") for k in keys],
        F.col("bucket").alias("_a_bucket"), "before_ms", "inside", "after_ms",
    )
    ms = F.unix_millis("event_ts")
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_a_{k}"))
    match = (
        match
        & (_bucket(F.col("event_ts"), gap_ms) == F.col("_a_bucket"))
        & (
            F.coalesce(F.col("inside"), F.lit(False))
            | F.coalesce(ms - F.col("before_ms") < gap_ms, F.lit(False))
            | F.coalesce(F.col("after_ms") - ms < gap_ms, F.lit(False))
        )
    )
    return logs.join(reach, match, "left_semi")


def newest_per_key(
    events: DataFrame, keys: Sequence[str], fields: Sequence[str], n: int, name: str,
    order: Sequence[str] = ("event_ts", "ord"),
) -> DataFrame:
    """One row per key with its newest ``n`` rows as a list of structs, newest first."""
    rows = latest_per_key(events, keys, [F.col(c).desc() for c in order], n)
    return (
        rows.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", F.struct(*fields).alias("row")))).alias("_l"))
        .select(*keys, F.transform("_l", lambda x: x["row"]).alias(name))
    )


def salted_lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int | None = None
) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has one short row per key, however many rows share a key.

    The rows of a key are dealt over ``salts`` parts by a hash of the columns
    ``spread``, and each row of the table is copied once per part, so a key
    with most of the rows is read by all tasks alike. Equal rows stay together;
    the copies cost ``salts`` times the table: 16 times the session's shuffle
    partitions by default, fewer for tables of very many keys.
    """
    if salts is None:
        salts = 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_part", part).join(copies, [*keys, "_part"], "left").drop("_part")


def counted_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` to ``table``, which has one row per key and says in ``weight`` how many rows have it.

    Fewer than 1,000 keys can hold more than a thousandth of all rows each: only
    these are broadcast, all others are shuffled. Both inputs are read twice.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    many = F.col(weight) * 1000 > F.lit(total)
    frequent, rare = table.where(many).drop(weight), table.where(~many).drop(weight)
    held = F.broadcast(frequent.select(*keys))
    return rows.join(F.broadcast(frequent), list(keys)).unionByName(rows.join(held, list(keys), "left_anti").join(rare, list(keys)))


def related_alerts(logs: DataFrame, alerts: DataFrame, k: int = 5, salts: int | None = None) -> DataFrame:
    """Add ``related`` to each log: the newest ``k`` alerts of its service, newest first.

    The ranking does not depend on the log, so it is done once per service
    before the join instead of once per log after it. The logs are dealt by
    (service, hash of ord), so no service's logs land in one task.
    """
    fields = [c for c in alerts.columns if c != "service"]
    lists = newest_per_key(alerts, ["service"], ["service", *fields], k, "related")
    return salted_lookup(logs, lists, ["service"], ["ord"], salts)
