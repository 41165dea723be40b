"""Intermediate tables in the shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglantern.llm.memory import BATCH
from loglantern.session import shared_dir


#: Removes a query's shuffle files when it ends, and not only when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds the batches that Spark hands to Python, which else have 10,000 rows of any size.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on Python gets rows of this session in batches of about BATCH bytes, unless it has a bound already; no row changes by it."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage: what is read later does not depend on any executor that may
    be lost. Its shuffle files go once it is written, and Python gets its rows in
    batches of about BATCH bytes. The folder belongs to the run; clear it when the run is over.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    wanted = {_CLEANUP: "true", _BATCH: conf.get(_BATCH, None) or str(BATCH)}
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        # Planned under these settings: the plan keeps them. No other plan reads these shuffles.
        df.select("*").write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component).

    Alternating large-star and small-star rounds, each a grouped minimum and a
    join; the edges stay in the shared folder. ``component`` is the smallest
    node. Nodes without an edge have no row.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                now.select("lo", "lo").distinct()
            )
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select("hi", F.col("m").alias("lo")))
        )
        now = stored(small.distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join stored ``rows`` to ``counted``, which has one row per ``keys``, whatever share of the rows one key holds.

    ``weight`` counts what makes a key frequent in ``rows``. Fewer than 1,000
    keys can hold more than a thousandth of all weight each, so these are
    broadcast; the other keys are shuffled. Both inputs are read more than
    once: pass written tables. ``how`` is inner or left.
    """
    total = counted.agg(F.sum(F.col(weight).cast("decimal(38,0)"))).first()[0]
    if total is None:
        total = 0
    heavy = counted.where(F.col(weight).cast("decimal(38,0)") * 1000 > F.lit(total))
    light = counted.where(F.col(weight).cast("decimal(38,0)") * 1000 <= F.lit(total))
    return rows.join(F.broadcast(heavy), keys).unionByName(
        rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    )
