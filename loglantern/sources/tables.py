"""Parquet tables written batch by batch.

A micro-batch is written aside and renamed into its own folder when it is
complete; a batch whose folder is there is finished and is never written again.
A retried batch therefore leaves the files as they are, and a reader that
follows the table sees each row once. This relies on renames of folders being
atomic, as on HDFS and local disks.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loglantern import schemas
from loglantern.operators.panes import latest_per_key

BATCH = "batch_id"
#: Buckets of the incident table, by hash of the id.
BUCKETS = 32


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` that are not hidden."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(at(path)) if f.isDirectory() and f.getPath().getName()[0] not in "._")


def write_batch(df: DataFrame, path: str, batch_id: int) -> bool:
    """Write a batch unless it is finished; whether it was written."""
    return _commit(df, path, batch_id, None)


def _commit(df: DataFrame, path: str, batch_id: int, by: str | None, under: str = "") -> bool:
    """Write aside, then rename: to ``batch_id=n``, or with ``by`` to ``by=value/[under/]batch_id=n`` for each value."""
    spark = df.sparkSession
    fs, at = _files(spark, path)
    done = f"{path}/{BATCH}={batch_id}" if by is None else f"{path}/_finished/{under.replace('/', '-')}{batch_id}"
    if fs.exists(at(done)):
        return False
    aside = f"{path}/_aside/{batch_id}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(aside)
        fs.rename(at(aside), at(done))
        return True
    df.write.partitionBy(by).parquet(aside)
    for value in _names(spark, aside):
        folder = f"{path}/{value}/{under}"
        fs.mkdirs(at(folder))
        # A part that an attempt before this one has moved stays.
        if not fs.exists(at(f"{folder}/{BATCH}={batch_id}")):
            fs.rename(at(f"{aside}/{value}"), at(f"{folder}/{BATCH}={batch_id}"))
    fs.mkdirs(at(done))
    fs.delete(at(aside), True)
    return True


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(_with_batch(schema)).parquet(path)


def stream_batches(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(_with_batch(schema))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])


# ---- rows by day ----------------------------------------------------------


def write_days(df: DataFrame, path: str, batch_id: int, at: str) -> bool:
    """Write a batch as :func:`write_batch` does, each day of ``at`` in a folder of its own."""
    return _commit(df.withColumn("day", F.to_date(at)), path, batch_id, "day")


def read_days(spark: SparkSession, path: str, schema: T.StructType, first: date, last: date) -> DataFrame:
    """The rows of the days from ``first`` to ``last``; no other folder is listed or opened."""
    fs, at = _files(spark, path)
    days = [f"{path}/day={first + timedelta(days=i)}" for i in range((last - first).days + 1)]
    found = [d for d in days if fs.exists(at(d))]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(_with_batch(schema)).option("basePath", path).parquet(*found).drop(BATCH, "day")


# ---- incidents ------------------------------------------------------------


def _bucket(incident_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(incident_id), F.lit(buckets)).cast("int")


def write_incidents(df: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> bool:
    """Write a batch of incidents, split into buckets by the hash of their id."""
    return _commit(df.withColumn("bucket", _bucket(F.col("id"), buckets)), path, batch_id, "bucket", "level=0")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest version of every id; equal batches differ only in how often they were merged."""
    return latest_per_key(rows, ["id"], [F.col(BATCH).desc(), F.col("level").desc()], 1).drop("_rank", BATCH, "level", "bucket")


def _rows(spark: SparkSession, paths: Sequence[str], base: str) -> DataFrame:
    fields = [*schemas.INCIDENT.fields, T.StructField("bucket", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField(BATCH, T.LongType())]
    return spark.read.schema(T.StructType(fields)).option("basePath", base).parquet(*paths)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """The incident table: the newest version of every id."""
    return _newest(_rows(spark, [path], path))


def incident_by_id(spark: SparkSession, path: str, incident_id: str, buckets: int = BUCKETS) -> DataFrame:
    """Point lookup: the one bucket that can hold the id is listed and opened."""
    number = spark.range(1).select(_bucket(F.lit(incident_id), buckets)).first()[0]
    folder = f"{path}/bucket={number}"
    fs, at = _files(spark, path)
    if not fs.exists(at(folder)):
        return spark.createDataFrame([], schemas.INCIDENT)
    return _newest(_rows(spark, [folder], path).where(F.col("id") == incident_id))


def compact_incidents(spark: SparkSession, path: str, fan: int = 8) -> int:
    """Merge the batches of every level that has ``fan`` or more into one of the next; how many merges were made.

    The merged batch keeps the newest version of each id and the number of the
    newest batch. It is there before the old ones go: a reader in between meets
    versions twice, which makes no difference to it. A row is rewritten once
    per level. One job at a time may compact a table, and only batches that are
    finished are merged.
    """
    fs, at = _files(spark, path)
    finished = {int(n.removeprefix("level=0")) for n in _names(spark, f"{path}/_finished") if n.startswith("level=0")}
    merges, level = 0, 0
    while True:
        batches: dict[int, list[str]] = {}
        for bucket in _names(spark, path):
            for name in _names(spark, f"{path}/{bucket}/level={level}"):
                batches.setdefault(int(name.split("=")[1]), []).append(f"{path}/{bucket}/level={level}/{name}")
        ready = sorted(b for b in batches if level or b in finished)
        if not ready:
            return merges
        if len(ready) >= fan:
            old = [f for b in ready for f in batches[b]]
            rows = _rows(spark, old, path)
            merged = latest_per_key(rows, ["id"], [F.col(BATCH).desc()], 1).drop("_rank", BATCH, "level")
            _commit(merged, path, ready[-1], "bucket", f"level={level + 1}")
            for folder in old:
                fs.delete(at(folder), True)
            merges += 1
        level += 1


def jdbc_options(url: str, table: str, user: str, password: str, **extra: str) -> dict[str, str]:
    """Options for the relational form of the incident table (the driver comes with the cluster).

    Give ``partitionColumn``, bounds and ``numPartitions`` for a parallel read.
    """
    return {"url": url, "dbtable": table, "user": user, "password": password, **extra}
