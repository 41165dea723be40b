"""Arrival order of Kafka rows within one millisecond, through parsing, panes and tables."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from loglantern import schemas
from loglantern.operators import panes, ranking
from loglantern.plans import jobs
from loglantern.sources import kafka

AT = datetime(2025, 1, 1, tzinfo=timezone.utc)


def raw(spark, places):
    line = '{"ts":"2025-01-01T00:00:00Z","service":"a","level":"ERROR","message":"ip=10.0.0.1 endpoint=/p%d/o%d"}'
    rows = [(bytearray((line % (p, o)).encode()), p, o, AT) for p, o in places]
    return kafka.raw_lines(spark.createDataFrame(rows, "value binary, partition int, offset bigint, timestamp timestamp"))


def test_order_has_no_modulus(spark):
    places = [(0, 4095), (0, 4096), (0, 8191), (0, 8192), (1, 0), (511, 7), (512, 3), (1024, 3)]
    got = raw(spark, places[::-1])
    assert [(r.ord.partition, r.ord.offset) for r in got.orderBy("ord").collect()] == places
    assert got.select("ord").distinct().count() == len(places)


def test_panes_and_tables_keep_the_order(spark, tmp_path):
    logs = jobs.parse_logs(raw(spark, [(0, 4096), (0, 4095)]), ingest_ts=F.col("source_ts")).select(*schemas.LOG.fieldNames())
    assert ranking.latest(logs, 1).first().ord.offset == 4096
    logs.write.parquet(f"{tmp_path}/logs")
    back = spark.read.schema(schemas.arrived(schemas.LOG)).parquet(f"{tmp_path}/logs")
    assert [r.ord.offset for r in back.orderBy("ord").collect()] == [4095, 4096]
    pane = panes.metric_panes(back, 5).select(*schemas.PANE.fieldNames())
    pane.write.parquet(f"{tmp_path}/panes")
    row = spark.read.schema(schemas.arrived(schemas.PANE)).parquet(f"{tmp_path}/panes").first()
    assert row.last.ord.offset == 4096 and row.first_ord.offset == 4095


def test_tails_of_kafka_rows_give_samples(spark, tmp_path):
    from loglantern.operators.summaries import window_samples

    logs = jobs.parse_logs(raw(spark, [(0, 4096), (0, 4095)]), ingest_ts=F.col("source_ts"))
    panes.pane_tails(logs, 10, 10).select(*schemas.TAIL.fieldNames()).write.parquet(f"{tmp_path}/tails")
    tails = spark.read.schema(schemas.arrived(schemas.TAIL)).parquet(f"{tmp_path}/tails")
    row = window_samples(tails, 30, 10).first()
    assert str(row).index("o4095") < str(row).index("o4096")
