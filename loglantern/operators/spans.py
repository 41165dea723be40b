"""Span tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_errors(spans: DataFrame, message: Column, key: str = "error") -> DataFrame:
    """Put ``message`` into the attributes of the spans where it is not null; an entry that was there is replaced."""
    attributes = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    others = F.map_filter(attributes, lambda k, _: k != key)
    noted = F.map_concat(others, F.create_map(F.lit(key), message.cast("string")))
    return spans.withColumn("attributes", F.when(message.isNull(), F.col("attributes")).otherwise(noted))
