"""Small text and list rules shared by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def texts(values: Sequence[str]) -> Column:
    """A literal list of texts."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def blank(text: Column) -> Column:
    """Null, empty, or white space of any kind."""
    return F.coalesce(text, F.lit("")).rlike(r"^[\s\p{Z}]*$")


def if_blank(text: Column, fallback: Column) -> Column:
    return F.when(blank(text), fallback).otherwise(text)


def first_of(items: Column, limit: int | None) -> Column:
    """The first ``limit`` entries; all of them without a limit."""
    return items if limit is None else F.slice(items, 1, limit)


def merge_distinct(limit: int | None, *lists: Column) -> Column:
    """Concatenate, keep the first occurrence of each entry, cut to ``limit`` if there is one."""
    return first_of(F.array_distinct(F.concat(*lists)), limit)


def truncate(text: Column, n: int) -> Column:
    """Display form: at most ``n`` characters, an ellipsis where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def record_text(name: str, fields: Sequence[tuple[str, Column]]) -> Column:
    """A record as ``Name(a=1, b=[x, y])``; null shows as ``null``."""
    parts: list[Column] = []
    for i, (label, value) in enumerate(fields):
        parts.append(F.lit(("" if i == 0 else ", ") + label + "="))
        parts.append(F.coalesce(value.cast("string"), F.lit("null")))
    return F.concat(F.lit(name + "("), *parts, F.lit(")"))


def list_text(items: Column) -> Column:
    """A list of texts as ``[a, b]``."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
