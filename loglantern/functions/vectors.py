"""Vector arithmetic, tokens and string hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loglantern import fixed_values as V
from loglantern.functions.binding import let

_MASK32 = 0xFFFFFFFF


def tokens(text: Column) -> Column:
    """Lower-cased tokens; empty ones are dropped before positions are counted."""
    return F.filter(F.split(F.lower(text), V.TOKEN_SPLIT_PATTERN), lambda t: t != "")


def string_hash(token: Column) -> Column:
    """32-bit polynomial hash (base 31) of an ASCII token, as an unsigned BIGINT."""
    return F.aggregate(
        F.split(token, ""),
        F.lit(0).cast("bigint"),
        lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(_MASK32).cast("bigint")),
    )


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(
        F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    return let(
        a,
        lambda v: let(
            norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)
        ),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length, 0.0 when either side is a zero vector."""
    n = F.least(F.size(a), F.size(b))
    return let(
        F.struct(F.slice(a, 1, n).alias("x"), F.slice(b, 1, n).alias("y")),
        lambda p: F.coalesce(F.try_divide(dot(p["x"], p["y"]), norm(p["x"]) * norm(p["y"])), F.lit(0.0)),
    )


def vector_text(a: Column) -> Column:
    """Export form ``[0.123456,...]`` with six decimals."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.6f", x)), ","), F.lit("]")
    )


def incident_text(prefix: str = "") -> Column:
    """Text an incident is embedded by; empty parts keep their separator."""
    scalar = [F.coalesce(F.col(prefix + c), F.lit("")) for c in ("title", "summary", "impact", "category", "severity")]
    lists = [
        F.coalesce(F.array_join(F.col(prefix + c), " "), F.lit(""))
        for c in ("timeline", "evidence", "recommended_actions")
    ]
    return F.concat_ws(" ", *scalar, *lists)


def similarity_text(summary: Column, signals: Column) -> Column:
    """Text similar incidents are searched by: the summary, then its signals."""
    return F.array_join(F.concat(F.array(F.coalesce(summary, F.lit(""))), signals), " ")
