"""Tolerant reading of JSON text: one typed parse, no inference, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_STRICT = {"allowSingleQuotes": "false"}
CORRUPT = "_corrupt_record"


def _split_by_case(names: Sequence[str]) -> tuple[list[str], set[str]]:
    """Names that fit one struct, and those that differ from one of them in case only.

    Struct fields are looked up ignoring case, so the second kind cannot be
    told apart inside the struct.
    """
    kept: dict[str, str] = {}
    variants: set[str] = set()
    for name in names:
        if kept.setdefault(name.lower(), name) != name:
            variants.add(name)
    return list(kept.values()), variants


def parse_object(raw: Column, names: Sequence[str]) -> Column:
    """Top-level fields of a JSON object as text, plus the corrupt-record marker."""
    names, _ = _split_by_case(names)
    schema = ", ".join(f"`{n}` STRING" for n in names) + f", {CORRUPT} STRING"
    return F.from_json(raw, schema, _STRICT)


def is_object(parsed: Column) -> Column:
    return parsed.isNotNull() & parsed[CORRUPT].isNull()


def is_json(raw: Column, parsed: Column) -> Column:
    """Whether the text is any JSON value.

    A blank text counts (it reads as a missing value), and so do arrays and
    bare scalars. Objects are recognised by the typed parse because the
    variant parser refuses duplicate keys.
    """
    return (
        is_object(parsed)
        | (F.trim(raw) == "")
        | F.try_parse_json(raw).isNotNull()
        | F.from_json(raw, "array<string>", _STRICT).isNotNull()
    )


def first_field(raw: Column, parsed: Column, names: Sequence[str]) -> Column:
    """The first non-null field among ``names`` as ``struct(name, value)``, or null."""
    _, variants = _split_by_case(names)

    def value(name: str) -> Column:
        if name not in variants:
            return parsed[name]
        # Read on its own, and only from lines that mention the name.
        return F.when(raw.contains(f'"{name}"') & is_object(parsed), F.get_json_object(raw, f"$.{name}"))

    return F.coalesce(
        *[
            F.when(value(n).isNotNull(), F.struct(F.lit(n).alias("name"), value(n).alias("value")))
            for n in names
        ]
    )


def _kind(raw: Column, name: Column) -> Column:
    """JSON type name of one top-level field."""
    fields = F.from_json(raw, "map<string,variant>", _STRICT)
    return F.schema_of_variant(F.try_element_at(fields, name))


def is_container(raw: Column, field: Column) -> Column:
    """Whether the field found by :func:`first_field` is an array or object.

    Only a value starting with a bracket can be one, so the second parse runs
    for those rows alone (``[worker] started`` is a plain string).
    """
    return F.coalesce(
        F.when(
            field["value"].startswith("[") | field["value"].startswith("{"),
            F.coalesce(_kind(raw, field["name"]).rlike("^(ARRAY|OBJECT)"), F.lit(False)),
        ),
        F.lit(False),
    )


def is_number(raw: Column, field: Column) -> Column:
    """Whether the field found by :func:`first_field` is a JSON number."""
    return F.coalesce(
        _kind(raw, field["name"]).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.lit(False)
    )


def scalar_text(raw: Column, field: Column) -> Column:
    """Text of a scalar field; arrays and objects read as an empty text."""
    return F.when(is_container(raw, field), F.lit("")).otherwise(field["value"])


def int_value(text: Column) -> Column:
    """Integer coercion: null stays null, decimals are cut, other text is 0."""
    number = text.try_cast("double").try_cast("int")
    return F.when(text.isNotNull(), F.coalesce(number, F.lit(0)))


def text_list(json_array: Column) -> Column:
    """A JSON array as a list of texts; anything else is an empty list."""
    items = F.from_json(json_array, "array<string>", _STRICT)
    return F.coalesce(
        F.transform(items, lambda x: F.coalesce(x, F.lit("null"))),
        F.array().cast("array<string>"),
    )
