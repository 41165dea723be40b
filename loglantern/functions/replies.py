"""Reading reviewer replies: the JSON object inside free text, with defaults.

A parser returns null where the text holds no readable object, so callers can
``coalesce`` their fallback behind it. Text after the first complete object is
ignored, as a streaming JSON reader does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from loglantern import fixed_values as V
from loglantern.functions import json_text as J
from loglantern.functions.binding import let


def json_object_in(text: Column) -> Column:
    """From the first ``{`` through the last ``}``, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def envelope_content(raw: Column) -> Column:
    """Content of the first choice of a completion envelope.

    Empty when the field is missing, null when the envelope itself is not a
    JSON object.
    """
    envelope = J.parse_object(raw, ["choices"])
    content = F.get_json_object(raw, "$.choices[0].message.content")
    return F.when(J.is_object(envelope), F.coalesce(content, F.lit("")))


def _read(reply: Column, names: list[str], fields: Callable[["_Reply"], list[Column]]) -> Column:
    """Struct of ``fields`` from the object in ``reply``; the text is cut out and parsed once."""

    def from_parsed(p: Column) -> Column:
        return F.when(J.is_object(p["json"]), F.struct(*fields(_Reply(p["body"], p["json"]))))

    return let(
        json_object_in(reply),
        lambda body: let(F.struct(body.alias("body"), J.parse_object(body, names).alias("json")), from_parsed),
    )


class _Reply:
    """Field readers over one parsed reply."""

    def __init__(self, body: Column, parsed: Column):
        self.body = body
        self.parsed = parsed

    def text(self, name: str, default: str) -> Column:
        return F.coalesce(J.scalar_text(self.body, J.first_field(self.body, self.parsed, [name])), F.lit(default)).alias(name)

    def texts(self, name: str) -> Column:
        return J.text_list(self.parsed[name]).alias(name)

    def number(self, name: str) -> Column:
        return F.coalesce(self.parsed[name].try_cast("double"), F.lit(0.0)).alias(name)

    def flag(self, name: str) -> Column:
        value = self.parsed[name]
        return F.coalesce(
            (F.trim(value) == "true") | F.coalesce(value.try_cast("bigint") != 0, F.lit(False)), F.lit(False)
        ).alias(name)


def log_reply(reply: Column) -> Column:
    return _read(
        reply,
        ["is_anomaly", "score", "category", "explanation"],
        lambda r: [
            r.flag("is_anomaly"),
            r.number("score"),
            r.text("category", V.LOG_REPLY_CATEGORY),
            r.text("explanation", V.LOG_REPLY_EXPLANATION),
        ],
    )


def window_reply(reply: Column) -> Column:
    return _read(
        reply,
        ["is_anomaly", "severity", "category", "summary", "top_signals", "recommended_actions"],
        lambda r: [
            r.flag("is_anomaly"),
            r.text("severity", "low"),
            r.text("category", "other"),
            r.text("summary", ""),
            r.texts("top_signals"),
            r.texts("recommended_actions"),
        ],
    )


def agent_reply(reply: Column) -> Column:
    return _read(
        reply,
        ["answer", "steps", "commands", "cautions"],
        lambda r: [r.text("answer", ""), r.texts("steps"), r.texts("commands"), r.texts("cautions")],
    )


def draft_reply(reply: Column) -> Column:
    return _read(
        reply,
        ["title", "impact", "timeline", "evidence", "recommended_actions"],
        lambda r: [
            r.text("title", V.DRAFT_REPLY_TITLE),
            r.text("impact", ""),
            r.texts("timeline"),
            r.texts("evidence"),
            r.texts("recommended_actions"),
        ],
    )
