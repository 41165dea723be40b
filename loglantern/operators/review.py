"""Reviews of logs, windows, incidents and questions.

Every review has three sources, told apart per row: a usable reply, a reply
that cannot be read, or no reply at all. ``reply`` is the reviewer's text
(null: no reviewer) and ``reply_failed`` marks a call that raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loglantern import fixed_values as V
from loglantern.functions import json_text as J, replies as R
from loglantern.functions.binding import computed_once
from loglantern.functions.log_fields import IS_JSON_COLUMN, JSON_COLUMN, with_json
from loglantern.functions.text import if_blank, texts

Reviewer = Callable[[Sequence[str]], Sequence[str]]


def call_reviewer(df: DataFrame, request: str, reviewer: Reviewer, batch_rows: int = 64) -> DataFrame:
    """Run a user's reviewer over the ``request`` column; adds reply and reply_failed.

    The callable gets a list of requests and returns as many replies, so it can
    batch its calls. When a batch raises, its rows are tried one by one and only
    the failing ones are marked. Narrow: no shuffle, one Arrow batch at a time.
    """
    schema = T.StructType(
        [f for f in df.schema.fields if f.name not in ("reply", "reply_failed")]
        + [T.StructField("reply", T.StringType()), T.StructField("reply_failed", T.BooleanType())]
    )

    def ask(requests: list[str]) -> list[tuple[str | None, bool]]:
        try:
            answers = list(reviewer(requests))
            if len(answers) != len(requests):
                raise ValueError("a reviewer must return one reply per request")
            return [(a, False) for a in answers]
        except Exception:
            if len(requests) == 1:
                return [(None, True)]
            return [pair for r in requests for pair in ask([r])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            requests = batch[request].tolist()
            pairs = [p for i in range(0, len(requests), batch_rows) for p in ask(requests[i : i + batch_rows])]
            yield batch.assign(reply=[p[0] for p in pairs], reply_failed=[p[1] for p in pairs])[schema.names]

    kept = df.select([c for c in df.columns if c not in ("reply", "reply_failed")])
    return kept.mapInPandas(run, schema)


def _with_reply(df: DataFrame) -> DataFrame:
    if "reply" not in df.columns:
        df = df.withColumn("reply", F.lit(None).cast("string"))
    if "reply_failed" not in df.columns:
        df = df.withColumn("reply_failed", F.lit(False))
    return df


def _any_word(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def with_heuristic(df: DataFrame, raw: str, note: Column, use_parsed: bool = False) -> DataFrame:
    """Add ``_heuristic``, the rule-based review of one raw line.

    Reads only the canonical field names, so a line using aliases is judged as
    blank; ``use_parsed`` judges the parsed columns instead.
    """
    line, parsed = F.coalesce(F.col(raw), F.lit("")), F.col(JSON_COLUMN)

    def field(name: str) -> Column:
        return F.coalesce(J.scalar_text(line, J.first_field(line, parsed, [name])), F.lit(""))

    if use_parsed:
        level, service, message = (F.col(c) for c in ("level", "service", "message"))
        latency = F.coalesce(F.col("latency_ms"), F.lit(0))
    else:
        level, service, message = field("level"), field("service"), field("message")
        latency = F.coalesce(J.int_value(parsed["latencyMs"]), F.lit(0))
    read = df.withColumns(
        {"_h_level": F.upper(level), "_h_service": F.lower(service), "_h_message": F.lower(message), "_h_latency": latency}
    )
    message = F.col("_h_message")
    is_json = F.col(IS_JSON_COLUMN)
    category = (
        F.when(~is_json, F.when(_any_word(F.lower(line), V.TEXT_WORDS), "other").otherwise("normal"))
        .when((F.col("_h_service") == V.AUTH_SERVICE) | _any_word(message, V.AUTH_WORDS), "security")
        .when((F.col("_h_latency") >= V.SLOW_LATENCY_MS) | _any_word(message, V.LATENCY_WORDS), "latency")
        .when(_any_word(message, V.RESOURCE_WORDS), "resource")
        .when((F.col("_h_level") == "ERROR") | _any_word(message, V.ERROR_WORDS), "error_spike")
        .otherwise("normal")
    )
    judged = read.withColumn("_h_category", category)
    category = F.col("_h_category")
    score = F.when(
        ~is_json, F.when(category == "normal", V.TEXT_NORMAL_SCORE).otherwise(V.TEXT_ANOMALY_SCORE)
    )
    for name, value in V.CATEGORY_SCORES.items():
        score = score.when(category == name, value)
    review = F.struct(
        (category != "normal").alias("is_anomaly"),
        score.alias("score"),
        category.alias("category"),
        F.when(is_json, note).otherwise(F.concat(note, F.lit(V.NOTE_TEXT_SUFFIX))).alias("explanation"),
    )
    return judged.withColumn("_heuristic", review).drop(
        "_h_level", "_h_service", "_h_message", "_h_latency", "_h_category"
    )


def review_logs(df: DataFrame, raw: str = "raw", use_parsed: bool = False) -> DataFrame:
    """Add ``review`` struct(is_anomaly, score, category, explanation) to raw log rows."""
    if JSON_COLUMN not in df.columns:
        df = with_json(df, raw)
    has_replies = "reply" in df.columns
    df = _with_reply(df)
    note = F.lit(V.NOTE_NO_REVIEWER)
    if has_replies:
        note = (
            F.when(F.col("reply_failed"), V.NOTE_FAILED_CALL)
            .when(F.col("reply").isNull(), V.NOTE_NO_REVIEWER)
            .otherwise(V.NOTE_BAD_REPLY)
        )
    judged = with_heuristic(df, raw, note, use_parsed)
    review = F.col("_heuristic")
    if has_replies:
        judged = judged.withColumn("_reply", R.log_reply(F.col("reply")))
        review = F.coalesce(F.col("_reply"), review)
    reviewed = computed_once(judged, {"review": review})
    return reviewed.drop("_heuristic", "_reply", *([] if has_replies else ["reply", "reply_failed"]))


def to_alerts(reviewed: DataFrame, threshold: float = V.ALERT_THRESHOLD) -> DataFrame:
    """Alert rows of the anomalous reviews at or above the threshold; a score that is not a number is not."""
    return reviewed.where(F.col("review.is_anomaly") & (F.col("review.score") >= threshold) & ~F.isnan("review.score")).select(
        "ord",
        "event_ts",
        "ts",
        "service",
        F.col("review.category").alias("category"),
        F.col("review.score").alias("score"),
        "level",
        "message",
        F.col("review.explanation").alias("explanation"),
        F.lit(V.NEW_STATUS).alias("status"),
    )


def _window_review(summary: str, category: str, signals: Column, actions: Sequence[str] = ()) -> Column:
    return F.struct(
        F.lit(False).alias("is_anomaly"),
        F.lit("low").alias("severity"),
        F.lit(category).alias("category"),
        F.lit(summary).alias("summary"),
        signals.alias("top_signals"),
        texts(actions).alias("recommended_actions"),
    )


def _preview(reply: Column, n: int | None) -> Column:
    return reply if n is None else F.left(reply, F.lit(n))


def review_windows(df: DataFrame, preview: int | None = None) -> DataFrame:
    """Add the ``review`` of a window summary; without a reviewer no window is anomalous.

    An unreadable reply is kept as a signal, whole or its first ``preview`` characters.
    """
    df = _with_reply(df)
    reply = F.col("reply")
    review = (
        F.when(F.col("reply_failed"), _window_review(V.WINDOW_FAILED_CALL_SUMMARY, "other", texts(())))
        .when(
            reply.isNull(),
            _window_review(V.WINDOW_NO_REVIEWER_SUMMARY, "normal", texts(()), V.WINDOW_NO_REVIEWER_ACTIONS),
        )
        .otherwise(
            F.coalesce(
                R.window_reply(reply),
                _window_review(
                    V.WINDOW_BAD_REPLY_SUMMARY, "other", F.array(_preview(reply, preview))
                ),
            )
        )
    )
    return computed_once(df, {"review": review})


def failed_window_review(df: DataFrame, failed: Column) -> DataFrame:
    """Replace the review where the analysis of a window failed; the counts stay true."""
    fallback = _window_review(
        V.WINDOW_FAILED_JOB_SUMMARY, "other", texts(V.WINDOW_FAILED_JOB_SIGNALS), V.WINDOW_FAILED_JOB_ACTIONS
    )
    return df.withColumn("review", F.when(failed, fallback).otherwise(F.col("review")))


def draft_incidents(df: DataFrame, preview: int | None = None) -> DataFrame:
    """Add the ``draft`` of an incident report; ``preview`` as for windows."""
    df = _with_reply(df)
    reply = F.col("reply")

    def draft(impact: str, timeline: Sequence[str], evidence: Column, actions: Sequence[str]) -> Column:
        return F.struct(
            F.lit(V.DRAFT_TITLE).alias("title"),
            F.lit(impact).alias("impact"),
            texts(timeline).alias("timeline"),
            evidence.alias("evidence"),
            texts(actions).alias("recommended_actions"),
        )

    choice = (
        F.when(
            F.col("reply_failed"),
            draft(V.DRAFT_FAILED_CALL_IMPACT, (), texts(V.DRAFT_FAILED_CALL_EVIDENCE), V.DRAFT_FAILED_CALL_ACTIONS),
        )
        .when(
            reply.isNull(),
            draft(
                V.DRAFT_NO_REVIEWER_IMPACT,
                V.DRAFT_NO_REVIEWER_TIMELINE,
                texts(V.DRAFT_NO_REVIEWER_EVIDENCE),
                V.DRAFT_NO_REVIEWER_ACTIONS,
            ),
        )
        .otherwise(
            F.coalesce(
                R.draft_reply(reply),
                draft(
                    V.DRAFT_BAD_REPLY_IMPACT,
                    (),
                    F.array(_preview(reply, preview)),
                    V.DRAFT_BAD_REPLY_ACTIONS,
                ),
            )
        )
    )
    return computed_once(df, {"draft": choice})


def answer_questions(df: DataFrame) -> DataFrame:
    """Add the plain ``answer`` of a question."""
    df = _with_reply(df)
    reply = F.col("reply")
    return df.withColumn(
        "answer",
        F.when(F.col("reply_failed"), V.ANSWER_FAILED_CALL)
        .when(reply.isNull(), V.ANSWER_NO_REVIEWER)
        .otherwise(if_blank(reply, F.lit(V.ANSWER_BLANK))),
    )


def structured_answers(df: DataFrame, preview: int | None = None) -> DataFrame:
    """Add ``agent`` struct(answer, steps, commands, cautions) of a question; ``preview`` as for windows."""
    df = _with_reply(df)
    reply = F.col("reply")

    def agent(answer: Column, caution: str) -> Column:
        return F.struct(
            answer.alias("answer"),
            texts(()).alias("steps"),
            texts(()).alias("commands"),
            texts((caution,)).alias("cautions"),
        )

    shown = if_blank(_preview(reply, preview), F.lit(V.ANSWER_NOT_JSON))
    return df.withColumn(
        "agent",
        F.when(F.col("reply_failed"), agent(F.lit(V.ANSWER_FAILED_CALL), V.ANSWER_FAILED_CALL_CAUTION))
        .when(reply.isNull(), agent(F.lit(V.ANSWER_NO_REVIEWER), V.ANSWER_NO_REVIEWER_CAUTION))
        .otherwise(F.coalesce(R.agent_reply(reply), agent(shown, V.ANSWER_NOT_JSON_CAUTION))),
    )
