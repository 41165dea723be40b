"""Quality rules as a short-circuit cascade, in built-in functions only.

Base measures come first. The further rules are put in order by what they
reject per second: each rule's cost and selectivity are measured on a bounded
sample, and a document stops at the first rule it fails. The order changes how
long a run takes, never its result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from loglantern.llm.tables import stored
from loglantern.llm.words import BREAKS

#: Words in a window whose repeats count.
WINDOW = 8


def rules() -> dict[str, Column]:
    """Rule name to the condition that rejects a document; conditions see the text and the base measures."""
    return {
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "repeated_lines": F.col("n_dup_lines") * 2 > F.col("n_lines"),
        "stammering": F.regexp_count("text", F.lit(r"(?<![^ \t\n\x0B\f\r])([^ \t\n\x0B\f\r]++)(?=[ \t\n\x0B\f\r]\1(?![^ \t\n\x0B\f\r]))")) * 10 > F.col("n_words") * 3,
        "shouting": F.regexp_count("text", F.lit(r"\p{Lu}{3,}")) * 10 > F.col("n_words") * 3,
        "exclaiming": F.regexp_count("text", F.lit("!")) * 10 > F.col("n_words") * 3,
        "no_letters": F.regexp_count("text", F.lit(r"(?<![^ \t\n\x0B\f\r])[^ \t\n\x0B\f\r\p{L}]++(?![^ \t\n\x0B\f\r])")) * 10 > F.col("n_words") * 3,
    }


def base_measures(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed to ``docs`` (text not null)."""
    one = (
        docs.withColumn("words", F.filter(F.split("text", BREAKS + "+"), lambda w: w != ""))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]")))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .drop("words", "lines")
    )
    places = F.when(F.size("hashes") >= WINDOW, F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    # Not slice(): inside a lambda it copies the whole array for every window.
    window = lambda i: F.xxhash64(*(F.get("hashes", i + j) for j in range(-1, WINDOW - 1)))
    two = one.withColumn("windows", F.transform(places, window))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    # Windows sorted by hash, so that equal ones are neighbours; then their places, sorted.
    numbered = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    three = two.withColumn("sorted", F.when(twice, F.array_sort(numbered))).drop("windows", "hashes")
    same = lambda x, i, step: F.coalesce(F.get("sorted", i + step)["h"] == x["h"], F.lit(False))
    repeated = F.filter("sorted", lambda x, i: same(x, i, -1) | same(x, i, 1))
    four = three.withColumn("at", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(repeated, lambda x: x["i"])))).drop("sorted")
    # A window covers its eight words, or those up to the next one.
    steps = F.zip_with(F.slice("at", 2, F.size("at")), F.slice("at", 1, F.size("at") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("at") > 0, F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + F.coalesce(x, F.lit(0)))).otherwise(0)
    n_repeat = F.coalesce(covered, F.lit(0)).cast("long")
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    failed = (F.col("n_words") < 20) | (100 * n_repeat > 30 * F.col("n_words"))
    # A generator: a filter on a measure is not pushed below it, where it would repeat all of this inside lambdas.
    measures = F.struct(*names, n_repeat.alias("n_repeat_words"), failed.alias("base_failed"))
    return four.select(*docs.columns, F.inline(F.array(measures)))


def cascade_order(measured: DataFrame, conditions: dict[str, Column], sample_rows: int = 512) -> list[str]:
    """Rule names by rejections per second on a sample of at most ``sample_rows`` rows, best first."""
    sample = stored(measured.sample(0.1, seed=5).limit(sample_rows)).where("NOT base_failed")
    n = sample.count()
    if not n:
        return sorted(conditions)

    def seconds(condition: Column) -> tuple[float, int]:
        start = time.perf_counter()
        got = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - start, got

    idle = min(seconds(F.length("text") < 0)[0] for _ in range(2))
    value = {}
    for name, condition in conditions.items():
        runs = [seconds(condition) for _ in range(2)]
        value[name] = (runs[0][1] + 0.5) / (n * max(min(r[0] for r in runs) - idle, 1e-3))
    return sorted(conditions, key=lambda name: (-value[name], name))


def judge(docs: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for each row of ``docs`` (doc_id, text, ...).

    A null text has no words and fails the base rules, as an empty one does.
    Repeated rows are judged again; a null doc_id stays null; further columns
    are ignored. Empty tables give empty results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    measured = base_measures(rows)
    conditions = rules() if conditions is None else conditions
    order = cascade_order(measured, conditions)
    kept = F.when(F.col("base_failed"), F.lit(False))
    for name in order:
        kept = kept.when(conditions[name], F.lit(False))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.otherwise(F.lit(True)).alias("kept"),
    )
