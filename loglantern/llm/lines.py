"""Line dedup by a deletion-neighbourhood join, in built-in functions only.

Two lines are near copies when one word inserted, deleted or replaced turns one
into the other. Every line that may have a near copy emits, as hashed keys, all
variants within that bound: itself, and itself without each of its words. Lines
that meet in a variant are joined through the earliest line of the variant
(never pair by pair), the edit distance is verified on the words, and the
earliest line stays.

Hashes of sequences are exclusive-ors of word hashes with their places, so all
variants of a line cost no more than reading it. Lines are first met by halves:
with one edit, either the first or the last half of the words is unchanged.
Only lines with such a partner emit variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglantern.llm.tables import stored
from loglantern.llm.words import BREAKS

#: Place of rows without doc_id: after all others.
LAST = (1 << 63) - 1


def normal(line: Column) -> Column:
    """Lower-cased words with one space between."""
    return F.lower(F.trim(F.regexp_replace(line, BREAKS + "+", " ")))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def _firsts(rows: DataFrame, min_words: int) -> DataFrame:
    """The first place (doc, line) of each different line, its number of words and the hashes of its halves.

    A line of n words has the halves for partners of its own length and, as the
    longer one, those for partners of n - 1 words.
    """
    lines = rows.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("doc", "line", normal(F.col("raw")).alias("norm"))
    lines = lines.where("norm <> ''").withColumn("n", F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)

    def half(m: str, end: int) -> Column:
        part = f"substring_index(norm, ' ', floor({m} / 2)" + (")" if end == 0 else f" - {m})")
        return F.when(F.col("n") >= min_words, F.xxhash64(F.lit(end), F.expr(m), F.expr(part)))

    lines = lines.select(
        "doc", "line", "n", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"),
        half("n", 0).alias("a0"), half("n", 1).alias("a1"), half("(n - 1)", 0).alias("b0"), half("(n - 1)", 1).alias("b1"),
    )
    facts = ["n", "a0", "a1", "b0", "b1"]
    return lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line", *facts)).alias("f"), F.count(F.lit(1)).alias("places")).select("f.*", "places")


def _candidates(firsts: DataFrame) -> DataFrame:
    """(doc, lines): for each document the lines that meet another by a half, and in which roles.

    s: both lines have as many words; w: the other has one more; d: the other has one less.
    """
    met = firsts.where("a0 IS NOT NULL").select(
        "doc", "line", F.inline(F.array(*(F.struct(F.col(c).alias("key"), F.lit(c[0] == "a").alias("own")) for c in ("a0", "a1", "b0", "b1"))))
    )
    keys = met.groupBy("key").agg(F.count_if("own").alias("owns"), F.count_if(~F.col("own")).alias("longer")).where("owns > 1 OR owns > 0 AND longer > 0")
    return (
        met.join(keys, "key")
        .groupBy("doc", "line").agg(
            F.max(F.col("own") & (F.col("owns") > 1)).alias("s"),
            F.max(F.col("own") & (F.col("longer") > 0)).alias("w"),
            F.max(~F.col("own") & (F.col("owns") > 0)).alias("d"),
        )
        .where("s OR w OR d")
        .groupBy("doc").agg(F.collect_list(F.struct("line", "s", "w", "d")).alias("wanted"))
    )


def _variants(lines: DataFrame) -> DataFrame:
    """(key, n, at, role, doc, line): hashed variants of ``lines`` (doc, line, norm, s, w, d).

    Role 0: without word ``at``, for partners of the same length; role 1: the
    whole line; role 2: without one word, to meet a whole line of n words.
    """
    split = lines.withColumn("words", F.split("norm", " ")).withColumn("n", F.size("words"))
    placed = split.withColumn("g", F.transform("words", lambda x, i: F.xxhash64(x, i)))
    whole = placed.withColumn("all", F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)))
    swaps = whole.where("s").select("doc", "line", "n", "all", F.posexplode("g").alias("at", "g")).select(
        F.col("all").bitwiseXOR(F.col("g")).alias("key"), "n", "at", F.lit(0).alias("role"), "doc", "line"
    )
    entire = whole.where("w").select(F.col("all").alias("key"), "n", F.lit(-1).alias("at"), F.lit(1).alias("role"), "doc", "line")
    # Without word i: the words before it at their places, those after it one place earlier.
    longer = split.where("d").select("doc", "line", "n", F.posexplode("words").alias("at", "word")).select(
        "doc", "line", "n", "at", F.xxhash64("word", "at").alias("g"), F.xxhash64("word", F.col("at") - 1).alias("h")
    )
    line = Window.partitionBy("doc", "line")
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.bit_xor("g").over(upto).bitwiseXOR(F.col("g"))
    after = F.bit_xor("h").over(line).bitwiseXOR(F.bit_xor("h").over(upto))
    shorter = longer.select(before.bitwiseXOR(after).alias("key"), (F.col("n") - 1).alias("n"), F.lit(-1).alias("at"), F.lit(2).alias("role"), "doc", "line")
    return swaps.union(entire).union(shorter)


def _within_one_word(x: Column, y: Column) -> Column:
    """Whether at most one word inserted, deleted or replaced turns word list x into y."""
    differ = F.size(F.filter(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), lambda d: d))
    short, long = F.when(F.size(x) < F.size(y), x).otherwise(y), F.when(F.size(x) < F.size(y), y).otherwise(x)
    head = F.array_position(F.zip_with(short, F.slice(long, 1, F.size(short)), lambda a, b: a.eqNullSafe(b)), False).cast("int")
    rest = F.slice(short, head, F.size(short)) == F.slice(long, head + 1, F.size(short))
    return (
        F.when(F.size(x) == F.size(y), differ <= 1)
        .when(F.size(long) - F.size(short) == 1, (head == 0) | F.when(head > 0, rest).otherwise(F.lit(True)))
        .otherwise(F.lit(False))
    )


def kept_lines(docs: DataFrame, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(firsts, near): the first place of each different line, and of those the near copies of an earlier one.

    firsts: doc, line, n, places. near: doc, line, of_doc, of_line.
    """
    rows = _rows(docs)
    firsts = stored(_firsts(rows, min_words))
    found = (
        rows.join(_candidates(firsts), "doc")
        .withColumn("raw", F.split("text", "\n")).drop("text")
        .select("doc", "raw", F.explode("wanted").alias("x"))
        .select("doc", "x.*", normal(F.get("raw", F.col("x.line"))).alias("norm"))
    )
    # Rows that repeat a doc_id with another text give lines that are not the ones met; they are harmless.
    lines = stored(found.where("norm IS NOT NULL AND norm <> ''"))
    variants = _variants(lines)
    place = F.struct("doc", "line")
    first_of = lambda role: F.min(F.when(F.col("role") == role, place))
    keys = (
        variants.groupBy("key", "n", "at").agg(*(first_of(r).alias(f"p{r}") for r in range(3)), F.max(place).alias("last"))
        .where("p0 < last OR p1 IS NOT NULL AND p2 IS NOT NULL")
    )
    partner = F.when(F.col("role") == 0, F.col("p0")).when(F.col("role") == 1, F.col("p2")).otherwise(F.col("p1"))
    pairs = (
        variants.join(keys, ["key", "n", "at"]).withColumn("p", partner).where(F.col("p") < place)
        .groupBy("doc", "line").agg(F.min("p").alias("p")).select("doc", "line", F.col("p.doc").alias("of_doc"), F.col("p.line").alias("of_line"))
    )
    norms = lines.select("doc", "line", "norm")
    near = (
        pairs.join(norms, ["doc", "line"])
        .join(norms.select(F.col("doc").alias("of_doc"), F.col("line").alias("of_line"), F.col("norm").alias("of_norm")), ["of_doc", "of_line"])
        .withColumn("x", F.split("norm", " ")).withColumn("y", F.split("of_norm", " "))
        .where(_within_one_word(F.col("x"), F.col("y")))
        .select("doc", "line", "of_doc", "of_line")
    )
    return firsts.select("doc", "line", "n", "places"), stored(near.distinct())


def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines taken out: text replaced, n_lines and n_kept added.

    A line is dropped when its words, in lower case, equal those of an earlier
    line of the table, or when it and an earlier line have ``min_words`` words
    or more and differ by one word inserted, deleted or replaced. Earlier means
    a smaller doc_id, then a smaller line number; the earlier line counts even
    if it is dropped itself. Lines without a word stay and count for nothing.
    n_lines and n_kept count lines with a word. Null texts stay null with no
    lines; rows without doc_id come last; rows of one doc_id should repeat its
    text and then keep the same lines. Other columns are carried along, but for old ones
    named n_lines or n_kept.
    """
    firsts, near = kept_lines(docs, min_words)
    stay = (
        firsts.select("doc", "line").join(near.select("doc", "line"), ["doc", "line"], "left_anti")
        .groupBy("doc").agg(F.collect_list("line").alias("__stay"))
    )
    names = docs.columns
    rows = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).join(stay.withColumnRenamed("doc", "__doc"), "__doc", "left")
    rows = rows.withColumn("__lines", F.split(F.col("text").cast("string"), "\n"))
    worded = F.transform("__lines", lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    rows = rows.withColumn("__worded", worded)
    blank = F.filter(F.transform("__worded", lambda w, i: F.when(~w, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__at", F.array_sort(F.concat(blank, F.coalesce("__stay", F.array().cast("array<int>")))))
    rows = rows.withColumn("__n", F.size(F.filter("__worded", lambda w: w)).cast("long")).withColumn("__blank", F.size("__lines") - F.col("__n"))
    text = F.array_join(F.transform("__at", lambda i: F.get("__lines", i)), "\n")
    found = F.struct(
        text.alias("text"),
        F.greatest(F.coalesce("__n", F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("__at") - F.col("__blank"), F.lit(0)), F.lit(0)).cast("long").alias("n_kept"),
    )
    # A generator: later filters on the counts do not repeat the work above.
    rows = rows.select(*(c for c in names if c not in ("text", "n_lines", "n_kept")), F.inline(F.array(found)))
    return rows.select(*(c for c in names if c not in ("n_lines", "n_kept")), "n_lines", "n_kept")
