"""Phrase collocations: frequent word pairs and triples that belong together, per language.

The first pass hashes every run of one to three words, counts within tasks, and
deals the counts over hash partitions. Each partition merges them into one
Misra-Gries summary with more counters than its mass divided by the least
frequency, so every run as frequent as that survives; those whose counter and
error bound stay below it are left aside. A filter of bounded size
over the survivors lets the second pass leave the rest aside while it counts
phrases by their words, exactly. Scores and the choice of phrases are joins and
decimals on those counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from loglantern.llm.memory import lean
from loglantern.llm.tables import join_counted, stored
from loglantern.llm.words import mixed

LONGEST = 3
#: Occurrences a task counts at once, and bytes of text hashed at once.
HELD, BLOCK = 1 << 20, 1 << 19
#: Runs that pass the filter, counted at once.
FOUND = 1 << 18
#: Occurrences per hash partition, about: a task holds 12 bytes for each that its inputs kept apart, and 16 per counter.
MASS = 1 << 20
#: Shares of a language that are ranked apart first.
RANKED = 64
#: Bits of the survivors' filter: 16 per survivor, within these bounds (32 MB at most).
FILTER_BITS = (1 << 16, 1 << 28)

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BREAK = _CUT.copy()
_BREAK[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


#: Two independent sets of factors: bytes, places of a word in a run, and one for the step along a word.
_FACTORS = [(_odd(s, 256), _odd(s + 1, LONGEST + 1), _odd(s + 2, 1)[0]) for s in (4021, 8059)]


class Texts:
    """The words of a batch of texts: where they start and end in the joined lower-case bytes, language and piece."""

    def __init__(self, column: pa.Array, langs: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = _LOWER[whole[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        inside = np.concatenate([[False], ~_BREAK[self.data], [False]])
        edge = inside[1:] != inside[:-1]
        # A text ends a word even where the next one begins with a letter.
        joint = ends[1:-1]
        joint = joint[inside[joint] & inside[joint + 1]]
        bounds = np.flatnonzero(edge)
        self.starts = np.sort(np.concatenate([bounds[::2], joint]))
        self.ends = np.sort(np.concatenate([bounds[1::2], joint]))
        doc = np.searchsorted(ends, self.starts, side="right") - 1
        cuts = np.flatnonzero(_CUT[self.data])
        self.piece = np.searchsorted(cuts, self.starts) + doc
        coded = langs.fill_null("und").dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.lang = np.asarray(coded.indices)[doc] if len(doc) else np.zeros(0, np.int32)

    def word_hashes(self, factors) -> np.ndarray:
        byte, _, step = factors
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + BLOCK)))
            sizes = self.ends[at:to] - self.starts[at:to]
            first = np.cumsum(sizes) - sizes
            within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()), step)]))
            part = self.data[np.repeat(self.starts[at:to], sizes) + within]
            out[at:to] = np.add.reduceat(byte[part] * power[within], first)
            at = to
        return mixed(out)

    def runs(self, n: int) -> np.ndarray:
        """First words of the runs of ``n`` words within one piece."""
        if len(self.piece) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1])

    def hashes(self, words: np.ndarray, names: np.ndarray, at: np.ndarray, n: int, factors) -> np.ndarray:
        """Hashes of the runs of ``n`` words that start at words ``at``, with their language."""
        total = names[self.lang[at]] * factors[1][LONGEST] + np.uint64(n)
        for j in range(n):
            total = total + words[at + j] * factors[1][j]
        return mixed(total)

    def name_hashes(self, factors) -> np.ndarray:
        own = [np.frombuffer(n.encode(), np.uint8) for n in self.names]
        power = lambda k: np.multiply.accumulate(np.full(k + 1, factors[2]))[:k]
        return mixed(np.array([(factors[0][b] * power(len(b))).sum(dtype=np.uint64) for b in own] or [0], np.uint64))


def _blocks(batch: pa.RecordBatch, size: int = BLOCK) -> Iterator[Texts]:
    """The batch in blocks of about ``size`` bytes; a longer text is a block of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0))
    total, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = total[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(total, before + size, side="right")))
        part = batch.slice(first, last - first)
        yield Texts(part.column("text"), part.column("lang"))
        first = last


def _summarised(parts: int):
    """(part, hashes, counts, mass) of each task's runs, counted in blocks of HELD."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        # Parts are ranges of the hash, so each is a slice of the sorted keys.
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(bounds))
        cut = [(bounds[p], bounds[p + 1]) for p in full]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()),
                pa.array([counts[a:b].astype("<u4").tobytes() for a, b in cut], pa.binary()),
                pa.array([int(counts[a:b].sum()) for a, b in cut], pa.int64()),
            ],
            names=["part", "hashes", "counts", "mass"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for texts in _blocks(batch):
                words, names = texts.word_hashes(_FACTORS[0]), texts.name_hashes(_FACTORS[0])
                for k in range(1, LONGEST + 1):
                    held.append(texts.hashes(words, names, texts.runs(k), k, _FACTORS[0]))
                    n += len(held[-1])
                if n >= HELD:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    return run


class Summary:
    """A Misra-Gries summary of at most ``size`` counters; summaries merge by adding and lowering all counts alike.

    A key occurred at most as often as its counter says and all counters were ``lowered``.
    """

    def __init__(self, size: int):
        self.size = size
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.lowered = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate([self.counts, counts]))
        if len(keys) > self.size:
            least = np.partition(total, len(keys) - self.size - 1)[len(keys) - self.size - 1]
            total -= least
            self.lowered += int(least)
            keys, total = keys[total > 0], total[total > 0]
        self.keys, self.counts = keys, total

    def frequent(self, least: int) -> np.ndarray:
        """All keys that can have occurred ``least`` times."""
        return self.keys[self.counts + self.lowered >= least]


def _survivors(least: int):
    """Hashes left by each partition's summary. Rows come sorted by part, with the part's whole mass."""

    def merged(summary: Summary, held: list[tuple[bytes, bytes]]) -> None:
        if held:
            summary.merge(
                np.frombuffer(b"".join(h for h, _ in held), "<u8"),
                np.frombuffer(b"".join(c for _, c in held), "<u4").astype(np.int64),
            )
            held.clear()

    def rows(summary: Summary, held: list) -> pa.RecordBatch:
        merged(summary, held)
        return pa.RecordBatch.from_arrays([pa.array(summary.frequent(least).view(np.int64))], names=["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary, held, size = None, Summary(1), [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "hashes", "counts", "total")]
            for p, hashes, counts, total in zip(*columns):
                if p.as_py() != part:
                    if part is not None:
                        yield rows(summary, held)
                    part, summary, size = p.as_py(), Summary(total.as_py() // least + 1), 0
                held.append((hashes.as_py(), counts.as_py()))
                size += len(held[-1][1])
                if size >= HELD:
                    merged(summary, held)
                    size = 0
        if part is not None:
            yield rows(summary, held)

    return run


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each hash in a filter of ``bits`` (a power of two)."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [(hashes * f) >> shift for f in (np.uint64(1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))]


def _marks(bits: int):
    """(word, mask): the filter's 64-bit words that a task's survivors set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(_places(hashes, bits)))
            word, mask = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.diff(word, prepend=np.uint64(2**63)))
            sums = np.bitwise_or.reduceat(mask, first) if len(first) else mask
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[first].astype(np.int64)), pa.array(sums.view(np.int64))], names=["word", "mask"]
            )

    return run


def _filter(survivors: DataFrame) -> np.ndarray:
    """The filter over the survivors: a bit table of 16 bits for each, within FILTER_BITS; never misses one."""
    wanted = max(survivors.count() * 16, 1)
    bits = min(max(1 << (wanted - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    words = survivors.mapInArrow(lean(_marks(bits)), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    table = np.zeros(bits // 64, np.uint64)
    for batch in words.toArrow().to_batches():
        table[batch.column("word").to_numpy()] = batch.column("mask").to_numpy().view(np.uint64)
    return table


def _phrases(table):
    """(lang, words, phrase, f) of the runs that pass the filter, counted per task in blocks of FOUND."""

    def passing(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for at in _places(hashes, len(marks) * 64):
            ok &= (marks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok

    def counted(texts: Texts, marks: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Per run that passes, once per block: its two hashes, times, size, language, first and last byte."""
        first = texts.word_hashes(_FACTORS[0]), texts.name_hashes(_FACTORS[0])
        second = texts.word_hashes(_FACTORS[1]), texts.name_hashes(_FACTORS[1])
        for n in range(1, LONGEST + 1):
            at = texts.runs(n)
            hashes = texts.hashes(*first, at, n, _FACTORS[0])
            ok = passing(hashes, marks)
            at, hashes = at[ok], hashes[ok]
            if len(at):
                order = np.argsort(hashes, kind="stable")
                at, hashes = at[order], hashes[order]
                check = texts.hashes(*second, at, n, _FACTORS[1])
                new = _groups(hashes, check)
                times, at = np.diff(np.append(new, len(hashes))), at[new]
                yield hashes[new], check[new], times, np.full(len(at), n), texts.lang[at], texts.starts[at], texts.ends[at + n - 1]

    def rows(texts: list[bytes], names: list[list[str]], held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """What has been counted, each run once; its words are read where it was first met."""
        hashes, check, times, size, lang, start, end, block = map(np.concatenate, zip(*held))
        held.clear()
        order = np.lexsort((check, hashes))
        new = _groups(hashes[order], check[order])
        total = np.add.reduceat(times[order], new)
        at = order[new]
        raw = [texts[b][i:j] for b, i, j in zip(block[at].tolist(), start[at].tolist(), end[at].tolist())]
        # Words may have been further apart than one space.
        odd = [k for k, (r, n) in enumerate(zip(raw, size[at].tolist())) if b"\t" in r or r.count(b" ") != n - 1]
        for k in odd:
            raw[k] = b" ".join(raw[k].split())
        langs = [names[b][k] for b, k in zip(block[at].tolist(), lang[at].tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(size[at], pa.int32()), pa.array(raw, pa.binary()).cast(pa.string()), pa.array(total, pa.int64())],
            names=["lang", "words", "phrase", "f"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = table.value
        texts: list[bytes] = []
        names: list[list[str]] = []
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for block in _blocks(batch):
                for found in counted(block, marks):
                    held.append((*found, np.full(len(found[0]), len(texts), np.int32)))
                    n += len(found[0])
                texts.append(block.data.tobytes())
                names.append(block.names)
                if n >= FOUND:
                    yield rows(texts, names, held)
                    texts, names, held, n = [], [], [], 0
        if n:
            yield rows(texts, names, held)

    return run


def _groups(hashes: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where a new run begins. Runs of equal first hash may interleave, which only makes more groups."""
    return np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])]))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n): words per language, counted per batch."""
    for batch in batches:
        for texts in _blocks(batch):
            counts = np.bincount(texts.lang, minlength=len(texts.names))
            yield pa.RecordBatch.from_arrays([pa.array(texts.names, pa.string()), pa.array(counts, pa.int64())], names=["lang", "n"])


def frequent_phrases(rows: DataFrame, least: int, mass: int = MASS) -> DataFrame:
    """lang, words, phrase, f of all runs of one to three words with f >= ``least``, exactly. ``rows`` holds (lang, text).

    ``mass`` occurrences go to a hash partition; it shapes the work, not the
    result. With much memory per task, more mean fewer and larger rows to shuffle.
    """
    spark = rows.sparkSession
    grams = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * LONGEST // 6
    parts = max(1, ceil(grams / mass))
    counts = rows.mapInArrow(lean(_summarised(parts)), "part int, hashes binary, counts binary, mass long")
    # The window needs the rows of a part in one task, and leaves them there, in order, for the summary.
    # Hence one task for each part.
    whole = counts.repartitionById(parts, F.col("part")).withColumn("total", F.sum("mass").over(Window.partitionBy("part"))).select("part", "hashes", "counts", "total")
    survivors = stored(whole.mapInArrow(lean(_survivors(least)), "hash long"))
    table = spark.sparkContext.broadcast(_filter(survivors))
    found = rows.mapInArrow(lean(_phrases(table)), "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _part(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, absorbed: int = 50, mass: int = MASS) -> DataFrame:
    """The ``top`` collocations of each language in ``docs`` (lang, text, ...): lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts cut at ``. , ; : ! ?`` and line ends into pieces
    and at spaces and tabs into words; phrases are runs of two or three words
    of a piece with ``a`` >= ``least`` occurrences. The score is
    floor(1000000 a a / (l r)) for the cut into first and last part (with l
    and r occurrences) that makes it least, ties to the shortest first part. A
    phrase goes if a longer one holds it and has ``absorbed`` per cent of its
    occurrences or more. Ties of the score fall to the larger ``a``, then the
    phrase in byte order. Null texts are empty, a null lang is ``und``; texts
    are read whole, a single one in the memory of one task; repeated rows count
    again; an empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL")
    known = stored(frequent_phrases(rows, least, mass))
    sizes = stored(rows.mapInArrow(lean(_lengths), "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))

    long = known.where("words > 1")
    held = known.where(F.col("words") == LONGEST)
    longer = (
        held.select("lang", F.explode(F.array(_part(1, 2), _part(2, 2))).alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    )
    kept = long.join(longer, ["lang", "phrase"], "left").where(
        F.col("over").isNull() | (F.col("over") * 100 < F.col("f") * absorbed)
    )
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = stored(
        kept.select("lang", "phrase", "words", F.col("f").alias("a"), cut)
        .select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words")).alias("rest"))
    )
    once = stored(join_counted(cuts, known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"], "l"))
    both = join_counted(once, known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "r")
    score = F.expr("(CAST(a AS DECIMAL(13,0)) * CAST(a AS DECIMAL(13,0)) * 1000000BD) div (CAST(l AS DECIMAL(13,0)) * CAST(r AS DECIMAL(13,0)))")
    scored = (
        both.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
        .select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    )
    # First within shares of a language, so that the last step sees at most RANKED times ``top`` rows of it.
    best = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    for key in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
