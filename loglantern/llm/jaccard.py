"""Exact Jaccard self-join over word shingles with adaptive multi-match prefixes.

Every document's distinct shingles are put in one global order: by how often
their hash bucket occurs in all documents, in powers of two, then by hash. Any
fixed order is exact; with the rare ones first, common shingles seldom come into
a prefix. The buckets are a table of fixed size, counted over all documents. Two
documents that link share at least l shingles among the first p + l - 1 of
each, where p is the length of the plain prefix. A document whose prefix holds
shingles that many documents share is lengthened by e and may then set aside
its e most frequent prefix shingles: such a pair has to share l = 1 + min(e)
prefix shingles, so at least one of them is not set aside by both.

Groups are never expanded into all pairs. Every prefix shingle has a pivot for
its documents of like size, the one that has most of its prefix in common with
others. First each document is tried with the best of its pivots; where a
shingle's documents are still in different components after that, with all of
its pivots, and in more rounds with others. What is apart after that is cut into
blocks; a task compares two blocks that meet in a shingle and returns links.
Components, not pairs, are the result, so nothing is lost.

Texts travel only to pairs that their sketches leave open. A sketch has, for
each bit, the parity of the shingles that fall on it: two sketches differ in no
more bits than the sets differ in shingles, so no link is ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loglantern.llm.memory import lean
from loglantern.llm.tables import components, stored
from loglantern.llm.words import byte_texts, shingle_set

#: Bits of a shingle's hash that choose its bucket, and pieces in which tasks hand on their counts (32 KB each).
BUCKET_BITS, PIECES = 21, 256
#: Shingles of documents that a task remembers between pairs.
KNOWN = 3_000_000
#: Documents and shingles of a block, about.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 200_000


def least_overlap(n: int, percent: int) -> int:
    """Shingles a document of ``n`` shares with any partner at least."""
    return -(-n * percent // 100)


def plain_prefix(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def longest_extension(n: int, percent: int) -> int:
    """How far a prefix may be lengthened: a sixteenth of the set and 12."""
    return max(0, min(least_overlap(n, percent) - 1, 12 + n // 16))


def extension(pos: np.ndarray, df: np.ndarray, n: int, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Choose e by candidate cost.

    ``pos`` and ``df`` describe the prefix shingles that other documents have
    too. The cost of e is the number of partners met through the shingles that
    stay, plus e. Returns e, the shingles inside the prefix, and which of them
    are set aside.
    """
    p, most = plain_prefix(n, percent), longest_extension(n, percent)
    tried = sorted({0, most, *(1 << i for i in range(most.bit_length()) if 1 << i <= most)})
    best = None
    for e in tried:
        inside = np.flatnonzero(pos < p + e)
        order = inside[np.argsort(-df[inside], kind="stable")]
        cost = int(df[order[e:]].sum()) + e
        if best is None or cost < best[0]:
            best = (cost, e, inside, order[:e])
    _, e, inside, aside = best
    return e, inside, np.isin(inside, aside)


def _counted(k: int):
    """(piece, counts): occurrences of each bucket in the documents of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            for text in byte_texts(batch.column("text")):
                held.append((shingle_set(text, k) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                if len(held) == 256:
                    _add(counts, held)
            _add(counts, held)
        pieces = counts.astype("<u4").reshape(PIECES, -1)
        some = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pieces[i].tobytes() for i in some], pa.binary())], names=["piece", "counts"])

    return run


def _add(counts: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        at, times = np.unique(np.concatenate(held), return_counts=True)
        counts[at] += times
        held.clear()


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << BUCKET_BITS) // PIECES, np.int64)
    for counts in table.column("counts"):
        total += np.frombuffer(counts.as_py(), "<u4")
    # Powers of two are all that is used.
    return pa.table({"piece": table.column("piece")[:1], "classes": pa.array([np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})


def bucket_classes(texts: DataFrame, k: int) -> np.ndarray:
    """The power of two that each bucket's occurrences reach, over all ``texts`` (2 MB)."""
    rows = texts.select("text").mapInArrow(lean(_counted(k)), "piece int, counts binary").groupBy("piece").applyInArrow(_summed, "piece int, classes binary")
    out = np.zeros((PIECES, (1 << BUCKET_BITS) // PIECES), np.uint8)
    for row in rows.collect():
        out[row["piece"]] = np.frombuffer(row["classes"], np.uint8)
    return out.ravel()


def ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A shingle set in the global order."""
    return s[np.lexsort((s, classes[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))]


def sketch(s: np.ndarray) -> bytes:
    """Parities of a shingle set over a power of two of bits, as many as shingles at least."""
    bits = max(64, 1 << max(len(s) - 1, 0).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(x: bytes, size: int) -> bytes:
    """The sketch of the same set over ``size`` bytes, not more than it has."""
    return x if len(x) == size else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0).tobytes()


def most_apart(sizes, percent: int):
    """In how many shingles two sets of ``sizes`` together may differ and link."""
    return sizes - 2 * -(-sizes * percent // (100 + percent))


def _signatures(k: int, percent: int, classes):
    """(doc_id, n, a, b, sketch, tokens): size, two hashes and the sketch of each document's shingle set, and the longest prefix that may be needed, in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, sketches, tokens = [], [], [], [], [np.zeros(0, np.int64)]
            for text in byte_texts(batch.column("text")):
                s = shingle_set(text, k)
                n.append(len(s))
                a.append(np.bitwise_xor.reduce(s) if len(s) else np.uint64(0))
                b.append(s.sum(dtype=np.uint64))
                sketches.append(sketch(s))
                first = ordered(s, classes.value)[: plain_prefix(len(s), percent) + longest_extension(len(s), percent)]
                tokens.append(first.view(np.int64).copy())
            ends = np.cumsum([len(x) for x in tokens])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)),
                    pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens))),
                ],
                names=["doc_id", "n", "a", "b", "sketch", "tokens"],
            )

    return run


def _adapted(percent: int):
    """(token, doc, n, e, strong, alone) of each document's chosen prefix; alone is its share of shingles that no other has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes = batch.column("doc").to_numpy(), batch.column("n").to_numpy()
            lists = batch.column("hits")
            ends = lists.offsets.to_numpy()
            flat = lists.values
            pos, df, token = (flat.field(i).to_numpy() for i in range(3))
            parts = []
            for i in range(len(docs)):
                lo, hi = ends[i], ends[i + 1]
                e, inside, aside = extension(pos[lo:hi], df[lo:hi], int(sizes[i]), percent)
                parts.append((token[lo:hi][inside], np.full(len(inside), docs[i]), np.full(len(inside), sizes[i]), np.full(len(inside), e), ~aside, np.full(len(inside), 1 - (pos[lo:hi] < plain_prefix(int(sizes[i]), percent)).sum() / plain_prefix(int(sizes[i]), percent))))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*parts)], names=["token", "doc", "n", "e", "strong", "alone"]
                )

    return run


def _verified(k: int, percent: int, classes):
    """Keep the pairs that link: enough shared prefix shingles first, then the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        room = [KNOWN]

        def shingles(doc: int, text: np.ndarray) -> np.ndarray:
            if doc not in known:
                if room[0] < 0:
                    known.clear()
                    room[0] = KNOWN
                known[doc] = ordered(shingle_set(text, k), classes.value)
                room[0] -= len(known[doc])
            return known[doc]

        for batch in batches:
            a, b, need = (batch.column(c).to_numpy() for c in ("a", "b", "l"))
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(byte_texts(batch.column("text_a")), byte_texts(batch.column("text_b")))):
                x, y = shingles(a[i], x), shingles(b[i], y)
                l = int(need[i])
                head = np.intersect1d(
                    x[: plain_prefix(len(x), percent) + l - 1], y[: plain_prefix(len(y), percent) + l - 1], assume_unique=True
                )
                if len(head) >= l:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose doc_id is in ``ids``.

    The ids are stored, so that Spark knows their size when it plans: below its
    threshold they are broadcast and rows are filtered where they are read,
    beyond it both sides are shuffled.
    """
    return rows.join(stored(ids.toDF("doc_id").distinct()), "doc_id", "left_semi")


def _near(percent: int):
    """Keep the pairs whose sketches differ no more than those of a link can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_apart(batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy(), percent)
            keep = np.zeros(len(most), bool)
            for i, (x, y) in enumerate(zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())):
                size = min(len(x), len(y))
                keep[i] = (int.from_bytes(folded(x, size)) ^ int.from_bytes(folded(y, size))).bit_count() <= most[i]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b", "l")], names=["a", "b", "l"])

    return run


def sifted(sketches: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b, l) that their ``sketches`` (doc_id, n, sketch) do not rule out."""
    left, right = (sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    return stored(pairs.join(left, "a").join(right, "b").mapInArrow(lean(_near(percent)), "a long, b long, l long").distinct())


def _links(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, k: int, percent: int, classes) -> DataFrame:
    pairs = sifted(sketches, pairs, percent)
    some = stored(_of(texts, pairs.select("a").union(pairs.select("b"))))
    left, right = (some.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "l", "text_a", "text_b")
    return stored(both.mapInArrow(lean(_verified(k, percent, classes)), "a long, b long"))


def _fits(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _pivot_pairs(postings: DataFrame, order: Column, percent: int, apart: bool, one: bool = False) -> DataFrame:
    """Pairs (a, b, l) of each shingle's first document by ``order`` with the others of like size; a < b.

    ``one``: only the first of all pivots that a document meets.
    """
    sized = postings.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100.0 / percent)))).withColumn("order", order)
    facts = ["order", "doc", "n", "e", "strong"] + ["comp"] * apart
    pivots = sized.groupBy("token", "band").agg(F.min(F.struct(*facts)).alias("p"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    met = sized.join(pivots.drop("docs"), ["token", "band"]).where("doc <> p.doc AND (strong OR p.strong)").where(_fits("n", "p.n", percent))
    if apart:
        met = met.where("comp <> p.comp")
    if one:
        met = met.groupBy("doc").agg(F.min(F.struct("p.order", "p.doc", "p.e")).alias("p"), F.min("e").alias("e"))
    return met.groupBy(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b")).agg(F.min(F.least("e", "p.e") + 1).alias("l"))


def _blocks(placed: DataFrame, percent: int) -> DataFrame:
    """(doc, block): documents of like size that share their most frequent shingle, a bounded number of rows and shingles to a block."""
    common = placed.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
    homes = placed.join(common, "token").groupBy("doc").agg(F.first("n").alias("n"), F.max(F.struct("docs", "token")).alias("home"))
    homes = homes.select("doc", "n", F.col("home.token").alias("home"), F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).alias("band"))
    pieces = homes.groupBy("home", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).alias("pieces"))
    piece = F.pmod(F.xxhash64("doc"), "pieces")
    return homes.join(pieces, ["home", "band"]).select("doc", F.xxhash64("home", "band", piece).alias("block"))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of common elements of the sets ``left`` and ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    one, two = np.concatenate(left), np.concatenate(right)
    known = np.intersect1d(one, two)
    at = []
    for sets, flat in ((left, one), (right, two)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.searchsorted(known, flat)
        there = column < len(known)
        there[there] = known[column[there]] == flat[there]
        order = np.argsort(column[there], kind="stable")
        at.append((row[there][order], column[there][order]))
    for lo in range(0, len(known), 4096):
        parts = []
        for sets, (row, column) in zip((left, right), at):
            some = slice(*np.searchsorted(column, [lo, lo + 4096]))
            dense = np.zeros((len(sets), min(4096, len(known) - lo)), np.float32)
            dense[row[some], column[some] - lo] = 1
            parts.append(dense)
        out += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return out


def _block_links(docs: np.ndarray, comp: np.ndarray, e: np.ndarray, first: np.ndarray, second: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the documents ``first`` and ``second`` (places in ``docs``) of different components.

    Enough shared prefix shingles come first, then the whole sets.
    """
    n = np.array([len(x) for x in sets], np.int64)
    head = [x[: plain_prefix(len(x), percent) + int(more)] for x, more in zip(sets, e)]
    a, b = n[first][:, None], n[second][None, :]
    open_ = (comp[first][:, None] != comp[second][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    if open_.any():
        open_ &= _common([head[i] for i in first], [head[i] for i in second]) > np.minimum(e[first][:, None], e[second][None, :])
    rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(rows):
        return docs[:0], docs[:0]
    first, second = first[rows], second[columns]
    both = _common([sets[i] for i in first], [sets[i] for i in second])
    linked = open_[np.ix_(rows, columns)] & (100 * both >= percent * (n[first][:, None] + n[second][None, :] - both))
    i, j = np.nonzero(linked)
    return docs[first[i]], docs[second[j]]


def _between_blocks(k: int, percent: int, classes):
    """Links (a, b) of each pair of blocks; rows arrive sorted by (block_a, block_b, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, int, int, np.ndarray]] = {}
        now = None

        def links() -> pa.RecordBatch:
            docs = np.array(list(held), np.int64)
            comp, e, block = (np.array([f[i] for f in held.values()], np.int64) for i in range(3))
            first, second = np.flatnonzero(block == now[0]), np.flatnonzero(block == now[1])
            a, b = _block_links(docs, comp, e, first, second, [f[3] for f in held.values()], percent)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block_a", "block_b", "block", "doc", "comp", "e")]
            for one, two, block, doc, comp, e, text in zip(*columns, byte_texts(batch.column("text"))):
                if now != (one, two):
                    if held:
                        yield links()
                    held, now = {}, (one, two)
                held[doc] = (comp, e, block, ordered(shingle_set(text, k), classes.value))
        if held:
            yield links()

    return run


def _open_sides(percent: int):
    """The documents of each pair of blocks that a sketch of the other block leaves open; rows arrive sorted by (block_a, block_b)."""
    names = ["block_a", "block_b", "block", "doc", "comp", "e"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def left_open() -> pa.RecordBatch:
            size = min(len(r[7]) for r in held)
            block, comp, n = (np.array([r[i] for r in held], np.int64) for i in (2, 4, 6))
            signs = np.unpackbits(np.frombuffer(b"".join(folded(r[7], size) for r in held), np.uint8)).reshape(len(held), -1).astype(np.float32) * 2 - 1
            first, second = np.flatnonzero(block == held[0][0]), np.flatnonzero(block == held[0][1])
            apart = (8 * size - signs[first] @ signs[second].T) / 2
            open_ = (comp[first][:, None] != comp[second][None, :]) & (apart <= most_apart(n[first][:, None] + n[second][None, :], percent))
            some = np.union1d(first[open_.any(1)], second[open_.any(0)])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*{held[i][:6] for i in some})] or [pa.array([], pa.int64())] * 6, names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*names, "n", "sketch"])):
                if held and held[0][:2] != row[:2]:
                    yield left_open()
                    held = []
                held.append(row)
        if held:
            yield left_open()

    return run


def _still_apart(postings: DataFrame, found: DataFrame) -> DataFrame:
    """``postings`` with the component of each document, for shingles that several components have."""
    placed = (
        postings.drop("comp").join(found.withColumnRenamed("node", "doc"), "doc", "left")
        .withColumn("comp", F.coalesce("component", "doc")).drop("component")
    )
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return stored(placed.join(mixed, "token"))


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text, ...).

    Two documents link when 100 * |A and B| >= percent * |A or B| over their
    distinct ``k``-word shingles, A-Z lower-cased; fewer words make one shingle.
    Texts that are null or without a word have no shingle and link with nothing.
    ``component_id`` is the smallest doc_id reachable by links. Rows that repeat
    a doc_id should repeat its text; each is placed by its own text. A row
    without doc_id links with nothing and has no component. An empty table gives
    an empty result; further columns are ignored. ``rounds`` of further pivots
    shape the work, not the result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes_of = docs.sparkSession.sparkContext.broadcast(bucket_classes(texts, k))
    made = stored(texts.mapInArrow(lean(_signatures(k, percent, classes_of)), "doc_id long, n long, a long, b long, sketch binary, tokens array<long>"))
    signs, sketches = made.drop("sketch", "tokens"), made.select("doc_id", "n", "sketch")
    classes = signs.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))

    # Copies are left out by their ids, which are fewer than those that stay.
    copies = signs.join(classes, ["n", "a", "b"]).where("doc_id <> rep").select("doc_id").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    tokens = (
        made.where("n > 0 AND doc_id IS NOT NULL").join(stored(copies.distinct()), "doc_id", "left_anti")
        .select(F.col("doc_id").alias("doc"), "n", F.posexplode("tokens").alias("pos", "token"))
    )
    postings = stored(
        tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
        .groupBy("doc", "n").agg(F.collect_list(F.struct("pos", "df", "token")).alias("hits"))
        .mapInArrow(lean(_adapted(percent)), "token long, doc long, n long, e long, strong boolean, alone double")
    )

    tried = stored(_pivot_pairs(postings, F.col("alone"), percent, apart=False, one=True))
    links = _links(texts, sketches, tried, k, percent, classes_of)
    found = components(links)
    placed = _still_apart(postings, found)
    for turn in range(rounds):
        order = F.xxhash64("doc", F.lit(turn)) if turn else F.col("alone")
        pairs = stored(_pivot_pairs(placed, order, percent, apart=True).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        more = _links(texts, sketches, pairs, k, percent, classes_of)
        tried, links = tried.unionByName(pairs), links.unionByName(more)
        if not more.isEmpty():
            found = components(links)
            placed = _still_apart(placed, found)

    # What is still apart: documents in blocks, and pairs of blocks that meet in a shingle.
    placed = placed.join(placed.groupBy("token").agg(F.max("strong").alias("any")).where("any").select("token"), "token")
    placed = stored(placed)
    blocks = stored(_blocks(placed, percent))
    parts = placed.join(blocks, "doc").groupBy("token", "block").agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("strong").alias("s"), F.min("comp").alias("c0"), F.max("comp").alias("c1")
    )
    one, two = (parts.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "n0", "n1", "s", "c0", "c1")]) for x in "ab")
    meet = stored(
        one.join(two, "token").where(
            f"block_a <= block_b AND (s_a OR s_b) AND least(c0_a, c0_b) < greatest(c1_a, c1_b) AND 100 * n1_a >= {percent} * n0_b AND 100 * n1_b >= {percent} * n0_a"
        ).select("block_a", "block_b").distinct()
    )
    facts = placed.select("doc", "e", "comp").distinct().join(blocks, "doc").join(sketches.withColumnRenamed("doc_id", "doc"), "doc")
    sides = meet.select("block_a", "block_b", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    open_ = sides.join(facts, "block").repartition("block_a", "block_b").sortWithinPartitions("block_a", "block_b")
    open_ = stored(open_.mapInArrow(lean(_open_sides(percent)), "block_a long, block_b long, block long, doc long, comp long, e long"))
    met = open_.join(_of(texts, open_.select("doc")).withColumnRenamed("doc_id", "doc"), "doc")
    met = met.repartition("block_a", "block_b").sortWithinPartitions("block_a", "block_b", "doc")
    found = components(links.union(stored(met.mapInArrow(lean(_between_blocks(k, percent, classes_of)), "a long, b long"))))

    of_class = (
        classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("n", "a", "b", F.coalesce("component", "rep").alias("component_id"))
    )
    return signs.join(of_class, ["n", "a", "b"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
