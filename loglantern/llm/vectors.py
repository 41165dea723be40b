"""Near-duplicate vectors by lattice hashing.

Each vector is scaled to length one and projected at random to eight
dimensions, once per table. The cell of a table is the nearest point of the E8
lattice; the vector is also entered under the nearest neighbouring points.
Vectors that meet in a cell are compared by cosine in double precision.

Equal vectors are one class and enter once. A cell with many classes is cut
into blocks, and each pair of blocks is one matrix product; a task returns
counts and a spanning forest, never the pairs. A pair that meets in several
cells counts only in the first of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loglantern.llm.tables import components, stored
from loglantern.llm.words import mixed

_HALVES = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
_PAIRS = np.array([
    [s if c == i else t if c == j else 0.0 for c in range(8)]
    for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)
])
#: The 240 shortest vectors of E8: steps to the neighbouring points.
STEPS = np.concatenate([_PAIRS, _HALVES])
_AXES = np.random.default_rng(88).integers(1, 2**62, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum: round, and round the worst one the other way if the sum is odd."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: whole coordinates or all halves, of even sum."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


def cells(units: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Hashes (rows, tables, 1 + probes): the own cell of each table, then its nearest neighbours."""
    n, dim = units.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        normal = np.random.default_rng([seed, t, dim]).normal(size=(dim, max(8, min(dim, 8))))
        axes = np.linalg.qr(normal)[0] if dim >= 8 else normal / np.sqrt(dim)
        x = units @ axes * (scale * np.sqrt(max(dim, 8) / 8))
        own = nearest_point(x)
        gap = ((x - own) ** 2).sum(1)[:, None] - 2 * (x - own) @ STEPS.T + 2.0
        steps = STEPS[np.argsort(gap, 1, kind="stable")[:, :probes]]
        points = np.concatenate([own[:, None], own[:, None] + steps], 1)
        twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
        out[:, t] = mixed((twice * _AXES).sum(2, dtype=np.uint64) + np.uint64(t + 1) * _AXES[0])
    return out


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, key, vector): key is null where the vector links with nothing."""
    for batch in batches:
        ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        keys, vectors = [], []
        for i, v in enumerate(batch.column("vector").to_pylist()):
            usable = bool(v) and ids[i] is not None and labels[i] is not None and None not in v
            x = np.array(v, np.float64) if usable else np.zeros(0)
            usable = usable and bool(np.isfinite(x).all()) and bool(x.any())
            keys.append(hashlib.md5(x.tobytes() + b"|" + labels[i].encode()).hexdigest() if usable else None)
            vectors.append(v if usable else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.string()), pa.array(vectors, pa.list_(pa.float64()))],
            names=["vec_id", "label", "key", "vector"],
        )


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _entered(tables: int, probes: int, scale: float, seed: int):
    """(rep, label, dim, cells): all cell hashes of each class, own cell first in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            dims = np.array([len(v) for v in vectors], np.int64)
            out = np.empty((len(vectors), tables * (1 + probes)), np.uint64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                units = np.stack([_unit(np.array(vectors[i], np.float64)) for i in rows])
                out[rows] = cells(units, tables, probes, scale, seed).reshape(len(rows), -1)
            ends = np.arange(len(vectors) + 1, dtype=np.int32) * out.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("label"), batch.column("size"), pa.array(dims), batch.column("vector"), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.view(np.int64).reshape(-1)))],
                names=["rep", "label", "size", "dim", "vector", "cells"],
            )

    return run


def _forest(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes over the links (rows, cols)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, rows, low[cols])
        np.minimum.at(low, cols, low[rows])
        low = low[low]
        if (low == before).all():
            return low


def _block(reps, sizes, sides, own, codes, units, cell, tables, threshold):
    """Links of one pair of blocks: (rep, linked rows, another node of its tree).

    ``sides``: 1 first block, 2 second, 3 both are the same block. A pair
    counts in the first table where the two meet, and there in the smallest
    of their common cells.
    """
    left, right = np.flatnonzero(sides & 1), np.flatnonzero(sides & 2)
    count, rows, cols = np.zeros(len(reps), np.int64), [], []
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        close = units[some] @ units[right].T >= threshold
        close &= own[some][:, None] | own[right][None, :]
        close &= (reps[some][:, None] < reps[right][None, :]) if (sides == 3).all() else (reps[some][:, None] != reps[right][None, :])
        i, j = np.nonzero(close)
        i, j = some[i], right[j]
        for lo in range(0, len(i), 50_000):
            u, v = i[lo : lo + 50_000], j[lo : lo + 50_000]
            first = np.full(len(u), np.iinfo(np.int64).max)
            done = np.zeros(len(u), bool)
            for t in range(tables):
                a, b = codes[u, t], codes[v, t]
                meets = np.concatenate([np.where(a[:, :1] == b, b, np.iinfo(np.int64).max), np.where(b[:, :1] == a, a, np.iinfo(np.int64).max)], 1).min(1)
                now = ~done & (meets != np.iinfo(np.int64).max)
                first[now] = meets[now]
                done |= now
            own_here = first == cell
            u, v = u[own_here], v[own_here]
            np.add.at(count, u, sizes[v])
            np.add.at(count, v, sizes[u])
            rows.append(u)
            cols.append(v)
    low = _forest(np.concatenate(rows), np.concatenate(cols), len(reps)) if rows else np.arange(len(reps))
    hit = np.flatnonzero(count)
    return reps[hit], count[hit], reps[low[hit]]


def _compared(tables: int, probes: int, threshold: float):
    """Rows arrive sorted by (cell, label, dim, i, j); a group ends where that key changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(group: pa.Table):
            if group.num_rows < 2:
                return None
            codes = group.column("cells").combine_chunks().flatten().to_numpy().reshape(group.num_rows, tables, 1 + probes)
            dim = group.column("dim")[0].as_py()
            raw = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            raw = raw / np.abs(raw).max(1, keepdims=True)
            units = raw / np.sqrt((raw * raw).sum(1, keepdims=True))
            args = [group.column(c).to_numpy() for c in ("rep", "size", "side", "own")]
            got = _block(args[0], args[1], args[2], args[3], codes, units, group.column("cell")[0].as_py(), tables, threshold)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["rep", "links", "other"]) if len(got[0]) else None

        keys = ["cell", "label", "dim", "i", "j"]
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_pylist() for k in keys]
            now = list(zip(*columns))
            cut = 0
            for r in range(len(now)):
                if now[r] != last:
                    if r > cut:
                        held.append(batch.slice(cut, r - cut))
                    if held and (out := flush(pa.Table.from_batches(held))) is not None:
                        yield out
                    held, cut, last = [], r, now[r]
            held.append(batch.slice(cut))
        if held and (out := flush(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, tables: int = 4, probes: int = 8, scale: float = 2.0, block: int = 2048, seed: int = 7
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label, ...).

    Vectors with equal, non-null labels and equal length link when the pair is
    found and its cosine is at least ``threshold``. Vectors that are null,
    empty, zero, without vec_id or with null or non-finite components link with
    nothing. Rows that repeat a vec_id are vectors of their own. ``scale`` is
    the size of the unit sphere in lattice units: larger means smaller cells,
    to be raised (with ``probes``) as the table grows. Recall is measured in
    tests/llm. Empty tables give empty results; further columns are ignored.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    rows = stored(rows.mapInArrow(_classed, "vec_id long, label string, key string, vector array<double>"))
    classes = (
        rows.where("key IS NOT NULL").groupBy("key", "label")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    )
    entered = stored(
        classes.select("rep", "label", "size", "vector")
        .mapInArrow(_entered(tables, probes, scale, seed), "rep long, label string, size long, dim long, vector array<double>, cells array<long>")
    )
    place = F.posexplode("cells").alias("at", "cell")
    entries = entered.select("rep", "label", "dim", place).withColumn("own", F.col("at") % (1 + probes) == 0).drop("at")
    keys = ["cell", "label", "dim"]
    counts = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where("n > 1 AND any")
    # Blocks of a cell: a row goes to the pairs (i, j) of blocks that hold its own.
    blocks = F.ceil(F.col("n") / block)
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    met = (
        entries.join(counts, keys).withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(*keys, "rep", "own", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"),
                F.when(F.col("mine") == F.col("with"), 3).when(F.col("mine") < F.col("with"), 1).otherwise(2).alias("side"))
        .join(entered.select("rep", "size", "vector", "cells"), "rep")
        .repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "rep")
    )
    links = stored(met.mapInArrow(_compared(tables, probes, threshold), "rep long, links long, other long"))
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = (
        classes.select("key", "label", "rep", "size").join(counted, "rep", "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "label", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        rows.select("vec_id", "label", "key").join(of_class, ["key", "label"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
