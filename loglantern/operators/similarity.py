"""Exact nearest incidents by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loglantern import fixed_values as V
from loglantern.functions.embedding import embed
from loglantern.functions.vectors import cosine, incident_text
from loglantern.operators.panes import latest_per_key
from loglantern.operators.related import salted_lookup
from loglantern.session import written

BLOCK_ROWS = 16384
#: Rows of either side that one comparison holds at most, up to the spread of a hash.
UNIT_ROWS = 32768
_CELLS = 1 << 20
# Scores are ranked on this many decimals, so copies of one text tie exactly
# and fall to the id order.
RANK_DECIMALS = 9


def with_embedding(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("embedding", embed(incident_text()))


def similar_to_text(store: DataFrame, text: str, k: int = V.SIMILAR_LIMIT) -> DataFrame:
    """The ``k`` stored incidents closest to one text: one scan, a top-k per task, one merge."""
    spark = store.sparkSession
    query = spark.range(1).select(embed(F.lit(text)).alias("v")).scalar()
    return (
        store.withColumn("_query", query)
        .withColumn("score", F.round(cosine(F.col("embedding"), F.col("_query")), RANK_DECIMALS))
        .select("id", "ts", "title", "summary", "severity", "category", "score")
        .orderBy(F.col("score").desc(), "id")
        .limit(k)
    )


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _by_length(vectors: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length; null has the length 0."""
    lists = vectors.combine_chunks()
    flat = pc.fill_null(lists.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out.append((rows, flat.reshape(len(rows), n) if len(rows) == len(sizes) else flat[starts[rows][:, None] + np.arange(n)]))
    return out


def _block_top_k(queries: pa.Table, store: pa.Table, k: int, earlier_only: bool) -> pa.Table:
    """Top ``k`` of one store block for every query of one query block, by the cosine over the shorter length of the two; 0 for null.

    Where a query has a ``kth`` score, rows below it are left out.
    """
    rank = np.empty(len(store), np.int64)
    rank[pc.sort_indices(store["id"], null_placement="at_start").to_numpy()] = np.arange(len(store))
    q_at, s_at = queries["at"].to_numpy(), store["at"].to_numpy()
    kth = queries["kth"].to_numpy() if "kth" in queries.column_names else np.full(len(queries), -np.inf)
    columns, step = _by_length(store["vec"]), max(1, _CELLS // len(store))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows, vectors in _by_length(queries["vec"]):
        size = vectors.shape[1]
        sides = [(cols, _unit(vectors[:, : m.shape[1]]), _unit(m[:, :size])) for cols, m in columns if min(size, m.shape[1])]
        for first in range(0, len(rows), step):
            part = rows[first : first + step]
            scores = np.zeros((len(part), len(store)))
            for cols, q, s in sides:
                if len(cols) == len(store):
                    np.matmul(q[first : first + step], s.T, out=scores)
                else:
                    scores[:, cols] = q[first : first + step] @ s.T
            scores[~np.isfinite(scores)] = -np.inf
            if earlier_only:
                scores[s_at[None, :] >= q_at[part][:, None]] = -np.inf
            # Everything at or above the k-th best score, ties included.
            floor = kth[part].copy()
            unknown = np.flatnonzero(floor < -1)
            if len(unknown):
                floor[unknown] = np.partition(scores[unknown], -k, axis=1)[:, -k] if len(store) > k else -np.inf
            row, col = np.nonzero((scores >= floor[:, None] - _SCORE_MARGIN) & (scores > -np.inf))
            value = np.round(scores[row, col], RANK_DECIMALS)
            best = np.lexsort((rank[col], -value, row))
            row, col, value = row[best], col[best], value[best]
            keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
            out.append((part[row[keep]], col[keep], value[keep]))
    q, i, sc = (np.concatenate([o[j] for o in out]) for j in range(3))
    # 0.0 rather than -0.0, which would sort apart.
    return pa.table({"query_id": queries["query_id"].take(pa.array(q)), "id": store["id"].take(pa.array(i)), "score": pa.array(sc + 0.0)})


def _chunked(queries: DataFrame, store: DataFrame, k: int, earlier_only: bool) -> DataFrame:
    """Top ``k`` where the store fits one block: each task compares its share of the queries with all of it."""
    chunks = max(2, queries.sparkSession.sparkContext.defaultParallelism, math.ceil(queries.count() / UNIT_ROWS))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    s = store.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return _compared(q, s, ["qb"], k, earlier_only)


def _compared(q: DataFrame, s: DataFrame, keys: list[str], k: int, earlier_only: bool) -> DataFrame:
    """Top ``k`` of every store block for every query that is sent to it."""
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("id", s.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": left["query_id"][:0], "id": right["id"][:0], "score": pa.array([], pa.float64())})
        return _block_top_k(left, right, k, earlier_only)

    return q.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInArrow(run, schema)


#: Angles are compared with this margin, scores with the other: far above the rounding of either.
_ANGLE_MARGIN, _SCORE_MARGIN = 1e-6, 2 * 10.0**-RANK_DECIMALS
_RING = 0.05
MOST_PIVOTS = 512
MOST_SLICES = 16
#: Pivot of vectors that have no angle to the others: null, zero, or of another length.
_LOOSE = -1


class Blocks(NamedTuple):
    """Store blocks: those of one time slice and pivot, between two angles from it. A few numbers each."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    first_at: np.ndarray
    #: Blocks are sent in groups of neighbours: the first block of each group, and its first unit. Large blocks have several units.
    starts: np.ndarray
    units: np.ndarray

    def best(self, angles: np.ndarray) -> np.ndarray:
        """The highest score a row of each block can have, for queries with these angles to the pivots (NaN: unknown)."""
        loose = self.pivot == _LOOSE
        to = angles[:, np.where(loose, 0, self.pivot)] if len(self.pivots) else np.full((len(angles), len(self.pivot)), np.nan)
        gap = np.maximum(np.maximum(to - self.high, self.low - to) - _ANGLE_MARGIN, 0)
        return np.where(loose[None, :] | np.isnan(gap), 1.0, np.cos(gap))

    def sent(self, blocks: np.ndarray) -> np.ndarray:
        """The groups in which a row of ``blocks`` has one."""
        return np.logical_or.reduceat(blocks, self.starts, axis=1)


def _spread(sample: list[np.ndarray], n: int) -> np.ndarray:
    """Up to ``n`` unit vectors of the commonest length, each the farthest from those before; near ones stand together."""
    usable = [v for v in sample if v is not None and len(v) and np.isfinite(v).all() and (v != 0).any()]
    if not usable:
        return np.zeros((0, 0))
    sizes = pd.Series([len(v) for v in usable])
    unit = _unit(np.stack([v for v in usable if len(v) == sizes.mode().iloc[0]]))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    left, chain = unit[chosen[1:]], [unit[0]]
    while len(left):
        i = int((left @ chain[-1]).argmax())
        chain.append(left[i])
        left = np.delete(left, i, axis=0)
    return np.stack(chain)


def _angles(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    """Angle of each vector to each pivot; NaN where it has none."""
    out = np.full((len(vectors), max(len(pivots), 1)), np.nan)
    size = pivots.shape[1]
    rows = [i for i, v in enumerate(vectors) if v is not None and size and len(v) == size and np.isfinite(v).all() and np.any(v)]
    if rows:
        out[rows] = np.arccos(np.clip(_unit(np.stack([np.asarray(vectors.iloc[i], np.float64) for i in rows])) @ pivots.T, -1, 1))
    return out


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot, the ring around it and the angle to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            angles = _angles(f["vec"], pivots)
            known = ~np.isnan(angles[:, 0])
            home = np.where(known, np.where(np.isnan(angles), np.inf, angles).argmin(axis=1), _LOOSE)
            angle = np.where(known, angles[np.arange(len(f)), np.maximum(home, 0)], 0.0)
            yield f.assign(pivot=home.astype("int32"), ring=(angle / _RING).astype("int32"), angle=angle)

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL("pivot int, ring int, angle double").fields])
    return df.mapInPandas(run, schema)


def _grouped(rows: list[int], most: int, merge: int) -> list[tuple[int, int, int]]:
    """(group, first unit, units) of each run of ``rows``: neighbours of up to ``merge`` rows in all share a group, more than ``most`` are dealt."""
    groups: list[list[int]] = []
    out = []
    for n in rows:
        if groups and groups[-1][0] + n <= merge:
            groups[-1][0] += n
        else:
            first = groups[-1][1] + groups[-1][2] if groups else 0
            groups.append([n, first, max(1, math.ceil(n / most))])
        out.append((len(groups) - 1, *groups[-1][1:]))
    return out


def _cut(cells: list, pivots: np.ndarray, block_rows: int, merge: int) -> tuple[Blocks, list[tuple[int, int, int, int, int]]]:
    """Blocks of up to ``block_rows`` from neighbouring rings, and (slice, pivot, ring, first unit, units) of each ring."""
    blocks: list[list] = []
    place = []
    for c in sorted(cells, key=lambda c: (c["slice"], c["pivot"], c["ring"])):
        last = blocks[-1] if blocks else None
        if last and last[0] == (c["slice"], c["pivot"]) and last[3] + c["n"] <= block_rows:
            last[2], last[3], last[4] = c["high"], last[3] + c["n"], min(last[4], c["first_at"])
        else:
            blocks.append([(c["slice"], c["pivot"]), c["low"], c["high"], c["n"], c["first_at"]])
        place.append((c["slice"], c["pivot"], c["ring"], len(blocks) - 1))
    groups = _grouped([b[3] for b in blocks], max(block_rows, merge), merge)
    starts = np.unique([g[0] for g in groups], return_index=True)[1]
    units = np.array([groups[i][1] for i in starts] + [groups[-1][1] + groups[-1][2]])
    columns = [np.array([b[i] for b in blocks]) for i in (1, 2, 3, 4)]
    return Blocks(pivots, np.array([b[0][1] for b in blocks]), *columns, starts, units), [(*p[:3], *groups[p[3]][1:]) for p in place]


def _visits(blocks: Blocks, k: int, earlier_only: bool, probe: bool):
    """Add the groups and units each query is sent to: first a few likely ones with ``k`` rows, then all others that may still hold a better row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, _CELLS // max(len(blocks.pivot), 1))
        for f in frames:
            for first in range(0, len(f), step):
                part = f.iloc[first : first + step]
                best = blocks.best(_angles(part["vec"], blocks.pivots))
                if earlier_only:
                    best[blocks.first_at[None, :] >= part["at"].to_numpy()[:, None]] = -np.inf
                if probe:
                    order = np.argsort(-best, axis=1, kind="stable")
                    rows = np.cumsum(blocks.rows[order], axis=1)
                    likely = np.zeros(best.shape, bool)
                    np.put_along_axis(likely, order, np.concatenate([np.zeros((len(part), 1), int), rows[:, :-1]], axis=1) < 2 * k, axis=1)
                    go = blocks.sent(likely & (best > -np.inf))
                else:
                    go = blocks.sent((best >= part["kth"].to_numpy()[:, None] - _SCORE_MARGIN) & (best > -np.inf))
                    seen = part["seen"]
                    go[np.repeat(np.arange(len(part)), seen.map(len)), np.concatenate([*seen, np.zeros(0, np.int32)]).astype(np.int64)] = False
                row, group = np.nonzero(go)
                times = np.diff(blocks.units)[group]
                start = np.cumsum(times) - times
                unit = np.repeat(blocks.units[group] - start, times) + np.arange(int(times.sum()))
                ends = np.cumsum(np.bincount(row, minlength=len(part)))[:-1]
                last = np.cumsum(np.bincount(row, times, len(part)).astype(np.int64))[:-1]
                # The units only: a copy of a query for each of them is made row by row as they are exploded.
                yield part.assign(seen=np.split(group.astype("int32"), ends), unit=np.split(unit.astype("int32"), last))

    return run


def _pruned(queries: DataFrame, store: DataFrame, k: int, earlier_only: bool, block_rows: int, n: int, pivots: int | None) -> DataFrame:
    """Top ``k`` by blocks around pivots: a probe gives each query its k-th best, which rules most other blocks out."""
    # A store that would give very many blocks is sent in larger units, so that their number does not grow with it.
    merge = min(UNIT_ROWS, n // 16) if n > BLOCK_ROWS else 0
    block_rows = max(block_rows, merge // 16)
    slices = min(MOST_SLICES, math.ceil(n / block_rows)) if earlier_only else 1
    wanted = min(MOST_PIVOTS, pivots or math.ceil(4 * n / block_rows / slices))
    picked = store.where("size(vec) > 0").orderBy(F.xxhash64("id"), "id").limit(4 * wanted).select("vec").toPandas()["vec"]
    centres = _spread([np.asarray(v, np.float64) for v in picked], wanted)

    bounds = store.approxQuantile("at", [i / slices for i in range(1, slices)], 0.01) if slices > 1 else []
    slice_of = lambda at: F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= at)) if bounds else F.lit(0)

    placed = _placed(store, centres)
    if not earlier_only:
        # Of equal vectors only the k smallest ids can be seen.
        placed = latest_per_key(placed, ["vec"], [F.col("id").asc()], k).drop("_rank")
    rows = written(placed.withColumn("slice", slice_of(F.col("at"))))
    cells = (
        rows.groupBy("slice", "pivot", "ring")
        .agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("at").alias("first_at"))
        .collect()
    )
    blocks, place = _cut(cells, centres, block_rows, merge)
    where = queries.sparkSession.createDataFrame(place, "slice int, pivot int, ring int, first int, parts int")
    # At most MOST_SLICES slices, MOST_PIVOTS pivots and 63 rings.
    rows = (
        rows.join(F.broadcast(where), ["slice", "pivot", "ring"])
        .withColumn("unit", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .select("id", "vec", "at", "unit")
    )

    homes = _placed(queries, centres).withColumn("slice", slice_of(F.col("at")))
    asked = written(homes.drop("ring", "angle"))
    groups = sorted(asked.groupBy("slice", "pivot").agg(F.count("*").alias("n")).collect(), key=lambda g: (g["slice"], g["pivot"]))
    units = _grouped([g["n"] for g in groups], max(block_rows, merge), merge)
    numbered = queries.sparkSession.createDataFrame(
        [(g["slice"], g["pivot"], *u[1:]) for g, u in zip(groups, units)], "slice int, pivot int, first int, parts int"
    )
    asked = (
        asked.join(F.broadcast(numbered), ["slice", "pivot"])
        .withColumn("share", F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        .select("query_id", "vec", "at", "share")
    )
    keys = ["share", "unit"]

    def visited(df: DataFrame, probe: bool) -> DataFrame:
        schema = T.StructType([*[f for f in df.schema.fields if f.name != "seen"], *T.StructType.fromDDL("seen array<int>, unit array<int>").fields])
        return written(df.mapInPandas(_visits(blocks, k, earlier_only, probe), schema))

    def sent(df: DataFrame) -> DataFrame:
        pairs = df.select("share", F.explode("unit").alias("unit")).distinct()
        q = df.drop("seen").withColumn("unit", F.explode("unit"))
        return _compared(q, rows.join(written(pairs), "unit"), keys, k, earlier_only)

    probed = visited(asked, True)
    first = written(latest_per_key(sent(probed), ["query_id"], [F.col("score").desc(), F.col("id").asc()], k))
    kth = first.where(F.col("_rank") == k).select("query_id", F.col("score").alias("kth"))
    again = probed.drop("unit").join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
    return first.drop("_rank").unionByName(sent(visited(again, False)))


def nearest(
    queries: DataFrame,
    store: DataFrame,
    k: int = V.SIMILAR_LIMIT,
    *,
    earlier_only: bool = False,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """Exact top ``k`` per query as (query_id, id, score, position).

    ``queries`` holds (query_id, vec[, at]) with unique ids and ``store`` (id,
    vec[, at]); ``earlier_only`` keeps stored rows with ``at`` before the
    query's. Equal scores fall to the smaller id.

    A store of up to ``block_rows`` rows is compared in one block by many
    tasks. A larger one is cut into blocks around pivots, and by time with
    ``earlier_only``: by the triangle inequality, no row of a block can be
    nearer than the block's angles allow. Each query is sent to its likeliest
    blocks first and then only to those that may hold something better than the
    k-th best found, and that begin before it. Vectors without near ones may
    have to visit every block. Neighbouring blocks of a large store travel
    together, a sixteenth of it or ``UNIT_ROWS`` rows at a time. No pair of rows
    is emitted. Both inputs are read several times: pass stored tables.
    """

    def at(df: DataFrame) -> Column:
        return F.unix_micros(F.col("at")) if earlier_only and "at" in df.columns else F.lit(0).cast("bigint")

    rows = store.select("id", "vec", at(store).alias("at"))
    asked = queries.select("query_id", "vec", at(queries).alias("at"))
    size = store.count()
    if size <= block_rows:
        return _top(_chunked(asked, rows, k, earlier_only), k)
    # Blank queries have the score 0 with everything: one answer for all of a time.
    blank = ~F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    empty = F.array().cast(asked.schema["vec"].dataType)
    blanks = asked.where(blank)
    once = blanks.groupBy("at").agg(F.min("query_id").alias("query_id")).select("query_id", empty.alias("vec"), "at")
    found = written(_top(_pruned(asked.where(~blank).unionByName(once), rows, k, earlier_only, block_rows, size, pivots), k))
    lists = (
        found.join(once.select("query_id", "at"), "query_id")
        .groupBy("at")
        .agg(F.collect_list(F.struct("id", "score", "position")).alias("l"))
    )
    shared = salted_lookup(blanks.select("query_id", "at"), lists, ["at"], ["query_id"]).select("query_id", F.inline("l"))
    return found.join(once.select("query_id"), "query_id", "left_anti").unionByName(shared)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc()]
    return latest_per_key(found, ["query_id"], order, k).withColumnRenamed("_rank", "position")


def similar_incidents(queries: DataFrame, store: DataFrame, k: int = V.SIMILAR_LIMIT) -> DataFrame:
    """Nearest incidents of many texts. ``queries`` holds (query_id, text)."""
    vectors = queries.select("query_id", embed(F.col("text")).alias("vec"))
    hits = nearest(vectors, store.select("id", F.col("embedding").alias("vec")), k)
    shown = store.select("id", "ts", "title", "summary", "severity", "category")
    return hits.join(shown, "id")
