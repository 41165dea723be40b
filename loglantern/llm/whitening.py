"""Whitening of vectors: weighted covariance of distinct integer vectors, principal components, unit variances.

Each vector becomes integers x = floor(1024 c) + 100000. Equal x-vectors are
grouped, so sums, covariance and projection handle each distinct vector once,
with its number of copies (or one) as weight; the projections are joined back
to the rows. Sums are exact; partial matrices are added in a tree, so the driver
holds a few matrices of dimensions x dimensions and never a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loglantern.llm.tables import join_counted, stored

SCALE, SHIFT = 1024, 100000
#: Beyond this an entry has no 64-bit x; its vector counts as not finite.
LARGEST = float(2**63 - 2**20)
#: Dimensions the covariance may have: the driver holds a few matrices of this size (128 MB each).
MOST_DIMS = 4096
_SAFE = 2**62
_CHUNK = 1 << 21


def _matrix(blobs: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), "<i8").reshape(-1, dims)


def _blobs(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(x)]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dims, key, x) of each usable vector: x as bytes, and the digest of these as key."""
    for batch in batches:
        column = batch.column("vector")
        flat = column.flatten()
        entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.asarray(column.value_lengths().fill_null(0))
        ends = np.cumsum(sizes)
        entry = (np.floor(entries * SCALE) + SHIFT) if len(entries) else entries
        bad = np.concatenate([[0], np.cumsum(~(np.abs(entry) < LARGEST))])
        usable = (sizes > 0) & (bad[ends] == bad[ends - sizes])
        with np.errstate(invalid="ignore"):
            x = np.where(np.abs(entry) < LARGEST, entry, 0).astype("<i8")
        at = np.flatnonzero(usable)
        blobs = [x[ends[i] - sizes[i] : ends[i]].tobytes() for i in at]
        keys = [hashlib.blake2b(b, digest_size=16).digest() for b in blobs]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(at)), pa.array(sizes[at], pa.int64()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())],
            names=["id", "dims", "key", "x"],
        )


def _sums(dims: int):
    """Exact weighted sums of one task's vectors as decimals, with the weight last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims + 1)
        for batch in batches:
            w = batch.column("weight").to_numpy()
            x = _matrix(batch.column("x"), dims)
            if not len(w):
                continue
            largest = max(int(np.abs(x).max()), 1) * int(w.sum())
            part = (w @ x if largest < _SAFE else w.astype(object) @ x.astype(object)).tolist()
            total = [int(a) + int(b) for a, b in zip(total, [*part, int(w.sum())])]
        values = pa.array([[Decimal(v) for v in total]], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([values], names=["sums"])

    return run


def _scatter(dims: int, n: int, sums: list[int], loads: np.ndarray | None, shift: np.ndarray | None, buckets: int):
    """One task's weighted products of centred vectors: (bucket, task, matrix), a row of weighted residues on top.

    With ``loads`` the products are those of the projections less ``shift``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = dims if loads is None else loads.shape[1]
        total = np.zeros((size + 1, size))
        rows = 0
        for batch in batches:
            w = batch.column("weight").to_numpy().astype(np.float64)
            x = _matrix(batch.column("x"), dims)
            step = max(1, _CHUNK // dims)
            for i in range(0, len(w), step):
                z = _centred(x[i : i + step], n, sums)
                if loads is not None:
                    z = z @ loads - shift
                weighted = z * w[i : i + step, None]
                total[0] += weighted.sum(axis=0)
                total[1:] += weighted.T @ z
                rows += len(z)
        if rows:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task % buckets], pa.int32()), pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                names=["bucket", "task", "matrix"],
            )

    return run


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from the exact integers n x - S."""
    return _deviates(x, n, sums).astype(np.float64) / n


def _deviates(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S in 64 bits where they hold it, else as Python integers."""
    largest = max(int(np.abs(x).max(initial=0)), 1) * n + max(map(abs, sums), default=0)
    if largest < _SAFE:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _added(table: pa.Table) -> pa.Table:
    """The sum of a bucket's matrices, in the order of their tasks."""
    table = table.sort_by("task")
    total = sum(np.frombuffer(m.as_py(), np.float64) for m in table.column("matrix"))
    return pa.table({"bucket": table.column("bucket")[:1], "matrix": pa.array([total.tobytes()], pa.binary())})


def _gathered(vectors: DataFrame, dims: int, n: int, sums: list[int], loads: np.ndarray | None = None, shift: np.ndarray | None = None) -> np.ndarray:
    """Products over all vectors: per task, then per bucket of tasks, then here."""
    buckets = isqrt(vectors.rdd.getNumPartitions()) + 1
    size = dims if loads is None else loads.shape[1]
    parts = vectors.mapInArrow(_scatter(dims, n, sums, loads, shift, buckets), "bucket int, task int, matrix binary")
    rows = parts.groupBy("bucket").applyInArrow(_added, "bucket int, matrix binary").orderBy("bucket").collect()
    total = np.zeros((size + 1) * size)
    for row in rows:
        total += np.frombuffer(row["matrix"], np.float64)
    return total.reshape(size + 1, size)


def _whitened(dims: int, n: int, sums: list[int], loads: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            d = _deviates(x, n, sums)
            largest = int(np.abs(d).max(initial=0))
            if d.dtype == object or largest * largest * dims >= _SAFE:
                d = d.astype(object)
            deviation = [Decimal(int(v)) for v in (d * d).sum(axis=1)] if len(d) else []
            z = d.astype(np.float64) / n @ loads
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("weight"), batch.column("x"), pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(z), pa.list_(pa.float64()))],
                names=["key", "copies", "x", "deviation", "whitened"],
            )

    return run


_RESULT = "id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id: str, vector: str, components: int = 8, weights: str = "counts") -> DataFrame:
    """Whitened principal components of the vectors in ``rows``.

    One row per vector and component: ``id``'s column, component (from 1 by
    falling eigenvalue), n (weight of the fit), deviation (exact sum of
    (n x - S)^2 over the dimensions, decimal), whitened, explained (share of
    the trace), identity_error (largest absolute entry of the covariance of
    whitened less the identity). ``weights`` is ``counts`` (a distinct
    x-vector weighs as often as it occurs) or ``one``.

    Vectors that are null, empty, hold a null or non-finite entry or one whose
    x does not fit 64 bits have no rows, nor have vectors of another length
    than the commonest (ties: the shorter). Repeated rows and ids are kept, a
    null id stays null, further columns are ignored. Components whose
    eigenvalue is zero to double precision are left out, so equal vectors
    alone, and an empty table, give no rows. Signs: a component's largest
    absolute entry (the first of equals) is positive.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    kind = rows.schema[id].dataType.simpleString()
    result = _RESULT.format(id=kind).replace("id ", f"`{id}` ", 1)
    spark = rows.sparkSession
    source = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    coded = source.mapInArrow(_coded, f"id {kind}, dims long, key binary, x binary")
    groups = stored(coded.groupBy("dims", "key", "x").agg(F.count(F.lit(1)).alias("weight")))
    commonest = groups.groupBy("dims").agg(F.sum("weight").alias("n")).orderBy(F.col("n").desc(), "dims").first()
    if commonest is None:
        return spark.createDataFrame([], result)
    dims = commonest["dims"]
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} entries: the covariance has {MOST_DIMS} dimensions at most")
    distinct = groups.where(F.col("dims") == dims).drop("dims")
    fit = distinct if weights == "counts" else distinct.withColumn("weight", F.lit(1).cast("long"))

    places = fit.select("x", "weight").mapInArrow(_sums(dims), "sums array<decimal(38,0)>")
    exact = places.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    *sums, n = (int(r["v"]) for r in exact)

    products = _gathered(fit.select("x", "weight"), dims, n, sums)
    residue = products[0] / n
    covariance = products[1:] / n - np.outer(residue, residue)
    covariance = (covariance + covariance.T) / 2
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    real = values > max(values[0], 0.0) * dims * np.finfo(float).eps
    kept = min(components, int(real.sum()))
    if not kept:
        return spark.createDataFrame([], result)
    axes = axes[:, :kept]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    loads = axes / np.sqrt(values[:kept])
    explained = values[:kept] / np.trace(covariance)

    again = _gathered(fit.select("x", "weight"), dims, n, sums, loads, residue @ loads)
    mean = again[0] / n
    error = float(np.abs(again[1:] / n - np.outer(mean, mean) - np.eye(kept)).max())

    projected = stored(
        distinct.mapInArrow(
            _whitened(dims, n, sums, loads), "key binary, copies long, x binary, deviation decimal(38,0), whitened array<double>"
        ).drop("x")
    )
    found = join_counted(stored(coded.where(F.col("dims") == dims).select("id", "key")), projected, ["key"], "copies")
    share = F.array(*[F.lit(float(v)) for v in explained])
    return found.select(F.col("id").alias(id), "deviation", F.posexplode("whitened").alias("_c", "whitened")).select(
        id, (F.col("_c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("_c") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
