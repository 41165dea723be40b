"""Whitening against numpy over all rows, and odd vectors."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loglantern.llm import whitening
from loglantern.llm.queries import QUERIES


def plain(vectors: list[list[float]], components: int = 8, counts: bool = True):
    """(n, S, whitened matrix of the distinct x, explained) the direct way."""
    xs = [tuple(math.floor(1024 * c) + 100000 for c in v) for v in vectors]
    fit = xs if counts else list(dict.fromkeys(xs))
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    z = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(values)[::-1]
    order = order[values[order] > max(values.max(), 0) * len(values) * np.finfo(float).eps][:components]
    rows = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in xs])
    return n, sums, xs, rows @ (axes[:, order] / np.sqrt(values[order])), values[order] / np.trace(z.T @ z / n)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_numpy(spark, name):
    d = f"/root/testdata/{name}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    n, sums, xs, whitened, explained = plain([r.embedding for r in rows])
    got = QUERIES["op11_embedding_whitening"](spark, d).collect()
    assert len(got) == len(rows) * 8
    at = {r.vec_id: i for i, r in enumerate(rows)}
    by = {(r.vec_id, r.component): r for r in got}
    signs = [np.sign(sum(by[r.vec_id, c].whitened * whitened[at[r.vec_id], c - 1] for r in rows)) for c in range(1, 9)]
    for (v, c), r in by.items():
        i = at[v]
        assert r.n == n and r.deviation == sum((n * x - s) ** 2 for x, s in zip(xs[i], sums))
        assert abs(r.whitened - signs[c - 1] * whitened[i, c - 1]) < 1e-7
        assert abs(r.explained / explained[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.2], [0.5, -0.3], [0.5, -0.3], [-0.7, 0.9]]
    bad = [None, [], [None, 1.0], [nan, 1.0], [inf, 0.0], [1e30, 0.0], [1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, 9, 1) for i, v in enumerate(good)] + [(None, good[0], 9, 1), (0, good[0], 9, 1)]
    rows += [(100 + i, v, 9, 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id int, vector array<double>, n int, key int")
    got = whitening.whiten(df, "vec_id", "vector").collect()
    assert Counter(r.vec_id for r in got) == {0: 4, 1: 2, 2: 2, 3: 2, None: 2}
    n, sums, xs, whitened, _ = plain(good + [good[0]] * 2)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert {int(r.deviation) for r in got if r.vec_id == 3} == {sum((n * x - s) ** 2 for x, s in zip(xs[3], sums))}
    once = whitening.whiten(df, "vec_id", "vector", weights="one").collect()
    assert {r.n for r in once} == {3} and len(once) == len(got)
    assert whitening.whiten(df.where("vec_id >= 100 AND vec_id < 106"), "vec_id", "vector").collect() == []
    assert whitening.whiten(df.limit(0), "vec_id", "vector").collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "v long, e array<float>")
    assert whitening.whiten(same, "v", "e").collect() == []


def test_exact_beyond_64_bits():
    x = np.array([[2**40, 5], [7, -3]], np.int64)
    sums = [3 * 2**50, 1]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"a", b"b"]), pa.array([1, 1]), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "weight", "x"]
    )
    (got,) = whitening._whitened(2, 2**20, sums, np.eye(2))(iter([batch]))
    want = [sum((2**20 * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    assert max(want) > 2**63 and [int(v) for v in got.column("deviation").to_pylist()] == want
