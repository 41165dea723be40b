"""Stores of many blocks: queries are not copied in Python, and blocks travel together."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loglantern.operators import similarity


@pytest.mark.parametrize("earlier", [False, True])
def test_units_of_a_large_store(spark, monkeypatch, earlier):
    """Vectors without near ones: every query visits all blocks, in at most 2 x 16 x 17 comparisons."""
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(vecs)], "id bigint, vec array<double>, s bigint")
    df = df.withColumn("at", F.timestamp_seconds("s")).drop("s")
    compared, groups = similarity._compared, []

    def counting(q, s, keys, *rest):
        groups.append(q.select(*keys).distinct().count())
        return compared(q, s, keys, *rest)

    monkeypatch.setattr(similarity, "BLOCK_ROWS", 100)
    monkeypatch.setattr(similarity, "_compared", counting)
    found = similarity.nearest(df.withColumnRenamed("id", "query_id"), df, 3, earlier_only=earlier, block_rows=4)
    got: dict = {}
    for r in found.orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    for i in range(400):
        assert got.get(i, []) == sorted(range(i if earlier else 400), key=lambda j: (-scores[i, j], j))[:3]
    assert max(groups) <= 2 * 16 * 17


def test_visits_do_not_copy_queries():
    rng = np.random.default_rng(6)
    pivots = similarity._spread(list(rng.normal(size=(40, 8))), 40)
    cells = [{"slice": 0, "pivot": p, "ring": 0, "low": 0.0, "high": 1.5, "n": 10, "first_at": 0} for p in range(40)]
    blocks, _ = similarity._cut(cells, pivots, 4, 0)
    f = pd.DataFrame({"query_id": range(50), "vec": list(rng.normal(size=(50, 8))), "at": 1, "kth": -2.0, "seen": [np.array([0], np.int32)] * 50})
    out = pd.concat(similarity._visits(blocks, 3, False, False)(iter([f])))
    assert len(out) == 50 and all(sorted(u) == list(range(3, 120)) for u in out["unit"])
