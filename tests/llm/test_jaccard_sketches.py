"""Sketches rule out pairs of documents before their texts are joined, and no link."""

import numpy as np
import pytest

from loglantern.llm import jaccard


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_no_link_is_ruled_out(percent):
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, m = rng.integers(1, 400, 2)
        pool = rng.integers(0, 2**63, int(rng.integers(max(n, m), 500))).astype(np.uint64)
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        both = len(np.intersect1d(x, y))
        union = len(x) + len(y) - both
        one, two = jaccard.sketch(x), jaccard.sketch(y)
        size = min(len(one), len(two))
        apart = (int.from_bytes(jaccard.folded(one, size)) ^ int.from_bytes(jaccard.folded(two, size))).bit_count()
        assert apart <= union - both
        if 100 * both >= percent * union:
            assert union - both <= jaccard.most_apart(len(x) + len(y), percent)


def test_pairs_without_a_chance_are_left_out(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(20)]
    sets.append(np.append(sets[0][:-5], np.uint64(7)))
    rows = [(i, len(s), jaccard.sketch(s)) for i, s in enumerate(sets)]
    sketches = spark.createDataFrame(rows * 2, "doc_id long, n long, sketch binary")
    pairs = spark.createDataFrame([(0, i, 1) for i in range(1, 21)] + [(1, 20, 1)], "a long, b long, l long")
    assert [tuple(r) for r in jaccard.sifted(sketches, pairs, 80).collect()] == [(0, 20, 1)]


def test_only_open_documents_of_two_blocks_travel():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    s = [np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(4)]
    s.append(np.append(s[1][:-3], np.uint64(9)))
    block = [5, 5, 6, 6, 6]
    rows = [(5, 6, block[i], i, i, 0, len(x), jaccard.sketch(x)) for i, x in enumerate(s)] + [(6, 6, 6, 4, 4, 0, len(s[4]), jaccard.sketch(s[4]))]
    names = ["block_a", "block_b", "block", "doc", "comp", "e", "n", "sketch"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    got = [r for b in jaccard._open_sides(80)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["block_a"], r["block_b"], r["block"], r["doc"]) for r in got) == [(5, 6, 5, 1), (5, 6, 6, 4)]
