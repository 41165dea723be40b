"""Collocations against the SQL and a direct count; the summaries' promise."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from loglantern.checks.compare import compare, duck
from loglantern.llm import collocations as C
from loglantern.llm.queries import QUERIES, SQL


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top, absorbed=50):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower(text or "")):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        scored = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= absorbed * a and p in (q[:2], q[1:]) for q, b in counts.items()):
                continue
            s, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


ROWS = [
    ("en", "The big red dog. the BIG red dog\tthe big red; Dog the big"), ("en", "of the of the of the of  the, of\tthe"), (None, "x y x y x y x y"),
    ("und", "x y"), ("de", None), ("de", ""), ("de", " \t.;"), ("en", "the big red dog " * 300), ("fr", "é è é è é È a" * 9), ("en", "a"), ("en", "b c d" * 5),
    ("fr", "\x00b a\x0bb a\x0cb a\rb a\nb a!b a?b a:b a"), ("en", "The big red dog. the BIG red dog\tthe big red; Dog the big"),
]


@pytest.mark.parametrize("least,top", [(2, 2000), (3, 4), (10, 2000)])
def test_small_texts(spark, least, top, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "q") for r in ROWS], "lang string, text string, n int, phrase string")
    got = C.collocations(df, least, top)
    assert sorted(map(tuple, got.collect())) == plain(ROWS, least, top)
    assert C.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name):
    d = f"/root/testdata/{name}"
    ok, note = compare(spark, duck(d), d, QUERIES["op13_collocations"], SQL["op13_collocations"])
    assert ok, note


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40), max_size=12), st.integers(2, 6))
def test_every_frequent_key_survives(parts, least):
    total = Counter(k for p in parts for k in p)
    summary = C.Summary(sum(total.values()) // least + 1)
    for p in parts:
        keys, counts = np.unique(np.array(p, np.uint64), return_counts=True)
        summary.merge(keys, counts)
        assert len(summary.keys) <= summary.size
    left = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert {k for k, f in total.items() if f >= least} <= set(summary.frequent(least).tolist()) <= set(left)
    assert all(c <= total[k] <= c + summary.lowered for k, c in left.items())


def test_many_parts_and_small_blocks(spark, monkeypatch):
    """Partition by partition and block by block, the summaries keep the same frequent runs."""
    monkeypatch.setattr(C, "HELD", 64)
    monkeypatch.setattr(C, "BLOCK", 16)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in ROWS]), pa.array([r[1] for r in ROWS])], names=["lang", "text"])
    parts = [r for b in C._summarised(7)(iter([batch, batch.slice(3, 5)])) for r in b.to_pylist()]
    mass = Counter()
    for r in parts:
        mass[r["part"]] += r["mass"]
    parts.sort(key=lambda r: r["part"])
    whole = pa.RecordBatch.from_pylist([{**{k: r[k] for k in ("part", "hashes", "counts")}, "total": mass[r["part"]]} for r in parts])
    kept = {h for b in C._survivors(5)(iter([whole])) for h in b.column("hash").to_numpy().view(np.uint64).tolist()}
    true = Counter()
    for r in parts:
        for h, c in zip(np.frombuffer(r["hashes"], "<u8").tolist(), np.frombuffer(r["counts"], "<u4").tolist()):
            true[h] += c
    assert len(mass) > 1 and {h for h, c in true.items() if c >= 5} <= kept
