"""Mix sources, languages and topics to target shares by iterative proportional fitting.

The table is summed into cells of source x language x topic. The cells' token
weights are raked: each marginal in turn is scaled to its target until all
hold. A document is then sampled with its cell's weight as probability. Since a
probability ends at one, the cut is part of the fit: what a full cell cannot
give, the others of its level do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from loglantern.llm.words import BREAKS

OTHER = "other"


@dataclass
class Fit:
    """Cell keys with their weight; the shares that were wanted and are met, by dimension and level."""

    cells: list[tuple[str, ...]]
    weight: np.ndarray
    wanted: list[dict[str, float]]
    met: list[dict[str, float]]
    rounds: int


def rake(
    cells: list[tuple[str, ...]], tokens: np.ndarray, targets: list[dict[str, float]], budget: float | None = None, rounds: int = 500, close: float = 1e-6
) -> Fit:
    """Weights of cells such that the shares of sum(tokens * min(1, weight)) meet the targets.

    Levels without tokens are left out and the other targets of their dimension
    scaled up. Levels that a target does not name keep the share they have, and
    the named ones are scaled to what is left. ``budget`` is the total wanted; by default the largest one for
    which no level needs more than it has.
    """
    tokens = np.asarray(tokens, float)
    levels, wanted = [], []
    for d, target in enumerate(targets):
        names = sorted({c[d] for c, n in zip(cells, tokens) if n > 0})
        share = np.array([max(target.get(x, 0.0), 0.0) for x in names])
        own = np.array([0.0 if x in target else sum(n for c, n in zip(cells, tokens) if c[d] == x) for x in names]) / (tokens.sum() or 1.0)
        if share.sum():
            share = share / share.sum() * (1 - own.sum()) + own
        else:
            share = own if own.sum() else np.ones(len(names))
        wanted.append(dict(zip(names, share / share.sum())))
        index = {x: i for i, x in enumerate(names)}
        levels.append(np.array([index.get(c[d], 0) for c in cells], int))
    weight = np.where(tokens > 0, 1.0, 0.0)
    if not tokens.sum():
        return Fit(cells, weight, wanted, [{} for _ in targets], 0)
    goals = [np.array(list(w.values())) for w in wanted]
    has = [np.bincount(at, tokens, len(goal)) for at, goal in zip(levels, goals)]
    if budget is None:
        budget = min((h[g > 0] / g[g > 0]).min() for h, g in zip(has, goals))
    budget = min(budget, tokens.sum())

    def to_budget(w: np.ndarray) -> np.ndarray:
        lo, hi = 0.0, 1.0
        while (tokens * np.minimum(1, hi * w)).sum() < budget * (1 - 1e-12) and hi < 1e12:
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (tokens * np.minimum(1, mid * w)).sum() < budget else (lo, mid)
        return w * hi

    done = 0
    for done in range(1, rounds + 1):
        off = 0.0
        for at, goal in zip(levels, goals):
            weight = to_budget(weight)
            now = np.bincount(at, tokens * np.minimum(1, weight), len(goal))
            now = now / now.sum()
            off = max(off, np.abs(now - goal).max())
            weight = weight * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at]
        if off < close:
            break
    weight = to_budget(weight)
    used = tokens * np.minimum(1, weight)
    met = [dict(zip(w, (np.bincount(at, used, len(w)) / used.sum()).tolist())) for at, w in zip(levels, wanted)]
    return Fit(cells, weight, wanted, met, done)


def length_class(words: Column) -> Column:
    """A stand-in for a topic where the table has none: how long a text is."""
    return F.when(words < 100, "brief").when(words < 400, "short").when(words < 1500, "medium").otherwise("long")


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS + "+"), lambda w: w != "")).cast("long")


DIMENSIONS = ("source", "lang", "topic")


def _weighted(docs: DataFrame, targets: dict[str, dict[str, float]], topic: Column | None, budget: float | None, seed: int) -> DataFrame:
    """``docs`` with __n (tokens), the levels __source, __lang and __topic, __weight and __sampled."""
    if topic is None:
        topic = F.col("topic").cast("string") if "topic" in docs.columns else length_class(F.col("__n"))
    named = {d: [x for x in targets.get(d, {}) if x != OTHER] for d in DIMENSIONS}
    values = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic}
    rows = docs.withColumn("__n", count_words(F.col("text").cast("string")))
    for d in DIMENSIONS:
        level = F.when(values[d].isin(named[d]), values[d]).otherwise(F.lit(OTHER)) if named[d] else F.lit(OTHER)
        rows = rows.withColumn(f"__{d}", level)
    levels = [f"__{d}" for d in DIMENSIONS]
    sums = rows.groupBy(*levels).agg(F.sum("__n").alias("n")).orderBy(*levels).collect()
    cells = [tuple(r[c] for c in levels) for r in sums]
    fit = rake(cells, np.array([r.n for r in sums], float), [targets.get(d) or {OTHER: 1.0} for d in DIMENSIONS], budget)
    weights = rows.sparkSession.createDataFrame(
        [(*c, float(w)) for c, w in zip(cells, fit.weight)], ", ".join(f"{c} string" for c in levels) + ", __weight double"
    )
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    # One row a cell: their number is bounded by the named levels.
    return rows.join(F.broadcast(weights), levels).withColumn("__sampled", chance < F.col("__weight"))


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]], topic: Column | None = None, budget: float | None = None, seed: int = 11
) -> DataFrame:
    """doc_id, n_tokens, source, lang, topic, weight, probability, sampled for each row of ``docs`` (doc_id, text, source, lang, ...).

    ``targets`` gives the shares of tokens (words) for "source", "lang" and
    "topic". Values that it does not name, and nulls, are one level ``other``,
    which keeps the share it has unless ``targets`` names it.
    The cells are as many as the named levels allow, whatever the size of the
    table, and are fitted on the driver. Without ``topic``, a column of that
    name is taken, else the length class. ``sampled`` compares the probability
    with a hash of doc_id: the same rows at every run, rows of one doc_id alike.
    Null texts have no token and the weight of their cell. Empty tables give
    empty results; further columns are ignored.
    """
    rows = _weighted(docs, targets, topic, budget, seed)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__n").alias("n_tokens"), *(F.col(f"__{d}").alias(d) for d in DIMENSIONS),
        F.col("__weight").alias("weight"), F.least("__weight", F.lit(1.0)).alias("probability"), F.col("__sampled").alias("sampled"),
    )


def drawn(
    docs: DataFrame, targets: dict[str, dict[str, float]], topic: Column | None = None, budget: float | None = None, seed: int = 11
) -> DataFrame:
    """The sampled rows of ``docs``, with all their columns."""
    return _weighted(docs, targets, topic, budget, seed).where("__sampled").select(*docs.columns)
