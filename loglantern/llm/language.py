"""Language of a text: averaged hashed subword embeddings and a linear softmax.

A text's letters, lower-cased, with one space for whatever lies between words,
are cut into runs of two, three and four characters. Each run is hashed to an
embedding; the mean of the embeddings goes through a linear softmax. Both
layers are trained by stochastic gradient descent in numpy on a bounded,
balanced sample of labelled rows; a held-back part of it sets the temperature
of the scores and the score below which an answer is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loglantern.llm.memory import lean

SIZES = (2, 3, 4)
UNKNOWN = "und"
_KEYS = np.random.default_rng(404).integers(1, 2**62, (len(SIZES), max(SIZES))).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Characters taken at once, so that one very long text needs little memory.
BLOCK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = True
    return out


def grams(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the subwords of ``text``, block by block; none if it has no letter."""
    for at in range(0, len(text), BLOCK):
        part = text[max(0, at - max(SIZES) + 1) : at + BLOCK].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([[32], np.where(_letters()[codes], codes, 32), [32]]).astype(np.uint64)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if len(codes) < 3:
            continue
        found = []
        for n, keys in zip(SIZES, _KEYS):
            if len(codes) < n:
                continue
            h = np.zeros(len(codes) - n + 1, np.uint64)
            for j in range(n):
                h += codes[j : len(codes) - n + 1 + j] * keys[j]
            h ^= h >> np.uint64(29)
            h *= keys[0]
            found.append((h >> np.uint64(32)).astype(np.int64) % buckets)
        yield np.concatenate(found)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Trained layers folded into one table of buckets x languages, with temperature and rejection; ``rejected`` is the held-back rows' share below ``least``."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, least: float, rejected: float = 0.0):
        self.langs, self.table, self.bias, self.temperature, self.least, self.rejected = langs, table, bias, temperature, least, rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, False
        total, n = np.zeros(len(self.langs)), 0
        for g in grams(text, len(self.table)):
            if len(g) > len(self.table):
                total += np.bincount(g, minlength=len(self.table)) @ self.table
            else:
                total += self.table[g].sum(0, dtype=np.float64)
            n += len(g)
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.least)


def limit(score: np.ndarray, good: np.ndarray, precision: float) -> float:
    """The least score, one half or more, from which answers are right at the rate ``precision``.

    The limit rises above one half only where it rejects no more right answers
    than wrong ones: wrong labels, which no score tells apart, cannot drive it
    up. If no such limit has the rate, the one with the most right answers less
    wrong ones is taken.
    """
    score, good = score[order := np.argsort(score, kind="stable")], good[order]
    limits = np.concatenate([[0.5], np.unique(score[score > 0.5])])
    at = np.searchsorted(score, limits)
    start = at[0]
    right = np.concatenate([[0], np.cumsum(good)])
    kept = (right[-1] - right[at]) / np.maximum(len(score) - at, 1)
    gain = (at - start) - 2 * (right[at] - right[start])
    fair = gain >= 0
    exact = np.flatnonzero(fair & (kept >= precision) & (at < len(score)))
    return float(limits[exact[0] if len(exact) else int(gain.argmax())])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(
    x: np.ndarray, y: np.ndarray, langs: list[str], buckets: int, dim: int = 16, epochs: int = 4, batch: int = 32, rate: float = 1.0, least_steps: int = 700, precision: float = 0.995, seed: int = 3
) -> Model:
    """Stochastic gradient descent on rows of bucket numbers ``x`` (-1 pads) with language numbers ``y``;
    small samples are gone through more often, up to ``least_steps`` batches.

    Every fifth row is held back. Temperature: the one of a grid with the least
    log loss there. Rejection: ``limit`` of the scores there.
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (buckets + 1, dim))
    emb[buckets] = 0.0
    out, bias = rng.normal(0, 0.1, (dim, len(langs))), np.zeros(len(langs))
    x = np.where(x < 0, buckets, x)
    sizes = np.maximum((x < buckets).sum(1), 1)[:, None]
    back = np.arange(len(x)) % 5 == 4
    rows = np.flatnonzero(~back)
    epochs = max(epochs, -(-least_steps * batch // max(1, len(rows))))
    steps, step = max(1, epochs * -(-len(rows) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), batch):
            some = rows[at : at + batch]
            mean = emb[x[some]].sum(1) / sizes[some]
            error = _softmax(mean @ out + bias)
            error[np.arange(len(some)), y[some]] -= 1.0
            pace = rate * (1 - step / steps)
            step += 1
            back_to = (error @ out.T) / sizes[some]
            out -= pace * mean.T @ error / len(some)
            bias -= pace * error.mean(0)
            np.add.at(emb, x[some], -pace * back_to[:, None, :])
            emb[buckets] = 0.0
    test = np.flatnonzero(back) if back.any() else rows
    z = emb[x[test]].sum(1) / sizes[test] @ out + bias
    right = lambda t: _softmax(z / t)[np.arange(len(test)), y[test]]
    temperature = min((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(np.maximum(right(t), 1e-12)).mean())
    p = _softmax(z / temperature)
    score, good = p.max(1), p.argmax(1) == y[test]
    least = limit(score, good, precision)
    return Model(langs, (emb[:buckets] @ out).astype(np.float32), bias, temperature, least, float((score < least).mean()))


def held_out() -> Column:
    """Whether crc32 of the doc_id's text is a multiple of five; such rows are never learned from. No for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _sampled(buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                parts = list(grams(text.as_py() or "", buckets))
                g = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                rows.append(g[np.linspace(0, len(g) - 1, most).astype(np.int64)] if len(g) > most else g)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "lang", "grams"]
            )

    return run


def fit(docs: DataFrame, per_lang: int = 1500, grams_each: int = 256, buckets: int = 1 << 15, max_langs: int = 200) -> Model:
    """Train on at most ``per_lang`` rows of each language, each with at most ``grams_each`` subwords spread over its whole text.

    Rows are taken by a hash of doc_id among those with text, lang and doc_id
    that are not held out. These bounds hold at every size of input.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().limit(max_langs + 1).collect()}
    langs = sorted(counts)
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    from pyspark.sql import Window

    # Only hashes below a bound can be among the first per_lang of their language: twice as many and 200 pass it.
    few = F.lit(False)
    for lang in langs:
        share = min(1.0, (2 * per_lang + 200) / counts[lang])
        few = few | ((F.col("lang") == lang) & (F.col("hash") <= F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    hashed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).where(few)
    chosen = hashed.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("doc_id").distinct()
    # At most per_lang x max_langs ids: small enough to send to every task.
    rows = (
        known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
        .mapInArrow(lean(_sampled(buckets, grams_each)), "doc_id long, lang string, grams array<long>")
        .where("size(grams) > 0").withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id", "lang", F.xxhash64("grams")).limit(per_lang * max(1, len(langs))).collect()
    )
    if not rows:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.5)
    x = np.full((len(rows), grams_each), -1, np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r.grams)] = r.grams
    number = {lang: i for i, lang in enumerate(langs)}
    return train(x, np.array([number[r.lang] for r in rows]), langs, buckets)


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.value.predict(t.as_py()) for t in batch.column("text")]
            lang, score, accepted = zip(*got) if got else ((), (), ())
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                names=[*names, "lang_pred", "score", "accepted"],
            )

    return run


def identify(docs: DataFrame, model: Model | None = None, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row of ``docs`` (doc_id, text, lang, ...).

    ``lang_pred`` is a learned language, or ``und`` (score 0, not accepted) for
    texts that are null or without a letter, and for all texts where nothing
    could be learned. ``accepted`` is false where the calibrated score is below
    the model's limit. Only the text decides; lang, source and doc_id are not
    looked at. Repeated rows are answered again; further columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    model = fit(rows, **bounds) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        lean(_predicted(shared)), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
    )


def recognised(docs: DataFrame, model: Model | None = None, **bounds: int) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    model = fit(rows, **bounds) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.predict(t.as_py())[2] for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
