"""Hashed text embedding, vectorised over Arrow batches.

The same rule written with built-in array functions visits every slot for every
token; on whole documents that ran about ten times slower than this UDF, so it
is the one place where text leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from loglantern import fixed_values as V

_CHUNK_BYTES = 1 << 20
_SEPARATOR = re.compile(rb"[^a-z0-9._/-]")
_INVERSE_31 = np.uint64(pow(31, -1, 1 << 64))
# Characters of a token; every other byte separates.
_IS_TOKEN = np.zeros(256, dtype=bool)
_IS_TOKEN[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789._/-"]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def embed_texts(texts: Iterable[str | None], dims: int, n: int | None = None) -> np.ndarray:
    """One L2-normalised row for each of the ``n`` texts; a text without tokens gives zeros.

    A token adds ``1 + min(length, 16) / 24`` to the slot chosen by its base-31
    string hash and its position among the tokens of its text. Texts are taken
    one by one and worked on in chunks of about a megabyte.
    """
    sums = np.zeros((len(texts) if n is None else n, dims))
    wait: list[bytes] = []
    first, size = 0, 0
    for i, t in enumerate(texts):
        blob = (t or "").lower().encode("ascii", "replace")
        size += len(blob) + 1
        if size >= _CHUNK_BYTES and wait:
            _add_chunk(wait, sums[first:i], dims)
            wait, first, size = [], i, len(blob) + 1
        if size >= _CHUNK_BYTES:
            before = 0
            for piece in _pieces(blob):
                before += _add_chunk([piece], sums[i : i + 1], dims, before)
            wait, first, size = [], i + 1, 0
        else:
            wait.append(blob)
    if wait:
        _add_chunk(wait, sums[first:], dims)
    sums /= 24.0
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.divide(sums, length, out=sums, where=length > 0)


def _pieces(blob: bytes) -> Iterator[bytes]:
    """A long text in pieces that end where a token ends."""
    at = 0
    while at < len(blob):
        end = _SEPARATOR.search(blob, at + _CHUNK_BYTES)
        yield blob[at : end.start() if end else len(blob)]
        at = end.start() if end else len(blob)


def _add_chunk(blobs: list[bytes], sums: np.ndarray, dims: int, before: int = 0) -> int:
    """Add the tokens' weights in 24ths and count the tokens; ``before`` of the text came in earlier pieces."""
    data = np.frombuffer(b"\n" + b"\n".join(blobs) + b"\n", dtype=np.uint8)
    inside = _IS_TOKEN[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8))) + 1
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return 0
    # Hash of data[s:e] from prefix sums: sum c[j] * 31^(e-1-j), modulo 2^64.
    weighted = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data.astype(np.uint64) * _powers(_INVERSE_31, len(data)), dtype=np.uint64, out=weighted[1:])
    hashes = (weighted[ends] - weighted[starts]) * _powers(np.uint64(31), len(data))[ends - 1]
    hashes = (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)

    offsets = np.cumsum([1] + [len(b) + 1 for b in blobs])[:-1]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    position = before + np.arange(len(starts)) - np.searchsorted(doc, doc, side="left")
    slots = ((hashes ^ (position * 31)) & 0x7FFFFFFF) % dims
    # Whole 24ths keep the sum independent of the order of addition.
    weights = 24 + np.minimum(ends - starts, 16)
    flat = np.bincount(doc * dims + slots, weights=weights, minlength=len(blobs) * dims)
    sums += flat.reshape(len(blobs), dims)
    return len(starts)


def embed(text: Column, dims: int = V.EMBEDDING_DIMS) -> Column:
    """Embedding of a text column as ``array<double>`` of ``dims`` entries."""

    @arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = embed_texts((t.as_py() for t in batch), dims, len(batch))
            yield pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * dims, found.ravel())

    return run(F.coalesce(text, F.lit("")))
