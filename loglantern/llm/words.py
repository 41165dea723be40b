"""Words of a text as hashes, on the bytes of Arrow columns.

A word is a maximal run without space, tab, line feed, vertical tab, form feed
or carriage return. These are single bytes in UTF-8, so words are found and
hashed without decoding the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters between words, as a character class for Spark's regular expressions.
BREAKS = "[ \\t\\n\\x0B\\f\\r]"

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_RANDOM = np.random.default_rng(977)
_BYTE = _RANDOM.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of words hashed at once: bounds the memory for one very long text.
BLOCK = 1 << 16


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n - 1, 0), base))])[: max(n, 1)]


_POWERS, _BACKS = _powers(_STEP, BLOCK + 1), _powers(_BACK, BLOCK + 1)


def byte_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value, without a copy; null is empty."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i, there in enumerate(valid):
        yield whole[ends[i] : ends[i + 1]] if there else whole[:0]


def word_hashes(text: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of the UTF-8 bytes ``text``, in order; A-Z lower-cased first if asked."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = _IS_WORD[text]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at, byte = 0, _LOWER_BYTE if lower else _BYTE
    while at < len(starts):
        # Each byte times a power of its place; a word's hash is the difference of two sums, with its first place's power taken out.
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        lo, n = starts[at], int(ends[to - 1] - starts[at])
        powers, backs = (_POWERS, _BACKS) if n <= BLOCK else (_powers(_STEP, n), _BACKS)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[text[lo : lo + n]] * powers[:n], out=sums[1:])
        first = starts[at:to] - lo
        out[at:to] = (sums[ends[at:to] - lo] - sums[first]) * backs[first]
        at = to
    return mixed(out)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words (k at most 64)."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _PLACE[j]
    return mixed(total)


def shingle_set(text: np.ndarray, k: int) -> np.ndarray:
    """Distinct ``k``-word shingles, sorted by hash; with fewer words the whole sequence as one."""
    words = word_hashes(text, lower=True)
    if not len(words):
        return words
    if len(words) < k:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, k))
