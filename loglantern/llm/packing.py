"""Tokenise documents and pack them into fixed windows by best-fit decreasing.

A document is its token ids and an end id. Full windows are cut off first and
stand alone; what is left of each document is packed with others. Packing runs
in many shards at once: a shard takes a bounded number of pieces, places them
from long to short, and asks a segment tree over remaining capacities for the
tightest open window that still has room.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from loglantern.llm.memory import lean
from loglantern.llm.tables import stored


class Capacities:
    """Open windows by remaining capacity, with a segment tree of counts over 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``need``, removed; None if there is none."""
        node = self.leaves + need
        if not self.count[node]:
            # Up until a right neighbour holds a window, then down its leftmost path.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; ``lengths`` come in the order to place them, longest first."""
    windows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, made = Capacities(size), 0
    for i, n in enumerate(lengths.tolist()):
        got = tree.take(n)
        if got is None:
            got = (made, size)
            made += 1
        window, room = got
        windows[i], offsets[i] = window, size - room
        if room > n:
            tree.put(room - n, window)
    return windows, offsets


#: Letters whose lower case is one letter each.
_LETTERS = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(192, 256)] if c not in (215, 247))
#: Words of these, with marks after them: ASCII ones, but none that contractions or added tokens begin with.
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:;=?@\[-`{}~]*)$"
#: Bytes of text whose parts are looked up at once, longer texts alone.
CHUNK = 4_000_000


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of so many places, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Tokens:
    """Token ids of texts as unsigned 32-bit numbers.

    For vocabularies that split at white space and drop it, so a text's ids are
    those of its space-separated parts in order. A word and the marks after it
    are two parts. Parts seen lately lie in an Arrow array, their ids beside it. Those used since the last turn are young,
    the others old; when the young ones pass ``most`` bytes, the old ones go.
    What is still held changes no result.
    """

    def __init__(self, path: str, most: int = 4_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole, self.most = Tokenizer.from_file(path), most
        # The same model, for words that are brought to its form here: the tokenizer's own steps take half of the time.
        self.tokenizer = Tokenizer(self.whole.model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.form = str.maketrans({c: spelt(c.lower())[0][0] for c in _LETTERS})
        probe = " ".join([*_LETTERS, _LETTERS, "the Quick bROWN fox naïve ÜBER où straße x Zq"])
        added = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.short = self._ids(probe) == self.whole.encode(probe, add_special_tokens=False).ids and not any(t[:1].isalpha() for t in added)
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts = pa.array([""], pa.large_string())
        self.start, self.size, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
        self.ids = np.zeros(0, "<u4")

    def __call__(self, text: str) -> bytes:
        return self.of(pa.array([text], pa.large_string()))[0].tobytes()

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one after the other, and where each text's end."""
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        found = pc.extract_regex(coded.dictionary, _PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        known, kinds = len(self.parts), len(plain)
        word, marks = pc.coalesce(pc.struct_field(found, 0), coded.dictionary), pc.fill_null(pc.struct_field(found, 1), "")
        both = pa.concat_arrays([self.parts, word, marks]).dictionary_encode()
        pair = both.indices.to_numpy()[known:].reshape(2, kinds).T
        self._learn(both.dictionary, pair[plain, 0])
        self.used[pair] = True
        # The ids of each kind of word with its marks, and from these those of the texts.
        ids = self.ids[_runs(self.start[pair.ravel()], self.size[pair.ravel()])]
        size = self.size[pair].sum(1)
        at = coded.indices.to_numpy()
        ids, sizes = ids[_runs((np.cumsum(size) - size)[at], size[at])], size[at]
        ends = np.append(0, np.cumsum(sizes))[lists.offsets.to_numpy()[1:]]
        if self._bytes()[self.used].sum() > self.most:
            self._turn()
        return ids, ends

    @property
    def young(self) -> dict[str, bytes]:
        return self._held(self.used)

    @property
    def old(self) -> dict[str, bytes]:
        return self._held(~self.used)

    def _held(self, some: np.ndarray) -> dict[str, bytes]:
        at = np.flatnonzero(some)
        return {p: self.ids[i : i + n].tobytes() for p, i, n in zip(self.parts.take(pa.array(at)).to_pylist(), self.start[at], self.size[at])}

    def _bytes(self) -> np.ndarray:
        return pc.binary_length(self.parts).to_numpy() + 4 * self.size

    def _turn(self) -> None:
        """Forget the old parts; the young ones become old."""
        self.used[0] = True  # the empty part stays
        start, size = self.start[self.used], self.size[self.used]
        self.parts, self.ids = self.parts.filter(pa.array(self.used)), self.ids[_runs(start, size)]
        self.start, self.size, self.used = np.cumsum(size) - size, size, np.zeros(len(size), bool)

    def _learn(self, parts: pa.Array, words: np.ndarray) -> None:
        """Hold ``parts``, which begin with those held; ``words`` are the places of plain words."""
        known, more = len(self.parts), len(parts) - len(self.parts)
        self.parts, self.used = parts, np.append(self.used, np.zeros(more, bool))
        start, size = (np.append(x, np.zeros(more, np.int64)) for x in (self.start, self.size))
        plain = np.zeros(len(parts), bool)
        plain[words] = True
        ids, n = [self.ids], len(self.ids)
        for some, encode in ((plain[known:], self._words), (~plain[known:], self._each)):
            at = known + np.flatnonzero(some)
            texts = parts.take(pa.array(at)).to_pylist()
            for i in range(0, len(texts), 1000):
                got, size[at[i : i + 1000]] = encode(texts[i : i + 1000])
                ids.append(got)
            start[at] = n + np.cumsum(size[at]) - size[at]
            n += int(size[at].sum())
        self.ids, self.start, self.size = np.concatenate(ids), start, size

    def _ids(self, words: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([words.translate(self.form)], add_special_tokens=False)[0].ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words as one text, cut after each token that ends a word."""
        if not self.short:
            return self._each(words)
        ids = np.array(self._ids(" ".join(words)), "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return self._each(words)
        return ids, np.diff(cuts, prepend=0)

    def _each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of any parts."""
        found = self.whole.encode_batch([parts], is_pretokenized=True, add_special_tokens=False)[0]
        return np.array(found.ids, "<u4"), np.bincount(np.array(found.word_ids, np.int64), minlength=len(parts))


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def _chunks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most`` bytes of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


def _pieces(path: str, end_id: int, size: int):
    """(doc_id, start, length, ids_crc32, doc_tokens, salt) of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = _tokens(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc, start, length, crc, whole = [], [], [], [], []
            for part in _chunks(batch, CHUNK):
                found, ends = tokens.of(pc.fill_null(part.column("text"), ""))
                lo = 0
                for d, hi in zip(part.column("doc_id").to_pylist(), ends.tolist()):
                    ids = found[lo:hi].tobytes() + end
                    n, lo = hi - lo + 1, hi
                    for at in range(0, n, size):
                        piece = ids[4 * at : 4 * (at + size)]
                        doc.append(d)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        whole.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (doc, start, length, crc, whole)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def _packed(size: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        windows, offsets = best_fit(part["length"].to_numpy(), size)
        return part.assign(sequence_id=(int(key[0]) << 32) + windows, offset=offsets).drop(columns="shard")

    return run


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, shard_pieces: int = 50_000) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a vocabulary file that every executor has. Null and empty texts
    are the end id alone; rows that repeat are packed again; a null doc_id stays
    null. Pieces have at most ``size`` ids; a document of several windows is cut
    into full ones first. ``shard_pieces`` is about how many pieces one task
    packs; the padding that sharding adds is at most one open window a shard.
    Empty tables give empty results; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = stored(rows.mapInArrow(lean(_pieces(path, end_id, size)), ", ".join(f"{n} long" for n in names)))
    loose = pieces.where(F.col("length") < size)
    shards = loose.count() // shard_pieces + 1
    # Rows of one id may repeat without end, so the whole row and its place choose the shard.
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))
    packed = (
        loose.withColumn("shard", shard).groupBy("shard")
        .applyInPandas(_packed(size), ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset"]))
    )
    alone = pieces.where(F.col("length") == size).select(
        *names, (F.lit(1).cast("long") * 2**62 + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(alone)
