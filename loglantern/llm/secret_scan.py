"""Secrets in texts: three fixed patterns, and strings that a tokenizer finds hard.

Ordinary words and names come out of a byte-pair vocabulary in few tokens;
random strings do not. A candidate string with few characters per token is a
secret, unless it is a known digest or an identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The three patterns and how long a match has to be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

#: Strings worth a look: 20 characters or more of the usual alphabets of keys; '=' is padding only at the end.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Of 24,000 random strings of 20 to 32 letters, or letters and digits, none has words of so many characters per token.
WORD_RATIO = 2.5
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}", re.IGNORECASE)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def known_digest(text: str) -> bool:
    """A bare digest of a common size, or a UUID."""
    return bool(_UUID.fullmatch(text)) or (len(text) in _DIGEST_SIZES and bool(_DIGEST.fullmatch(text)))


def identifier(text: str, path: str) -> bool:
    """A name or path: its words and numbers have four characters or more on average, and WORD_RATIO characters or more per token of the vocabulary."""
    parts = _NAME_PART.findall(text)
    size = sum(map(len, parts))
    return size >= 4 * len(parts) and size >= WORD_RATIO * sum(len(_encoding(path).encode_ordinary(" " + p.lower())) for p in parts)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def spans(text: str, path: str, least_ratio: float) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) as (start, end, kind), in order."""
    base = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    base += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    more = []
    for m in CANDIDATE.finditer(text):
        found = m[0]
        if known_digest(found) or any(a < m.end() and m.start() < b for a, b, _ in base):
            continue
        if len(found) < least_ratio * len(_encoding(path).encode_ordinary(found)) and not identifier(found, path):
            more.append((*m.span(), "random"))
    order = lambda s: (s[0], KINDS.index(s[2]))
    return sorted(base, key=order), sorted(base + more, key=order)


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def _scanned(path: str, least_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                base, every = spans(text.as_py() or "", path, least_ratio)
                kinds = [k for _, _, k in every]
                for c, v in zip(out, (*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, path: str, least_ratio: float = 2.2) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row of ``docs`` (doc_id, text, ...).

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then
    kind. A candidate outside the patterns counts when it has fewer than
    ``least_ratio`` characters per token of the vocabulary file ``path``. Null
    texts are empty; repeated rows are scanned again; a null doc_id stays null;
    further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return rows.mapInArrow(_scanned(path, least_ratio), schema)
