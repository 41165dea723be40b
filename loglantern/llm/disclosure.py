"""Personal data in texts: fixed patterns, and terms whose company gives a protected entity away.

Addresses, card and phone numbers found by the patterns are the protected
entities. How much a term reveals of an entity is estimated from the corpus: the
pointwise mutual information of the two, from the documents that hold the
entity, the term, and both near each other, as a share of the entity's own
information. A term near an entity that reveals more than a given share of it is
generalised, where a more general word reveals less, and removed otherwise.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loglantern.llm.tables import join_counted, stored

# The four patterns, with whole runs taken where no match starts, so that time stays linear.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++((?:\.[0-9]+){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "term")

TERM = re.compile(r"[^\W_]{3,}")
_DIGITS = re.compile(r"[^0-9]+")
#: Distinct terms a task counts before it hands them on.
_HELD = 200_000
#: Characters a table of general words may hold: it goes to every task.
MOST_GENERAL = 50_000_000
#: Starts the name of a general word, apart from all terms.
_GENERAL = "^"


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [Span("email", *m.span()) for m in EMAIL.finditer(text) if m[1]]
    for m in IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(Span("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(Span("card", *m.span()))
    if "+" in text:
        out += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _entity(text: str, span: Span) -> bytes:
    """One name for all spellings of an entity; a digest, as it is shuffled."""
    written = text[span.start : span.end]
    value = written.lower() if span.kind == "email" else written if span.kind == "ip" else _DIGITS.sub("", written)
    return hashlib.blake2b(f"{span.kind}:{value}".encode(), digest_size=16).digest()


def mentions(text: str, spans: list[Span], reach: int) -> list[tuple[bytes, bytes, str | None, int, int]]:
    """(entity, company, term, start, end) for the ``reach`` terms on either side of each entity; term None for the entity itself.

    The company is a digest of all the terms near the entity in this text.
    """
    if not spans:
        return []
    taken = sorted((a, b) for _, a, b in spans)
    merged: list[list[int]] = []
    for a, b in taken:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    ends = [b for _, b in merged]
    words = []
    for m in TERM.finditer(text):
        i = bisect_left(ends, m.start() + 1)
        if i == len(ends) or merged[i][0] >= m.end():
            words.append((m.start(), m.end(), m[0].lower()))
    starts = [w[0] for w in words]
    near: dict[bytes, dict[tuple, None]] = {}
    for span in spans:
        own = near.setdefault(_entity(text, span), {})
        own[(None, span.start, span.end)] = None
        before, after = bisect_left(starts, span.start), bisect_left(starts, span.end)
        for a, b, t in words[max(0, before - reach) : before] + words[after : after + reach]:
            own[(t, a, b)] = None
    out = []
    for e, own in near.items():
        company = hashlib.blake2b(" ".join(t or "" for t, _, _ in own).encode(), digest_size=16).digest()
        out += [(e, company, *m) for m in own]
    return out


_MENTION = "array<struct<e: binary, c: binary, t: string, a: bigint, b: bigint>>"
_SCANNED = f"doc_id long, key string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions {_MENTION}"
_MENTION_TYPE = pa.list_(pa.struct([("e", pa.binary()), ("c", pa.binary()), ("t", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))


def _scanned(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                kinds = Counter(s.kind for s in spans)
                base = joined(spans)
                near = [dict(zip("ectab", m)) for m in mentions(text, spans, reach)]
                for c, v in zip(out, (*(kinds[k] for k in KINDS[:4]), hashlib.sha256(base.encode()).hexdigest(), base, near)):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [_MENTION_TYPE]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), *(pa.array(c, t) for c, t in zip(out, types))],
                names=["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"],
            )

    return run


def _terms(general: dict[str, str]):
    """(t, n): in how many texts a term, or one that a general word covers, occurs; counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["t", "n_t"])

        for batch in batches:
            for value in batch.column("text"):
                text = value.as_py()
                if not text:
                    continue
                found = set(TERM.findall(text.lower()))
                held.update(found)
                if general:
                    held.update({_GENERAL + general[t] for t in found if t in general})
                if len(held) > _HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return run


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    """The text, and a key that only rows equal in doc_id and text share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return text, F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text).cast("binary"))


def _found(docs: DataFrame, most_share: float, least_joint: int, reach: int, general: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(scanned rows, terms to mask per key)."""
    if sum(len(k) + len(v) for k, v in general.items()) > MOST_GENERAL:
        raise ValueError("the table of general words is too large to send to every task")
    text, key = _keyed(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", _keyed(docs)[1])
    scanned = stored(rows.mapInArrow(_scanned(reach), _SCANNED))
    total = scanned.count()

    pairs = scanned.select(F.explode("mentions").alias("m")).select("m.e", "m.c", "m.t")
    if general:
        above = F.create_map(*[F.lit(x) for kv in general.items() for x in (kv[0], _GENERAL + kv[1])])
        pairs = pairs.union(pairs.select("e", "c", F.try_element_at(above, F.col("t")).alias("t")).where("t IS NOT NULL"))
    # Once per document and entity; documents with the same words around it count once.
    pairs = pairs.distinct()
    counted = stored(pairs.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= least_joint))
    entities = counted.where("t IS NULL").select("e", F.col("n_both").alias("n_e")).where(F.col("n_e") < total)
    near = counted.where("t IS NOT NULL")
    terms = stored(
        rows.select("text").mapInArrow(_terms(general), "t string, n_t long").groupBy("t").agg(F.sum("n_t").alias("n_t"))
        .where(F.col("n_t") >= least_joint).join(near.select("t").distinct(), "t", "left_semi")
    )
    known = stored(join_counted(near, entities, ["e"], "n_e"))
    share = F.log(F.lit(float(total)) * F.col("n_both") / F.col("n_e") / F.col("n_t")) / F.log(F.lit(float(total)) / F.col("n_e"))
    told = stored(join_counted(known, terms, ["t"], "n_t").where(share >= most_share).select("e", "t", "n_both"))

    at = scanned.select("key", F.explode("mentions").alias("m")).select("key", "m.e", "m.t", "m.a", "m.b").where("t IS NOT NULL")
    hits = join_counted(stored(at), told, ["e", "t"], "n_both")
    if general:
        hits = hits.withColumn("g", F.try_element_at(above, F.col("t")))
        bad = told.select("e", F.col("t").alias("g")).withColumn("too_much", F.lit(True))
        hits = hits.join(bad, ["e", "g"], "left")
        hits = hits.withColumn("g", F.when(F.col("too_much").isNull(), F.substring("g", len(_GENERAL) + 1, 1 << 30)))
    else:
        hits = hits.withColumn("g", F.lit(None).cast("string"))
    # Where one entity allows the general word and another does not, the term goes.
    masked = stored(
        hits.groupBy("key", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("g", F.lit(""))).alias("g"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("a", "b", "g"))).alias("terms"), F.max("n").alias("n"))
    )
    return scanned, masked


def find_personal(
    docs: DataFrame, most_share: float = 0.8, least_joint: int = 2, reach: int = 10, general: dict[str, str] | None = None
) -> DataFrame:
    """Personal data in ``docs`` (doc_id, text, ...): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    ``spans`` lists kind:start:end (code points, end exclusive) by kind, then
    start; kind ``term`` marks terms within ``reach`` terms of an entity that
    reveal ``most_share`` or more of it. Documents are counted; those with the
    same terms around an entity, such as copies, count once for it. An entity
    and a term need ``least_joint`` documents in common, and an entity in every
    document has no information to reveal.
    Null and empty texts have no spans; texts are read whole, however long;
    repeated rows are found again; a null doc_id stays null; an empty table
    gives no rows; further columns are ignored.
    """
    scanned, masked = _found(docs, most_share, least_joint, reach, general or {})
    more = F.array_join(F.transform("terms", lambda s: F.concat(F.lit("term:"), s["a"], F.lit(":"), s["b"])), ",")
    rows = join_counted(scanned.drop("mentions"), masked, ["key"], "n", "left")
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), more).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"),
    )


def masked_text(text: str, base: str, terms: list) -> str:
    """``text`` with entities as [kind], and terms as their general word or left out."""
    cuts = []
    for span in filter(None, base.split(",")):
        kind, a, b = span.split(":")
        cuts.append((int(a), int(b), f"[{kind}]"))
    cuts += [(t["a"], t["b"], t["g"]) for t in terms]
    out, at = [], 0
    for a, b, word in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a >= at:
            out += [text[at:a], word]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(
    docs: DataFrame, most_share: float = 0.8, least_joint: int = 2, reach: int = 10, general: dict[str, str] | None = None
) -> DataFrame:
    """``docs`` with every entity and every revealing term of :func:`find_personal` masked in ``text``.

    ``general`` maps a term (lower case) to a more general word, which replaces
    it if that word, counted wherever a term of its own occurs, reveals less
    than ``most_share`` of each entity concerned; other terms are removed. All
    columns are kept, whatever their names; a null text stays null.
    """
    scanned, masked = _found(docs, most_share, least_joint, reach, general or {})
    spans = scanned.where("base <> ''").groupBy("key").agg(F.max("base").alias("base"), F.count(F.lit(1)).alias("n"))
    spans = stored(spans.join(masked.drop("n"), "key", "left"))
    none = F.array().cast("array<struct<a: bigint, b: bigint, g: string>>")

    @F.pandas_udf("string")
    def mask(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not b else masked_text(t, b, list(s)) for t, b, s in zip(text, base, terms)])

    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _keyed(docs)[1].alias("key")))
    found = join_counted(rows, spans, ["key"], "n", "left")
    text = mask(F.col("row.text").cast("string"), F.coalesce("base", F.lit("")), F.coalesce("terms", none))
    return found.select(F.col("row").withField("text", text).alias("row")).select("row.*")
