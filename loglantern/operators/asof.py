"""As-of lookups: the last events of several sources at any moments, in one merge.

All events and moments are put in one order, (scope, time, tie), and dealt into
even ranges of it. Each range is read once as a stream that keeps the last few
events of every source, so its size, a busy scope or a burst do not matter.
What a range cannot know, the events before its first row, it asks for: the
questions and the last events of each range form a far smaller table of the same
kind, which is merged in the same way, over ranges of ranges. Only keys take
part; what the events hold is joined to the few that are seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loglantern.session import written

#: Ranges whose questions one range of the next level answers.
FAN_OUT = 256
_HIT, _SHORT, _TAIL, _ASK = range(4)
_PLACE = ["k", "t", "tick", "n", "s", "src", "id", "ask"]
_OUT = "kind int, k string, t long, tick int, n long, s string, src int, id long, ask int, req long, pos int, pid long"


class Source(NamedTuple):
    """Events to look up: the last ``n`` as structs of ``fields``.

    ``order`` names the event time, then optionally a whole number and a text
    that settle equal times; a struct of numbers and times serves as text.
    """

    events: DataFrame
    n: int
    fields: Sequence[str]
    order: Sequence[str] = ("event_ts", "ord")


def _ties(df: DataFrame, order: Sequence[str]) -> tuple[Column, Column]:
    """A whole number and a text that sort as the columns after the time do."""
    number, text = F.lit(0).cast("long"), F.lit("")
    for c in order[1:]:
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType):
            number = F.coalesce(F.col(c).cast("long"), number)
        elif isinstance(kind, T.StructType):
            text = F.concat(*[_digits(F.col(f"{c}.{f.name}"), f.dataType) for f in kind.fields])
        else:
            text = F.coalesce(F.col(c).cast("string"), text)
    return number, text


def _digits(value: Column, kind: T.DataType) -> Column:
    """Twenty digits that sort as the whole number or time does; null first."""
    value = F.unix_micros(value) if isinstance(kind, T.TimestampType) else value
    return F.coalesce(F.lpad((value.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"), F.lit(""))


def _scope(keys: Sequence[str]) -> Column:
    return F.to_json(F.array(*[F.col(c).cast("string") for c in keys])) if keys else F.lit("")


def _reader(sizes: Sequence[int], alone: bool):
    """Stream one sorted range: hits of its questions, and what it cannot know or others may ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        state, first_k = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if first_k is None:
                first_k = batch.column("k")[0].as_py()
                if not alone:
                    yield _rows(batch.slice(0, 1), np.zeros(1, np.int64), _ASK, req=np.array([pid]), ask=np.zeros(1, np.int64))
            rows = batch if state is None else pa.Table.from_batches([state, batch]).combine_chunks().to_batches()[0]
            k = rows.column("k")
            changes = np.flatnonzero(np.asarray(pc.not_equal(k[1:], k[:-1]))) + 1
            starts = np.concatenate([[0], changes])
            begin = starts[np.searchsorted(starts, np.arange(rows.num_rows), side="right") - 1]
            asked = np.asarray(rows.column("req").is_valid())
            src, ids = rows.column("src").to_numpy(), rows.column("id").to_numpy()
            questions = np.flatnonzero(asked)
            early = np.asarray(pc.equal(k, pa.scalar(first_k)))[questions]
            left = []
            for i, n in enumerate(sizes):
                own = np.flatnonzero(~asked & (src == i))
                upto = np.searchsorted(own, questions)
                have = np.minimum(upto - np.searchsorted(own, begin[questions]), n)
                which = np.repeat(np.arange(len(questions)), have)
                pos = np.arange(len(which)) - np.repeat(np.cumsum(have) - have, have) + 1
                if len(which):
                    yield _rows(rows, questions[which], _HIT, src=np.full(len(which), i), pos=pos, id=ids[own[upto[which] - pos]])
                if not alone and (few := np.flatnonzero(early & (have < n))).size:
                    yield _rows(rows, questions[few], _SHORT, src=np.full(len(few), i), pos=have[few], pid=np.full(len(few), pid))
                left.append(own[max(np.searchsorted(own, starts[-1]), len(own) - n) :])
            state = rows.take(pa.array(np.sort(np.concatenate(left))))
        if state is not None and state.num_rows and not alone:
            yield _rows(state, np.arange(state.num_rows), _TAIL)

    return run


def _rows(rows: pa.RecordBatch, at: np.ndarray, kind: int, **values: np.ndarray) -> pa.RecordBatch:
    """Rows ``at`` of a range with some columns replaced."""
    taken = rows.take(pa.array(at))
    out = {"kind": pa.array(np.full(len(at), kind), pa.int32())}
    for name, type_ in (("k", pa.string()), ("t", pa.int64()), ("tick", pa.int32()), ("n", pa.int64()), ("s", pa.string()),
                        ("src", pa.int32()), ("id", pa.int64()), ("ask", pa.int32()), ("req", pa.int64()), ("pos", pa.int32()), ("pid", pa.int64())):
        if name in values:
            out[name] = pa.array(values[name], type_)
        else:
            out[name] = taken.column(name) if name in taken.schema.names else pa.nulls(len(at), type_)
    return pa.RecordBatch.from_pydict(out)


def _merged(rows: DataFrame, sizes: Sequence[int], ranges: int) -> DataFrame:
    """(k, t, req, src, pos, id): the events each question sees, newest first."""
    dealt = rows.repartitionByRange(ranges, *_PLACE) if ranges > 1 else rows.coalesce(1)
    found = dealt.sortWithinPartitions(*_PLACE).mapInArrow(_reader(sizes, ranges == 1), _OUT)
    hit = ["k", "t", "req", "src", "pos", "id"]
    if ranges == 1:
        return found.where(F.col("kind") == _HIT).select(*hit)
    found = written(found)
    above = found.where(F.col("kind").isin(_TAIL, _ASK)).select(*_PLACE, "req")
    carried = _merged(above, sizes, ceil(ranges / FAN_OUT)).select(
        F.col("req").alias("pid"), "src", F.col("pos").alias("more"), F.col("id").alias("seen")
    )
    short = found.where(F.col("kind") == _SHORT).select("k", "t", "req", "src", "pos", "pid")
    wanted = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col("src") + 1)
    late = short.join(carried, ["pid", "src"]).withColumn("pos", F.col("pos") + F.col("more")).where(F.col("pos") <= wanted)
    return found.where(F.col("kind") == _HIT).select(*hit).unionByName(late.select(*hit[:-1], F.col("seen").alias("id")))


def as_of_merge(
    ticks: DataFrame, sources: Mapping[str, Source], *, keys: Sequence[str] = (), at: str = "tick", ranges: int | None = None
) -> DataFrame:
    """Add one column per source to ``ticks``: the last events at or before the time ``at``, newest first.

    ``ticks`` may lie anywhere and repeat; with ``keys`` (columns of ticks and
    of all sources) only events of the same keys are seen. A null time or key
    matches nothing, and such a tick gets empty lists. ``ranges`` is the number
    of tasks of the merge, the session's shuffle partitions by default. The
    sources are read once, the ticks twice: pass a stored table.
    """
    spark = ticks.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [s.n for s in sources.values()]
    types_ = [s.events.select(F.struct(*s.fields).alias("row")).schema["row"].dataType for s in sources.values()]

    tagged = None
    for i, s in enumerate(sources.values()):
        number, text = _ties(s.events, s.order)
        usable = F.col(s.order[0]).isNotNull()
        for c in keys:
            usable = usable & F.col(c).isNotNull()
        rows = s.events.where(usable).select(
            _scope(keys).alias("k"), F.unix_micros(F.col(s.order[0])).alias("t"), F.lit(0).alias("tick"), number.alias("n"), text.alias("s"),
            F.lit(i).alias("src"), F.lit(1).alias("ask"), F.lit(None).cast("long").alias("req"),
            *[(F.struct(*s.fields) if j == i else F.lit(None).cast(t)).alias(f"row{j}") for j, t in enumerate(types_)],
        )
        tagged = rows if tagged is None else tagged.unionByName(rows)
    known = written(tagged.withColumn("id", F.monotonically_increasing_id()))
    asked = ticks.select(_scope(keys).alias("k"), F.unix_micros(F.col(at)).alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    asked = asked.select(
        "k", "t", F.lit(1).alias("tick"), F.lit(0).cast("long").alias("n"), F.lit("").alias("s"), F.lit(-1).alias("src"),
        F.lit(-1).cast("long").alias("id"), F.lit(1).alias("ask"), F.lit(0).cast("long").alias("req"),
    )
    hits = _merged(known.select(*_PLACE, "req").unionByName(asked), sizes, ranges)

    payload = known.select("id", *[f"row{j}" for j in range(len(sizes))])
    lists = [
        F.sort_array(F.collect_list(F.when(F.col("src") == j, F.struct("pos", F.col(f"row{j}").alias("row"))))).alias(f"list{j}")
        for j in range(len(sizes))
    ]
    seen = hits.select("k", "t", "src", "pos", "id").join(payload, "id").groupBy("k", "t").agg(*lists)
    columns = [f"t.`{c}`" for c in ticks.columns]
    out = ticks.alias("t").join(seen.alias("s"), (_scope([f"t.{c}" for c in keys]) == F.col("s.k")) & (F.unix_micros(F.col(f"t.{at}")) == F.col("s.t")), "left")
    none = [F.array().cast(T.ArrayType(t)) for t in types_]
    return out.select(
        *columns,
        *[F.coalesce(F.transform(f"s.list{j}", lambda x: x["row"]), none[j]).alias(name) for j, name in enumerate(sources)],
    )


def as_of_last(
    events: DataFrame,
    ticks: DataFrame,
    n: int,
    fields: Sequence[str],
    name: str,
    *,
    keys: Sequence[str] = (),
    at: str = "tick",
    order: Sequence[str] = ("event_ts", "ord"),
) -> DataFrame:
    """Add to each tick the last ``n`` events at or before it, newest first; see :func:`as_of_merge`."""
    return as_of_merge(ticks, {name: Source(events, n, fields, order)}, keys=keys, at=at)
