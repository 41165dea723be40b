"""Partial panes: what one task has seen of each pane, from a single read of its logs.

Counts alone could be hash-aggregated by Spark, but the last texts of a pane
(time, endpoint, addresses, sample logs) would either sort all logs by pane
first or need a second read. Here a task folds its batches as they come: counts
are summed, and of each kind of text only the last few rows per pane are kept.
What leaves the task is a few rows per pane, whatever the number of logs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from loglantern.functions.log_fields import is_level, message_endpoint, message_ip

#: Rows kept before they are folded again, and folded rows of one kind a task holds before it hands them on.
_FOLD, _HELD = 1 << 16, 1 << 18
_SUMS = ["total", "errors", "warns", "latency_sum", "latency_count"]
_KEY = ["pane_start", "service"]
LOG_FIELDS = ("ts", "service", "level", "message", "latency_ms", "stacktrace")


def _codes(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number per row that only rows of equal keys share; null is a key too."""
    out = np.zeros(rows.num_rows, np.int64)
    for key in keys:
        coded = _flat(rows.column(key)).dictionary_encode()
        out = out * (len(coded.dictionary) + 1) + np.asarray(coded.indices.fill_null(len(coded.dictionary)), np.int64)
    return out


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _rank(rows: pa.Table, order: Sequence[str]) -> np.ndarray:
    """Row numbers in the given order, nulls first."""
    return np.asarray(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"), np.int64)


def _last(rows: pa.Table, keys: Sequence[str], order: Sequence[str], n: int) -> pa.Table:
    """The last ``n`` rows of each key."""
    ranked = _rank(rows, order)
    codes = _codes(rows, keys)[ranked]
    by_key = np.argsort(codes, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(codes[by_key]) != 0, True)) if len(codes) else by_key
    end = ends[np.searchsorted(ends, np.arange(len(codes)))]
    return rows.take(pa.array(ranked[by_key[end - np.arange(len(codes)) < n]]))


def _counted(rows: pa.Table, arrival: Sequence[str]) -> pa.Table:
    """Sums of each pane and service, with its first arrival, its last and the time text of the last."""
    ranked = _rank(rows, [f"last_{c}" for c in arrival])
    codes = _codes(rows, _KEY)[ranked]
    by_key = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(codes[by_key]) != 0)) if len(codes) else by_key
    ends = np.append(starts[1:], len(codes)) - 1 if len(codes) else by_key
    at = ranked[by_key]
    out = rows.take(pa.array(at[ends]))
    # First arrivals: nulls count as late here.
    early = np.asarray(pc.sort_indices(rows, sort_keys=[(f"first_{c}", "ascending") for c in arrival]), np.int64)
    place = np.empty(len(early), np.int64)
    place[early] = np.arange(len(early))
    first = rows.take(pa.array(early[np.minimum.reduceat(place[at], starts)] if len(at) else at))

    def put(name: str, values: pa.Array) -> None:
        nonlocal out
        out = out.set_column(out.column_names.index(name), name, values.cast(rows.schema.field(name).type))

    for c in _SUMS:
        put(c, pa.array(np.add.reduceat(_flat(rows.column(c)).to_numpy(zero_copy_only=False)[at], starts) if len(at) else at))
    latest = _flat(rows.column("latency_max"))
    known = np.asarray(latest.is_valid())[at]
    least = np.iinfo(np.int64).min
    top = np.where(known, np.asarray(latest.fill_null(0), np.int64)[at], least)
    top = np.maximum.reduceat(top, starts) if len(at) else top
    put("latency_max", pa.array(top, mask=top == least))
    for c in arrival:
        put(f"first_{c}", _flat(first.column(f"first_{c}")))
    return out


class _Kept:
    """Rows of one kind, folded whenever many have come together."""

    def __init__(self, fold):
        self.fold = fold
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, table: pa.Table) -> bool:
        """Whether so many rows are left after folding that they should go."""
        self.tables.append(table)
        self.rows += table.num_rows
        if self.rows > _FOLD:
            self.tables = [self.fold(pa.concat_tables(self.tables))]
            self.rows = self.tables[0].num_rows
        return self.rows > _HELD

    def take(self) -> pa.Table | None:
        tables, self.tables, self.rows = self.tables, [], 0
        return self.fold(pa.concat_tables(tables)) if tables else None


def _reader(arrival: list[str], ips: int, samples: int, columns: dict[str, pa.DataType], ord_type: pa.DataType):
    """Fold the batches of one task; see :func:`pane_parts` for the rows."""
    pieces = [f"o{i}" for i in range(len(arrival))]

    def order(rows: pa.Table, prefix: str = "") -> pa.Array:
        if arrival == [""]:
            return _flat(rows.column(f"{prefix}o0")).cast(ord_type)
        return pa.StructArray.from_arrays([_flat(rows.column(prefix + p)).cast(f.type) for p, f in zip(pieces, ord_type)], fields=list(ord_type))

    def listed(rows: pa.Table, keys: list[str], values: pa.Array) -> tuple[pa.Table, pa.Array]:
        """One row per key with its values as a list."""
        codes = _codes(rows, keys)
        by_key = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(codes[by_key]) != 0))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), values.take(pa.array(by_key)))
        return rows.take(pa.array(by_key[starts])), lists

    def batch_of(rows: pa.Table, **values: pa.Array) -> pa.RecordBatch:
        given = {"pane_start": _flat(rows.column("pane_start")), **values}
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([given[c].cast(t) if c in given else pa.nulls(n, t) for c, t in columns.items()], names=list(columns))

    def struct(type_: pa.DataType, **values: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([values[f.name].cast(f.type) for f in type_], fields=list(type_))

    def counts(rows: pa.Table) -> pa.RecordBatch:
        last = struct(columns["last"], ord=order(rows, "last_"), ts=_flat(rows.column("ts")))
        return batch_of(
            rows, service=_flat(rows.column("service")), last=last, first_ord=order(rows, "first_"),
            **{c: _flat(rows.column(c)) for c in [*_SUMS, "latency_max"]},
        )

    def endpoints(rows: pa.Table) -> pa.RecordBatch:
        found = struct(columns["last_endpoint"], ord=order(rows), endpoint=_flat(rows.column("endpoint")))
        return batch_of(rows, service=_flat(rows.column("service")), last_endpoint=found)

    def addresses(rows: pa.Table) -> pa.RecordBatch:
        found = struct(columns["ips"].value_type, ord=order(rows), ip=_flat(rows.column("ip")))
        first, lists = listed(rows, _KEY, found)
        return batch_of(first, service=_flat(first.column("service")), ips=lists)

    def tails(rows: pa.Table) -> pa.RecordBatch:
        found = struct(columns["tail"].value_type, ord=order(rows), **{c: _flat(rows.column(c)) for c in LOG_FIELDS})
        first, lists = listed(rows, ["pane_start"], found)
        return batch_of(first, tail=lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [
            (_Kept(lambda t: _counted(t, pieces)), counts),
            (_Kept(lambda t: _last(t, _KEY, pieces, 1)), endpoints),
            (_Kept(lambda t: _last(t, _KEY, pieces, ips)), addresses),
            (_Kept(lambda t: _last(t, ["pane_start"], pieces, samples)), tails),
        ]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            numbers = rows.select(["pane_start", "service", "ts", "errors", "warns"])
            latency = _flat(rows.column("latency_ms"))
            for name, values in (
                ("total", pa.array(np.ones(rows.num_rows, np.int64))), ("latency_sum", latency.cast(pa.int64()).fill_null(0)),
                ("latency_count", latency.is_valid().cast(pa.int64())), ("latency_max", latency.cast(pa.int64())),
                *((f"{side}_{p}", _flat(rows.column(p))) for side in ("first", "last") for p in pieces),
            ):
                numbers = numbers.append_column(name, values)
            full = kinds[0][0].add(kinds[0][0].fold(numbers))
            for (kept, _), test, wanted in ((kinds[1], "endpoint", ["service", "endpoint"]), (kinds[2], "ip", ["service", "ip"])):
                found = rows.select(["pane_start", *wanted, *pieces]).filter(rows.column(test).is_valid())
                if found.num_rows:
                    full |= kept.add(kept.fold(found))
            if samples:
                kept = kinds[3][0]
                full |= kept.add(kept.fold(rows.select(["pane_start", *LOG_FIELDS, *pieces])))
            if full:
                for kept, written in kinds:
                    if (left := kept.take()) is not None:
                        yield written(left)
        for kept, written in kinds:
            if (left := kept.take()) is not None:
                yield written(left)

    return run


def pane_parts(logs: DataFrame, pane: Column, ips: int, samples: int = 0) -> DataFrame:
    """Mergeable parts of panes; ``pane`` is the start of a log's pane.

    A row holds, for its pane and service, the counts with the first and last
    arrival, or the last endpoint, or the last ``ips`` addresses (neither with
    0); or, for its pane alone (``total`` and service null), the last
    ``samples`` logs as ``tail``. Several rows may come for one pane, from every task that saw it.
    """
    arrival_type = logs.schema["ord"].dataType
    fields = [f".{f.name}" for f in arrival_type.fields] if isinstance(arrival_type, T.StructType) else [""]
    level = lambda name: F.coalesce(is_level(F.col("level"), name), F.lit(False)).cast("long")
    texts = ["ts", "service", "latency_ms"] + (["level", "message", "stacktrace"] if samples else [])
    rows = logs.where(F.col("event_ts").isNotNull()).select(
        pane.alias("pane_start"), *texts, *[F.col(f"ord{f}").alias(f"o{i}") for i, f in enumerate(fields)],
        level("ERROR").alias("errors"), level("WARN").alias("warns"),
        (message_endpoint(F.col("message")) if ips else F.lit(None).cast("string")).alias("endpoint"),
        (message_ip(F.col("message")) if ips else F.lit(None).cast("string")).alias("ip"),
    )
    log = T.StructType([T.StructField("ord", arrival_type), *[logs.schema[c] for c in LOG_FIELDS]])
    out = T.StructType([
        T.StructField("pane_start", T.TimestampType()), T.StructField("service", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in [*_SUMS, "latency_max"]],
        T.StructField("last", T.StructType().add("ord", arrival_type).add("ts", T.StringType())),
        T.StructField("last_endpoint", T.StructType().add("ord", arrival_type).add("endpoint", T.StringType())),
        T.StructField("ips", T.ArrayType(T.StructType().add("ord", arrival_type).add("ip", T.StringType()))),
        T.StructField("first_ord", arrival_type), T.StructField("tail", T.ArrayType(log)),
    ])
    arrow = {f.name: to_arrow_type(f.dataType) for f in out.fields}
    return rows.mapInArrow(_reader(fields, ips, samples, arrow, arrow["first_ord"]), out)
