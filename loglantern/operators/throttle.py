"""Notification throttle over anomalous summaries.

A notification is suppressed when it comes less than ``gap_ms`` after the last
one sent and carries the same category and severity. One last notification is
remembered per scope.

Whether a row is sent depends on all rows before it, yet only through the last
one sent. So the rows are put in order and cut into even ranges, and each range
becomes a function from the last notification before it to the last one after
it. Functions of neighbouring ranges are composed over a tree, which gives every
range its entry, and with it all ranges decide on their rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loglantern.session import cut_lineage, written

#: Ranges whose functions one task composes.
FAN_OUT = 64
_FUNCTION = "pid long, run string, single boolean, after string, after_at long, other_at long, first_at long, upto array<long>, becomes array<long>"
_ENTRY = "pid long, run string, at long"
State = tuple[str, int] | None


def notification_key(category: Column, severity: Column) -> Column:
    return F.concat_ws("|", category, severity)


def _next(at: np.ndarray, gap: int) -> np.ndarray:
    """Position of the next row sent after each one that is sent; the length where there is none."""
    return np.searchsorted(at, at + gap)


def _last_sent(at: np.ndarray, gap: int) -> np.ndarray:
    """Position of the last row sent if a row is sent and all before it are forgotten."""
    follow = _next(at, gap)
    step = np.where(follow < len(at), follow, np.arange(len(at)))
    while True:
        further = step[step]
        if (further == step).all():
            return step
        step = further


def _sent(at: np.ndarray, starts: np.ndarray, first: int, gap: int) -> np.ndarray:
    """Which rows are sent when the runs begin at ``starts`` and the first one sends ``first``, or nothing beyond its end.

    A run's first row is sent, and so is all that follows from it: the orbits of
    all runs, doubled in each round.
    """
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
    end = np.append(starts[1:], len(at))[run]
    # Runs are set apart by more than any gap, so one search serves them all.
    apart = (at - at.min()) + run * (int(at.max() - at.min()) + gap + 1)
    follow = _next(apart, gap)
    jump = np.append(np.where(follow < end, follow, len(at)), len(at))
    seen = np.append(starts[1:], first) if first < end[0] else starts[1:]
    while True:
        more = jump[seen]
        more = more[more < len(at)]
        if not len(more):
            break
        seen = np.concatenate([seen, more])
        jump = jump[jump]
    out = np.zeros(len(at), bool)
    out[seen] = True
    return out


class Function(dict):
    """What a range does to the last notification (run, at) before it; a run is a scope and a key."""

    @staticmethod
    def of(run: str, last_run: str | None, at: np.ndarray, gap: int) -> Function:
        """``at`` are the times of the only run, or of ``last_run``, after which nothing depends on what came before the range."""
        becomes = at[_last_sent(at, gap)]
        if last_run is not None:
            # A run after another one always begins with a row that is sent.
            return Function.always(run, last_run, int(becomes[0]))
        edge = np.append(np.flatnonzero(np.diff(becomes)), len(at) - 1)
        return Function(
            run=run, single=True, after=None, after_at=None, other_at=int(becomes[0]), first_at=int(at[0]),
            upto=at[edge].tolist(), becomes=becomes[edge].tolist(),
        ).trimmed(gap)

    @staticmethod
    def always(run: str, after: str, after_at: int) -> Function:
        return Function(run=run, single=False, after=after, after_at=after_at, other_at=None, first_at=None, upto=[], becomes=[])

    def trimmed(self, gap: int) -> Function:
        """Without steps beyond the first gap: what was sent before the range was sent by its first time."""
        n = int(np.searchsorted(np.array(self["upto"]), self["first_at"] + gap)) + 1
        self["upto"], self["becomes"] = self["upto"][:n], self["becomes"][:n]
        return self

    def __call__(self, state: State, gap: int) -> State:
        if not self["single"]:
            return self["after"], self["after_at"]
        if state is None or state[0] != self["run"]:
            return self["run"], self["other_at"]
        i = int(np.searchsorted(np.array(self["upto"], np.int64), state[1] + gap))
        return state if i == len(self["upto"]) else (self["run"], int(self["becomes"][i]))

    def then(self, later: Function, gap: int) -> Function:
        """First this range, then ``later``."""
        if not later["single"] or not self["single"] or self["run"] != later["run"]:
            state = later((self["after"], self["after_at"]) if not self["single"] else (self["run"], self["other_at"]), gap)
            return Function.always(self["run"], *state)
        beyond = [(t, y) for t, y in zip(later["upto"], later["becomes"]) if t > self["upto"][-1]]
        return Function(
            run=self["run"], single=True, after=None, after_at=None, first_at=self["first_at"],
            other_at=later((self["run"], self["other_at"]), gap)[1],
            upto=[*self["upto"], *(t for t, _ in beyond)],
            becomes=[*(later((self["run"], y), gap)[1] for y in self["becomes"]), *(y for _, y in beyond)],
        ).trimmed(gap)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    run = batch.column("_run")
    return np.append(0, np.flatnonzero(np.asarray(pc.not_equal(run[1:], run[:-1]))) + 1)


def _functions(gap: int):
    """The function of one range; its rows pass by, and only the times of the run at hand are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = now = None
        times: list[np.ndarray] = []
        several = False
        for batch in batches:
            if not batch.num_rows:
                continue
            names, at, starts = batch.column("_run"), batch.column("_at").to_numpy(), _starts(batch)
            if first is None:
                first = now = names[0].as_py()
            last = names[int(starts[-1])].as_py()
            if len(starts) > 1 or last != now:
                several, now, times = True, last, []
            times.append(at[starts[-1] :])
        if first is not None:
            f = Function.of(first, now if several else None, np.concatenate(times), gap)
            yield pa.RecordBatch.from_pylist([{"pid": TaskContext.get().partitionId(), **f}], _ARROW)

    return run


_COLUMNS = ["run", "single", "after", "after_at", "other_at", "first_at", "upto", "becomes"]
_ARROW = pa.schema([
    ("pid", pa.int64()), ("run", pa.string()), ("single", pa.bool_()), ("after", pa.string()), ("after_at", pa.int64()),
    ("other_at", pa.int64()), ("first_at", pa.int64()), ("upto", pa.list_(pa.int64())), ("becomes", pa.list_(pa.int64())),
])


def _ordered(table: pa.Table) -> list[tuple[int, Function]]:
    return [(r["pid"], Function({c: r[c] for c in _COLUMNS})) for r in sorted(table.to_pylist(), key=lambda r: r["pid"])]


def _entries(functions: DataFrame, ranges: int, gap: int) -> DataFrame:
    """(pid, run, at): the last notification before each range, null where there is none."""
    def walked(key: tuple, mine: pa.Table, above: pa.Table) -> pa.Table:
        given = above.to_pylist()
        state: State = (given[0]["run"], given[0]["at"]) if given and given[0]["run"] is not None else None
        out = []
        for pid, f in _ordered(mine):
            out.append({"pid": pid, "run": state[0] if state else None, "at": state[1] if state else None})
            state = f(state, gap)
        return pa.Table.from_pylist(out, pa.schema([("pid", pa.int64()), ("run", pa.string()), ("at", pa.int64())]))

    def composed(table: pa.Table) -> pa.Table:
        (pid, whole), *later = _ordered(table)
        for _, f in later:
            whole = whole.then(f, gap)
        return pa.Table.from_pylist([{"pid": pid // FAN, **{c: whole[c] for c in _COLUMNS}}], _ARROW)

    FAN = FAN_OUT
    group = F.floor(F.col("pid") / FAN).alias("g")
    if ranges > FAN:
        above = _entries(written(functions.groupBy(group).applyInArrow(composed, _FUNCTION)), ceil(ranges / FAN), gap)
    else:
        above = functions.sparkSession.createDataFrame([], _ENTRY)
    return functions.groupBy(group).cogroup(above.groupBy(F.col("pid").alias("g"))).applyInArrow(walked, _ENTRY)


def throttle_notifications(
    summaries: DataFrame,
    gap_ms: int = 1000,
    scope: Sequence[str] = (),
    at: str = "window_end",
    tie: Sequence[str] = ("window_start",),
    ranges: int | None = None,
) -> DataFrame:
    """The anomalous summaries that are notified, in whole milliseconds.

    Without ``scope`` one last notification is shared by everything. The rows
    are dealt into ``ranges`` (the session's shuffle partitions) of
    (scope, time, tie), so neither a scope nor one long chain of repeats is
    the work of one task. The driver holds one entry per range.
    """
    ranges = ranges or int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = summaries.columns
    where = F.to_json(F.array(*[F.col(c).cast("string") for c in scope])) if scope else F.lit("")
    rows = written(
        summaries.where("is_anomaly")
        .where(F.col(at).isNotNull())
        .select(
            *[F.col(f"`{c}`") for c in kept],
            where.alias("_scope"),
            F.unix_millis(F.col(at)).alias("_at"),
            F.struct(*tie).alias("_tie"),
            F.concat_ws("\\n", where, notification_key(F.col("category"), F.col("severity"))).alias("_run"),
        )
    )
    order = ["_scope", "_at", "_tie"]
    # Read twice in the same ranges and the same order, hence a checkpoint.
    ordered = cut_lineage(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("_tie", "_scope"))
    functions = written(ordered.select("_run", "_at").mapInArrow(_functions(gap_ms), _FUNCTION))
    entries = {r["pid"]: (r["run"], r["at"]) for r in _entries(functions, ordered.rdd.getNumPartitions(), gap_ms).collect() if r["run"] is not None}

    schema = T.StructType([*ordered.schema.fields, T.StructField("_sent", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State = entries.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, times, starts = batch.column("_run"), batch.column("_at").to_numpy(), _starts(batch)
            same = state is not None and state[0] == runs[0].as_py()
            sent = _sent(times, starts, int(np.searchsorted(times[: np.append(starts, len(times))[1]], state[1] + gap_ms)) if same else 0, gap_ms)
            if sent.any():
                last = int(np.flatnonzero(sent)[-1])
                state = (runs[last].as_py(), int(times[last]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent)], names=schema.names)

    return ordered.mapInArrow(run, schema).where("_sent").select(*[F.col(f"`{c}`") for c in kept])
