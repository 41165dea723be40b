"""What a task hands to Python and back, and what its worker keeps."""

import subprocess
import sys

import pyarrow as pa

from loglantern.llm import collocations as C
from loglantern.llm.memory import BATCH, lean
from loglantern.llm.tables import small_batches, stored

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes():
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    return run


def test_stored_hands_small_batches_to_python(spark):
    texts = spark.range(0, 9000, 1, 1).selectExpr("id", "repeat('long text ', 200) AS text")
    got = stored(texts.mapInArrow(_sizes(), "n long, size long")).collect()
    assert sum(r.n for r in got) == 9000 and max(r.size for r in got) < 2 * BATCH
    assert spark.conf.get(BOUND, None) is None


def test_a_bound_of_the_session_stays(spark):
    try:
        spark.conf.set(BOUND, "64k")
        small_batches(spark)
        texts = spark.range(0, 900, 1, 1).selectExpr("id", "repeat('long text ', 200) AS text")
        assert max(r.size for r in stored(texts.mapInArrow(_sizes(), "n long, size long")).collect()) < 1 << 18
        assert spark.conf.get(BOUND) == "64k"
        spark.conf.unset(BOUND)
        small_batches(spark)
        assert spark.conf.get(BOUND) == str(BATCH)
    finally:
        spark.conf.unset(BOUND)


def test_lean_keeps_rows_and_cuts_batches():
    wide = pa.record_batch({"a": list(range(3000)), "t": ["x" * 4000] * 3000})
    none, one = wide.slice(0, 0), pa.record_batch({"a": [7], "t": ["y" * 5_000_000]})
    got = list(lean(iter)(iter([wide, none, one])))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([wide, one]))
    assert len(got) > 5 and all(b.nbytes < 2 * BATCH or b.num_rows == 1 for b in got)


def test_phrases_come_in_few_at_once():
    class Marks:
        value = C.np.full(1 << 10, 2**64 - 1, C.np.uint64)

    text = " ".join(f"w{i}" for i in range(50_000))
    rows = pa.record_batch({"lang": ["en"] * 12, "text": [text] * 12})
    got = list(C._phrases(Marks)(iter([rows])))
    assert sum(sum(b.column("f").to_pylist()) for b in got) == 12 * (50_000 + 49_999 + 49_998)
    assert max(b.num_rows for b in got) < 2 * C.FOUND


#: Small pieces are freed below one that stays, so the C library alone keeps them.
HELD = """
import re, sys
sys.path.insert(0, {repo!r})
from loglantern.llm.memory import lean
kept = []
def run(batches):
    held = [bytes(100_000) for _ in range(2500)]
    kept.append(bytes(50_000))
    yield from batches
def mb():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()).group(1)) / 1024
before = mb()
list({run}(iter([])))
print(mb() - before)
"""


def test_a_worker_gives_back_what_a_task_freed(request):
    repo = str(request.config.rootpath)
    more = {run: float(subprocess.run([sys.executable, "-c", HELD.format(repo=repo, run=run)], capture_output=True, text=True, check=True, timeout=100).stdout) for run in ("run", "lean(run)")}
    assert more["lean(run)"] < 50 < more["run"], more
