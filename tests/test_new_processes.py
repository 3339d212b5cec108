"""The stream of new processes: few calls to the state, chunks that wait, null values."""

import random
from types import SimpleNamespace as N

import pytest
from pyspark.sql import functions as F

from watchframe.operators import correlation as C
from watchframe.streaming import jobs
from watchframe.streaming import stateful as S

SCHEMA = "host string, ts timestamp, pid bigint"


def _run(spark, folder, parts, delay="1 hour", seconds=120):
    """Each part of (host, second, pid) rows is a file and a micro-batch; the last one moves the watermark."""
    for i, rows in enumerate([*parts, [("end", 10**7, 0)]]):
        (spark.createDataFrame(rows, "host string, second bigint, pid bigint").coalesce(1)
         .select("host", F.timestamp_seconds("second").alias("ts"), "pid").write.mode("append").parquet(f"{folder}/in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = jobs.run(S.new_processes_stream(stream, delay), f"{folder}/out", f"{folder}/progress")
    try:
        ended = q.awaitTermination(seconds)
    finally:
        q.stop()
    assert q.exception() is None
    assert ended, f"not done after {seconds} s"
    return spark.read.parquet(f"{folder}/out"), q.recentProgress


def _want(rows):
    """What is new by a plain reading, once for each row."""
    times, found = {}, []
    for host, at, pid in rows:
        if at is not None:
            times.setdefault(host, {}).setdefault(at, []).append(pid)
    for host, at in times.items():
        for was, now in zip(sorted(at), sorted(at)[1:]):
            found += [(host, now, p) for p in at[now] if p is None or p not in at[was]]
    return sorted(found, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("host", F.unix_seconds("ts"), "pid").collect()), key=str)


def test_a_row_is_no_call(spark, tmp_path):
    """20,000 rows of one host, none of them twice: the state gets chunks, not rows."""
    rows = [("h", 1000 + i % 20, 20 * (i // 20) + (i % 20 if i % 200 < 20 else 0)) for i in range(20_000)]
    assert len(set(rows)) == len(rows)
    found, progress = _run(spark, str(tmp_path), [rows])
    assert _got(found) == _want(rows) != []
    changed = [o.numRowsUpdated for p in progress for o in p.stateOperators]
    assert 0 < sum(changed) < 100


def test_batches_repeats_and_nulls(spark, tmp_path):
    """Snapshots cut over micro-batches, rows that come twice, rows without a time or a pid."""
    r = random.Random(4)
    rows = [(r.choice("ab"), 60 * r.randrange(100, 109), r.randrange(6)) for _ in range(150)]
    rows += [*rows[:9], ("a", None, 3), ("b", None, None), ("a", 6120, None), ("a", 6180, None), ("b", 6000, None), ("b", 6480, None)]
    r.shuffle(rows)
    found, _ = _run(spark, str(tmp_path), [rows[:60], rows[60:110], rows[110:]])
    assert _got(found) == _want(rows) != []
    snapshots = spark.createDataFrame(rows, "host string, second bigint, pid bigint").select(
        "host", F.timestamp_seconds("second").alias("ts"), "pid")
    assert sorted(set(_got(found)), key=str) == _got(C.new_processes(snapshots.distinct()))


class _Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.timers, self.calls = set(), 0

    def getMapState(self, *_):
        self.chunks = chunks = {}
        return N(keys=lambda: iter([*chunks]), getValue=chunks.__getitem__, removeKey=chunks.pop, updateValue=chunks.__setitem__)

    def getListState(self, *_):
        self.rows = rows = []
        return N(exists=lambda: bool(rows), get=lambda: iter([*rows]), appendValue=rows.append, clear=rows.clear,
                 put=lambda new: rows.__setitem__(slice(None), new))

    def getValueState(self, *_):
        value = []
        return N(exists=lambda: bool(value), get=lambda: value[0], clear=value.clear, update=lambda v: value.__setitem__(slice(None), [v]))

    def listTimers(self):
        return iter([*self.timers])

    def registerTimer(self, at):
        self.timers.add(at)


@pytest.mark.parametrize("ttl", [None, 90_000_000])
@pytest.mark.parametrize("held_bytes", [1, 1000, 8_000_000])
def test_chunks_wait_like_rows(ttl, held_bytes):
    """Rows that wait in chunks are found at the same watermark as rows of a list, and nothing stays behind."""
    r = random.Random(7)
    made = [kind(S.quota_fold(60_000_000, 3), ttl) for kind in (S.OrderedFold, S.ChunkedFold)]
    made[1].HELD_BYTES = held_bytes
    handles = [_Handle(), _Handle()]
    found = [[], []]
    for m, h in zip(made, handles):
        m.init(h)
    mark = 0
    for step in range(60):
        rows = [N(us=mark * 1000 + r.randrange(1, 400_000_000), tie=r.randrange(5), body="{}") for _ in range(r.randrange(9))] if step < 50 else []
        mark += r.randrange(60_000) if step < 59 else 10**9
        for m, h, f in zip(made, handles, found):
            m.handleInputRows(("k",), rows, None)
            while due := sorted(t for t in h.timers if t <= mark):
                f += [(step, *x) for x in m.handleExpiredTimer(("k",), N(getCurrentWatermarkInMs=lambda: mark), None)]
                h.timers.discard(due[0])
    assert found[0] == found[1] and len(found[0]) > 150
    assert not handles[0].rows and not handles[1].chunks
    assert handles[0].timers == handles[1].timers
