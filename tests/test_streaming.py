"""Streaming results equal the batch results on the same events."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from watchframe.operators import correlation as C
from watchframe.plans import adapters as A
from watchframe.plans import controls as K
from watchframe.sources.events import stream_events
from watchframe.streaming import jobs
from watchframe.streaming import stateful as S


@pytest.fixture(scope="module")
def landed(spark, sf, tmp_path_factory):
    """Events as several files, in mixed order, plus one far-future row that moves the watermark."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = A.sec_conns(spark, sf).withColumn("pid", F.lit(None).cast("bigint"))
    # one last row of each kind, as filters come before the watermark
    last = rows.limit(1).withColumns({
        "ts": F.timestamp_micros(F.lit(A.EPOCH_US + 10**11)), "agent_id": F.lit("end"),
        "event_type": F.explode(F.array(F.lit("PROCESS_CREATED"), F.lit("SYSLOG_NETWORK"))),
        "event_id": F.lit(-1).cast("bigint"), "parent_process_name": F.lit("x"),
        "message": F.lit("failed password")})
    rows.repartition(3, "event_id").write.parquet(folder + "/in")
    last.coalesce(1).write.mode("append").parquet(folder + "/in")
    return folder


def _stream(spark, landed):
    schema = spark.read.parquet(landed + "/in").schema
    return spark.readStream.schema(schema).parquet(landed + "/in")


def _run(spark, df, folder, name):
    q = jobs.run(df, f"{folder}/out/{name}", f"{folder}/cp/{name}")
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.read.parquet(f"{folder}/out/{name}")


def _ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect() if r[0] != "end")


def test_brute_force_stream(spark, sf, landed):
    got = _run(spark, S.brute_force_stream(_stream(spark, landed), "10 minutes"), landed, "d1")
    assert _ids(got, "agent_id", "event_id") == _ids(C.brute_force_alerts(A.sec_events(spark, sf)), "agent_id", "event_id")


def test_lineage_stream(spark, sf, landed):
    got = _run(spark, S.lineage_stream(_stream(spark, landed), "10 minutes", 30), landed, "d3")
    want = C.lineage_escalation_alerts(A.sec_events(spark, sf), 30)
    assert _ids(got, "agent_id", "event_id") == _ids(want, "agent_id", "event_id") != []


def test_beacon_stream(spark, sf, landed):
    got = _run(spark, S.beacon_stream(_stream(spark, landed), "10 minutes"), landed, "d4")
    want = C.beacon_alerts(A.sec_conns(spark, sf))
    keys = ("agent_id", "event_id", "samples", "ports")
    assert _ids(got, *keys) == _ids(want, *keys) != []


def test_zscore_stream(spark, sf, landed):
    got = _run(spark, S.zscore_stream(_stream(spark, landed), "10 minutes", 20, 3.0, 20), landed, "d6")
    want = C.zscore_anomalies(C.unpivot_metrics(A.sec_events(spark, sf)), 20, 3.0, 20)
    keys = ("agent_id", "metric", "event_id", "severity")
    assert _ids(got, *keys) == _ids(want, *keys) != []


def test_quota_and_new_process_stream(spark, sf, landed):
    got = _run(spark, S.quota_stream(_stream(spark, landed), "agent_id", "10 minutes", limit=10), landed, "d10")
    want = C.request_quota(A.sec_events(spark, sf), 10, user="agent_id")
    keys = ("agent_id", "event_id", "request_number", "allowed")
    assert _ids(got, *keys) == _ids(want, *keys)
    slot = F.timestamp_micros(F.call_function("div", F.unix_micros("ts"), F.lit(20_000_000)) * 20_000_000)
    snap = lambda df: df.select(F.col("hostname").alias("host"), slot.alias("ts"), (F.col("event_id") % 50).alias("pid"))
    found = _run(spark, S.new_processes_stream(snap(_stream(spark, landed)), "10 minutes"), landed, "d11")
    want = C.new_processes(snap(A.sec_events(spark, sf)).distinct())
    got = {tuple(r) for r in found.where(F.col("ts") < F.timestamp_micros(F.lit(A.EPOCH_US + 10**9)))
           .select("host", "ts", "pid").collect()}
    assert got == {tuple(r) for r in want.select("host", "ts", "pid").collect()}


def test_running_aggregates(spark, sf, landed):
    """Last-seen and counters as streams end at the batch result."""
    out = {}
    for name, df in (("seen", C.agent_last_seen(_stream(spark, landed))),):
        q = (df.writeStream.outputMode("update").foreachBatch(
            lambda b, i: out.update({r[0]: r[1] for r in b.collect()}))
            .option("checkpointLocation", f"{landed}/cp/{name}").trigger(availableNow=True).start())
        q.awaitTermination(120)
    want = {r[0]: r[1] for r in C.agent_last_seen(A.sec_events(spark, sf)).collect()}
    assert {k: v for k, v in out.items() if k != "end"} == want


def test_alert_job(spark, sf, tmp_path):
    """JSON events in both key styles go through validation and rules to the alert table."""
    e = A.sec_events(spark, sf).withColumn("timestamp", F.col("ts"))
    snake = e.where("event_id % 2 = 0").select(*[c for c in e.columns if c != "ts"])
    camel = e.where("event_id % 2 = 1").select(
        F.col("agent_id").alias("agentId"), "timestamp", F.col("event_type").alias("eventType"), "hostname",
        F.col("ip_address").alias("ipAddress"), "pid", F.col("parent_pid").alias("parentPid"),
        F.col("process_name").alias("processName"), F.col("process_path").alias("processPath"), "user",
        F.col("parent_process_name").alias("parentProcessName"), F.col("thread_count").alias("threadCount"),
        F.col("event_id").alias("eventId"))
    folder = str(tmp_path)
    snake.write.json(folder + "/in")
    camel.write.mode("append").json(folder + "/in")
    with open(folder + "/in/bad.json", "w") as f:
        f.write('{"agent_id": "x", broken\n{"agent_id": "x", "event_type": "PROCESS_CREATED"}\n')
    q = jobs.alert_job(stream_events(spark, folder + "/in"), lambda: K.custom_rules(spark),
                       folder + "/alerts", folder + "/quarantine", folder + "/cp")
    q.awaitTermination(180)
    assert q.exception() is None
    from watchframe.operators.detection import worst_match_alerts
    got = {r.event_id: r.rule for r in spark.read.parquet(folder + "/alerts").collect()}
    want = {r.event_id: r.rule for r in worst_match_alerts(A.sec_events(spark, sf), K.custom_rules(spark)).collect()}
    assert got == want
    assert spark.read.parquet(folder + "/quarantine").count() == 2


def test_fold_is_pure():
    fold = S.burst_fold(60_000_000, 5)
    state, hits = None, []
    for s in [0, 10, 20, 30, 59, 61, 62, 63, 64, 70, 200, 261]:
        state, found = fold(state, s * 1_000_000, {})
        hits += [s] * len(found)
    assert hits == [59, 70]
    assert reduce(lambda a, b: a + b, hits) == 129


class _Handle:
    """The state and timers of one key, in memory."""

    def __init__(self):
        self.timers, self.rows, self.value = set(), [], None

    def getListState(self, *_):
        return _Cell(self, "rows")

    def getValueState(self, *_):
        return _Cell(self, "value")

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)


class _Cell:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        return getattr(self.handle, self.name)

    def exists(self):
        return bool(self.get())

    def appendValue(self, row):
        self.handle.rows = [*self.handle.rows, row]

    def put(self, rows):
        self.handle.rows = rows

    def update(self, value):
        self.handle.value = value

    def clear(self):
        setattr(self.handle, self.name, [] if self.name == "rows" else None)


def test_state_expires():
    """A silent key keeps no state and no timer beyond its ttl; a late waking changes nothing."""
    from types import SimpleNamespace as N
    handle = _Handle()
    made = S.OrderedFold(S.quota_fold(60_000_000, 10), 60_000_000)
    made.init(handle)
    list(made.handleInputRows(("u",), [N(us=5_000_500, tie=1, body="{}"), N(us=6_000_000, tie=2, body="{}")], None))
    found = []
    while handle.timers:
        at = min(handle.timers)
        handle.timers.remove(at)
        found += made.handleExpiredTimer(("u",), N(getCurrentWatermarkInMs=lambda at=at: at), None)
    assert [f.tie for f in found] == [1, 2]
    assert handle.value is None and not handle.rows and at == 66_000
