"""Streaming forms of the order-dependent detections.

One processor serves all of them.  Rows of a key wait in state until the
watermark has passed them, are then folded in (time, tie) order, and leave only
the small fold state behind; so a stream gives the rows of the batch form for
everything that is not later than the watermark allows.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


from watchframe.functions.ids import unknown_pid
from watchframe.functions.net import is_private, remote_host, remote_port
from watchframe.functions.text import blank_to_null
from watchframe.operators.correlation import _opens_tool, failed_logins, unpivot_metrics

Fold = Callable[[dict | None, int, dict], tuple[dict | None, list[dict]]]

OUTPUT = "key string, us bigint, tie bigint, found string"


class OrderedFold(StatefulProcessor):
    """Folds the rows of a key in time order once the watermark has passed them.

    With ``ttl_us`` the fold starts anew after such a pause; a timer then clears
    the state of a key that has been silent for it.
    """

    def __init__(self, fold: Fold, ttl_us: int | None = None):
        self.fold, self.ttl_us = fold, ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, tie bigint, body string")
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for row in rows:
            self.waiting.appendValue((row.us, row.tie, row.body))
            first = row.us if first is None else min(first, row.us)
        if first is not None:
            self._wake_at(first)
        return iter(())

    def _wake_at(self, us: int) -> None:
        at = -(-us // 1000)
        if at not in set(t if isinstance(t, int) else t[0] for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def _due(self, passed: int) -> Iterator[tuple[int, int, str]]:
        """Takes the rows up to a time out of the waiting ones, in order, and sets the timer of the rest."""
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        later = [r for r in rows if r[0] > passed]
        if later:
            self.waiting.put(later)
            self._wake_at(later[0][0])
        elif rows:
            self.waiting.clear()
        return (r for r in rows if r[0] <= passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        state, last = json.loads(self.state.get()[0]) if self.state.exists() else (None, None)
        out, any_due = [], False
        for us, tie, body in self._due(passed):
            state, found = self.fold(state, us, json.loads(body))
            last, any_due = us, True
            out += [Row(key=key[0], us=us, tie=tie, found=json.dumps(f)) for f in found]
        quiet = self.ttl_us is not None and last is not None and last + self.ttl_us <= passed
        if state is None or quiet:
            if self.state.exists():
                self.state.clear()
        else:
            if any_due:
                self.state.update((json.dumps([state, last]),))
            if self.ttl_us is not None:
                self._wake_at(last + self.ttl_us)
        return iter(out)

    def close(self) -> None:
        pass


class ChunkedFold(OrderedFold):
    """An ordered fold whose rows wait as chunks, each with the rows of a minute of event time.

    Every call to the state is a round trip, and one that adds to a list takes longer the longer
    the list is; so a chunk has many rows and a key of its own.  A timer reads the minutes that have begun.
    """

    MINUTE_US, HELD_BYTES, ROW_BYTES = 60_000_000, 8_000_000, 200

    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "minute bigint, id string", "rows string")
        self.state = handle.getValueState("state", "json string")

    def _put(self, by_minute: dict[int, list]) -> None:
        for minute, rows in by_minute.items():
            self.chunks.updateValue((minute, uuid.uuid4().hex), (json.dumps(rows),))

    def handleInputRows(self, key, rows, timerValues):
        held, size, first = defaultdict(list), 0, None
        for row in rows:
            held[row.us // self.MINUTE_US].append((row.us, row.tie, row.body))
            size += len(row.body) + self.ROW_BYTES
            first = row.us if first is None else min(first, row.us)
            if size >= self.HELD_BYTES:
                self._put(held)
                held, size = defaultdict(list), 0
        self._put(held)
        if first is not None:
            self._wake_at(first)
        return iter(())

    def _due(self, passed):
        for minute, ids in groupby(sorted(self.chunks.keys()), lambda chunk: chunk[0]):
            if minute * self.MINUTE_US > passed:
                return self._wake_at(minute * self.MINUTE_US)
            ids = list(ids)
            rows = sorted(tuple(r) for i in ids for r in json.loads(self.chunks.getValue(i)[0]))
            later = [r for r in rows if r[0] > passed]
            if len(later) < len(rows):
                for i in ids:
                    self.chunks.removeKey(i)
                if later:
                    self._put({minute: later})
                yield from rows[:len(rows) - len(later)]
            if later:
                return self._wake_at(later[0][0])


def ordered_fold(events: DataFrame, key: Column, body: Column, fold: Fold, delay: str,
                 ts: str = "ts", tie: str = "event_id", ttl_us: int | None = None,
                 made: type[OrderedFold] = OrderedFold) -> DataFrame:
    """Stream of (key, us, tie, found): JSON results of the fold per key."""
    rows = (events.withWatermark(ts, delay)
            .select(key.cast("string").alias("key"), F.col(ts).alias("at"),
                    F.unix_micros(ts).alias("us"), F.col(tie).alias("tie"),
                    F.to_json(body).alias("body")))
    return rows.groupBy("key").transformWithState(
        made(fold, ttl_us), OUTPUT, "Append", "EventTime")


def _found(schema: str) -> list[Column]:
    return [F.timestamp_micros("us").alias("timestamp"), F.col("tie").alias("event_id"),
            F.from_json("found", schema).alias("f")]


# ---------------------------------------------------------------- folds

def burst_fold(ttl_us: int, limit: int) -> Fold:
    def fold(state, us, body):
        if state is None or us - state["t0"] >= ttl_us:
            state = {"t0": us, "n": 0}
        state["n"] += 1
        if state["n"] >= limit:
            return None, [{"attempts": state["n"], "hostname": body.get("hostname")}]
        return state, []
    return fold


def lineage_fold(ttl_us: int) -> Fold:
    def fold(state, us, body):
        hit = state is not None and us - state["marked"] < ttl_us
        found = [{k: body.get(k) for k in ("process_name", "parent_process_name")}] if hit else []
        if body["mark"]:
            state = {"marked": us}
        return state, found
    return fold


def beacon_fold(keep: int, ttl_us: int, least: int, max_variance: float) -> Fold:
    def fold(state, us, body):
        seen = state["seen"] if state else []
        if seen and us - seen[-1][0] >= ttl_us:
            seen = []
        if [us, body["port"]] in seen:
            return {"seen": seen}, []
        seen = [*seen, [us, body["port"]]][-keep:]
        if len(seen) >= least:
            gaps = [b[0] - a[0] for a, b in zip(seen, seen[1:])]
            total, n = sum(gaps), len(gaps)
            variance = (n * sum(g * g for g in gaps) - total * total) / (n * n) / 1e12
            if variance < max_variance and total > 0:
                ports = sorted({p for _, p in seen})[:5]
                return None, [{"mean_interval": total / n / 1e6, "variance": variance,
                               "samples": len(seen), "ports": ",".join(ports)}]
        return {"seen": seen}, []
    return fold


def zscore_fold(window: int, threshold: float, min_samples: int) -> Fold:
    def fold(state, us, body):
        past, value, found = (state or {"v": []})["v"], body["value"], []
        n = len(past)
        if n >= max(min_samples, 2):
            mean = sum(past) / n
            std = (sum((v - mean) ** 2 for v in past) / (n - 1)) ** 0.5
            z = abs(value - mean) / std if std > 0 else 0.0
            if z > threshold:
                found = [{"value": value, "z_score": round(z, 2),
                          "severity": "HIGH" if z > threshold * 1.5 else "MEDIUM"}]
        return {"v": [*past, value][-window:]}, found
    return fold


def quota_fold(ttl_us: int, limit: int) -> Fold:
    def fold(state, us, body):
        if state is None or us - state["t0"] >= ttl_us:
            state = {"t0": us, "n": 0}
        state["n"] += 1
        return state, [{"request_number": state["n"], "allowed": state["n"] <= limit}]
    return fold


def new_process_fold(state, us, body):
    """A pack of pids of one snapshot; those of the present and the previous one are keys of a dict (JSON keeps them as text)."""
    if state is None:
        state = {"at": us, "now": {}, "before": None}
    if us > state["at"]:
        state = {"at": us, "now": {}, "before": state["now"]}
    before = state["before"]
    new = [] if before is None else [p for p in body["pids"] if p is None or str(p) not in before]
    state["now"].update((str(p), 1) for p in body["pids"] if p is not None)
    return state, [{"pids": new}] if new else []


# ---------------------------------------------------------------- detections

def brute_force_stream(events: DataFrame, delay: str = "2 minutes", ttl_seconds: int = 60,
                       limit: int = 5, message: str = "message") -> DataFrame:
    rows = ordered_fold(failed_logins(events, message), F.col("agent_id"), F.struct("hostname"),
                        burst_fold(ttl_seconds * 1_000_000, limit), delay, ttl_us=ttl_seconds * 1_000_000)
    return rows.select(F.col("key").alias("agent_id"), *_found("attempts bigint, hostname string")
                       ).select("agent_id", "event_id", "timestamp", "f.*")


def lineage_stream(events: DataFrame, delay: str = "2 minutes", ttl_seconds: int = 300) -> DataFrame:
    rows = events.where((F.col("event_type") == "PROCESS_CREATED")
                        & blank_to_null(F.col("parent_process_name")).isNotNull())
    key = F.to_json(F.struct("agent_id", unknown_pid(F.col("parent_pid")).alias("ppid")))
    body = F.struct("process_name", "parent_process_name",
                    _opens_tool(F.col("parent_process_name"), F.col("process_name")).alias("mark"))
    ttl = ttl_seconds * 1_000_000
    found = ordered_fold(rows, key, body, lineage_fold(ttl), delay, ttl_us=ttl)
    return found.select(F.get_json_object("key", "$.agent_id").alias("agent_id"),
                        *_found("process_name string, parent_process_name string")
                        ).select("agent_id", "event_id", "timestamp", "f.*")


def beacon_stream(events: DataFrame, delay: str = "2 minutes", keep: int = 20,
                  ttl_seconds: int = 3600, least: int = 5, max_variance: float = 5.0) -> DataFrame:
    live = F.filter("network_connections", lambda c: F.coalesce(
        (c["state"] == "ESTABLISHED") & F.contains(c["remote"], F.lit(":"))
        & ~is_private(remote_host(c["remote"])), F.lit(False)))
    rows = events.select("agent_id", "pid", "ts", "event_id", F.explode(live).alias("c"))
    key = F.to_json(F.struct("agent_id", unknown_pid(F.col("pid")).alias("pid_key"),
                             remote_host(F.col("c.remote")).alias("host")))
    found = ordered_fold(rows, key, F.struct(remote_port(F.col("c.remote")).alias("port")),
                         beacon_fold(keep, ttl_seconds * 1_000_000, least, max_variance), delay,
                         ttl_us=ttl_seconds * 1_000_000)
    part = lambda name: F.get_json_object("key", f"$.{name}").alias(name)
    return found.select(part("agent_id"), part("pid_key"), part("host"), *_found(
        "mean_interval double, variance double, samples bigint, ports string")).select(
        "agent_id", "pid_key", "host", "event_id", "timestamp", "f.*")


def zscore_stream(events: DataFrame, delay: str = "2 minutes", window: int = 60,
                  threshold: float = 4.0, min_samples: int = 60, ttl_seconds: int | None = None) -> DataFrame:
    """With ``ttl_seconds`` an agent that was silent for it is forgotten and starts with no values."""
    key = F.to_json(F.struct("agent_id", "metric"))
    found = ordered_fold(unpivot_metrics(events), key, F.struct("value"),
                         zscore_fold(window, threshold, min_samples), delay,
                         ttl_us=None if ttl_seconds is None else ttl_seconds * 1_000_000)
    part = lambda name: F.get_json_object("key", f"$.{name}").alias(name)
    return found.select(part("agent_id"), part("metric"), *_found(
        "value double, z_score double, severity string")).select(
        "agent_id", "metric", "event_id", "timestamp", "f.*")


def quota_stream(log: DataFrame, user: str = "user_id", delay: str = "2 minutes", limit: int = 20,
                 ttl_seconds: int = 60) -> DataFrame:
    found = ordered_fold(log, F.col(user), F.struct(F.lit(1).alias("one")),
                         quota_fold(ttl_seconds * 1_000_000, limit), delay, ttl_us=ttl_seconds * 1_000_000)
    return found.select(F.col("key").alias(user), *_found("request_number bigint, allowed boolean")
                        ).select(user, "event_id", "timestamp", "f.*")


def _snapshot_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per host and time of a batch, with all its pids."""
    for batch in batches:
        packs = pa.Table.from_batches([batch]).group_by(["host", "ts"], use_threads=False).aggregate([("pid", "list")])
        yield from packs.select(["host", "ts", "pid_list"]).rename_columns(["host", "ts", "pids"]).to_batches()


def new_processes_stream(snapshots: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """(host, ts, pid) snapshots; rows without a time are in none, a null pid is always new.

    Rows are packed where they are read, so one task gets a host's snapshots, not its single rows.
    """
    packs = (snapshots.where(F.col("ts").isNotNull())
             .select(F.col("host").cast("string"), "ts", F.col("pid").cast("bigint"))
             .mapInArrow(_snapshot_packs, "host string, ts timestamp, pids array<bigint>")
             .withColumn("tie", F.lit(0).cast("bigint")))
    found = ordered_fold(packs, F.col("host"), F.struct("pids"), new_process_fold, delay, tie="tie", made=ChunkedFold)
    return found.select(F.col("key").alias("host"), F.timestamp_micros("us").alias("ts"),
                        F.explode(F.from_json("found", "pids array<bigint>")["pids"]).alias("pid"))
