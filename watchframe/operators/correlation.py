"""Detections over time: failed-login bursts, lineage, beacons, anomalies, quotas.

All take event time as the clock.  Event tables need ``event_id`` as tie
breaker.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchframe.functions import signatures as sig
from watchframe.functions.ids import unknown_pid
from watchframe.functions.net import is_private, remote_host, remote_port
from watchframe.functions.text import blank_to_null, contains_any, equals_any_part, or_none, strip
from watchframe.operators.sequence import (BLOCK_ROWS, SLOT_SECONDS, StateMachine, fold_blocks,
                                           look_back_window, micros, number_rows,
                                           spans, whole_groups, with_blocks)


# ---------------------------------------------------------------- failed logins

def failed_logins(events: DataFrame, message: str = "message") -> DataFrame:
    return events.where((F.col("event_type") == "SYSLOG_NETWORK")
                        & contains_any(F.lower(F.col(message)), sig.FAILED_LOGIN_PHRASES))


def _burst_machine(ttl_us: int, limit: int) -> StateMachine:
    def step(t, i, held):
        if held and t[i] - t[i - held] >= ttl_us:
            held = 0
        held += 1
        return (0, True) if held == limit else (held, False)

    return StateMachine(limit - 1, step, lambda columns, t, i, before: (limit,), "attempts bigint")


def brute_force_alerts(events: DataFrame, ttl_seconds: int = 60, limit: int = 5,
                       message: str = "message", block_rows: int = BLOCK_ROWS,
                       slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """CRITICAL at the ``limit``-th failure of an agent in a window.

    The window opens at its first failure, lasts strictly less than
    ``ttl_seconds`` and closes at the alert.
    """
    failures = failed_logins(events, message).select("agent_id", "ts", "event_id", "hostname")
    numbered = number_rows(failures, ["agent_id"], ["ts", "event_id"], slot_seconds=slot_seconds)
    fired = fold_blocks(numbered, ["agent_id"], _burst_machine(ttl_seconds * 1_000_000, limit),
                        ["event_id", "ts", "hostname"], block_rows=block_rows)
    return fired.select(
        "agent_id", "event_id", F.col("ts").alias("timestamp"), F.lit("CRITICAL").alias("severity"),
        F.lit("syslog_auth").alias("process_name"),
        F.lit("correlation_bruteforce").alias("event_type"), "attempts",
        F.concat(F.lit("Multiple failed login attempts ("), F.col("attempts").cast("string"),
                 F.lit(f") detected within {ttl_seconds} seconds on "), or_none(F.col("hostname")),
                 F.lit(".")).alias("description"))


# ---------------------------------------------------------------- process lineage

def _opens_tool(parent: Column, child: Column) -> Column:
    return (equals_any_part(F.lower(parent), sig.DOCUMENT_PARENTS)
            & equals_any_part(F.lower(child), sig.DOCUMENT_CHILDREN))


def _has_parent(events: DataFrame) -> DataFrame:
    return events.where((F.col("event_type") == "PROCESS_CREATED")
                        & blank_to_null(F.col("parent_process_name")).isNotNull())


def document_exploit_alerts(events: DataFrame) -> DataFrame:
    """CRITICAL for an office or reader program that starts a download or shell tool."""
    hits = _has_parent(events).where(_opens_tool(F.col("parent_process_name"), F.col("process_name")))
    return hits.select(
        "agent_id", "event_id", F.col("ts").alias("timestamp"), F.lit("CRITICAL").alias("severity"),
        F.coalesce(blank_to_null(F.col("process_name")), F.lit("unknown")).alias("process_name"),
        F.lit("correlation_lineage").alias("event_type"),
        F.concat(F.lit("Suspicious child process '"), or_none(F.col("process_name")),
                 F.lit("' spawned by '"), or_none(F.col("parent_process_name")),
                 F.lit("' — possible macro/document exploit.")).alias("description"))


def lineage_escalation_alerts(events: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """HIGH for children of an (agent, parent pid) marked less than the ttl before.

    A mark is a row of :func:`document_exploit_alerts`.  A mark can only reach
    rows of its own time slot and the next one (slots last one ttl), so the
    search is cut by slot as well as by key.
    """
    ttl_us = ttl_seconds * 1_000_000
    rows = _has_parent(events).select(
        "agent_id", "ts", "event_id", "pid", "parent_pid", "parent_process_name", "process_name",
        unknown_pid(F.col("parent_pid")).alias("_ppid"),
        F.call_function("div", micros(F.col("ts")), F.lit(ttl_us)).alias("_slot"),
        _opens_tool(F.col("parent_process_name"), F.col("process_name")).alias("_mark"))
    copies = F.when(F.col("_mark"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = (rows.withColumn("_shift", F.explode(copies))
              .withColumn("_slot", F.col("_slot") + F.col("_shift")))
    before = (Window.partitionBy("agent_id", "_ppid", "_slot").orderBy("ts", "event_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    last = F.last(F.when(F.col("_mark"), micros(F.col("ts"))), ignorenulls=True).over(before)
    hits = (spread.withColumn("_last", last)
            .where((F.col("_shift") == 0) & (micros(F.col("ts")) - F.col("_last") < ttl_us)))
    return hits.select(
        "agent_id", "event_id", F.col("ts").alias("timestamp"), F.lit("HIGH").alias("severity"),
        F.coalesce(blank_to_null(F.col("process_name")), F.lit("unknown")).alias("process_name"),
        F.lit("correlation_lineage").alias("event_type"),
        F.concat(F.lit("Child process '"), or_none(F.col("process_name")), F.lit("' (PID "),
                 or_none(F.col("pid")), F.lit(") spawned by previously flagged parent '"),
                 or_none(F.col("parent_process_name")), F.lit("' (PID "),
                 or_none(F.col("parent_pid")), F.lit("). Possible ongoing compromise.")
                 ).alias("description"))


# ---------------------------------------------------------------- beacons

def public_contacts(events: DataFrame) -> DataFrame:
    """Public connections by (agent, pid, remote host), with ``repeat`` marking repeats.

    Of equal times and ports the first counts, and the last once more as a repeat.
    """
    keep = F.filter("network_connections", lambda c: F.coalesce(
        (c["state"] == "ESTABLISHED") & F.contains(c["remote"], F.lit(":"))
        & ~is_private(remote_host(c["remote"])), F.lit(False)))
    contacts = events.select(
        "agent_id", unknown_pid(F.col("pid")).alias("pid_key"), "event_id", "ts", "process_name",
        F.posexplode(keep).alias("_pos", "_c")
    ).select("agent_id", "pid_key", remote_host(F.col("_c.remote")).alias("host"), "ts",
             remote_port(F.col("_c.remote")).alias("port"),
             F.struct("event_id", "_pos", "process_name").alias("_first"))
    return (contacts.groupBy("agent_id", "pid_key", "host", "ts", "port")
            .agg(F.min("_first").alias("_first"), F.max("_first").alias("_last"))
            .withColumn("_rows", F.array(F.struct(F.col("_first").alias("c"), F.lit(False).alias("repeat")),
                                         F.struct(F.col("_last").alias("c"), F.lit(True).alias("repeat"))))
            .withColumn("_row", F.explode(F.filter("_rows", lambda r: ~r["repeat"] | (F.col("_first") != F.col("_last")))))
            .select("agent_id", "pid_key", "host", "ts", "port", F.col("_row.c.event_id").alias("event_id"),
                    F.col("_row.c._pos").alias("pos"), F.col("_row.c.process_name").alias("process_name"),
                    F.col("_row.repeat").alias("repeat")))


def _gap_stats(times: list[int]) -> tuple[float, float]:
    """Mean and population variance, in seconds, of the gaps between times."""
    gaps = len(times) - 1
    total = times[-1] - times[0]
    squares = sum((b - a) ** 2 for a, b in zip(times, times[1:]))
    return total / gaps / 1e6, (gaps * squares - total * total) / (gaps * gaps) / 1e12


def _beacon_machine(keep: int, ttl_us: int, least: int, max_variance: float) -> StateMachine:
    def contacts(t, i, before):
        """Rows of the newest distinct contacts held after row i; repeats of a held one do not count."""
        low = i if before and t[i][0] - t[i - 1][0] >= ttl_us else i - before
        found, j = [], i
        while j >= low and len(found) < keep:
            k = j - 1
            while k >= low and t[k][0] == t[j][0] and t[k] != t[j]:
                k -= 1
            if k < low or t[k][0] != t[j][0]:
                found.append(j)
            j -= 1
        return found[::-1]

    def step(t, i, held):
        rows = contacts(t, i, held)
        if len(rows) >= least:
            mean, variance = _gap_stats([t[j][0] for j in rows])
            if variance < max_variance and mean > 0:
                return 0, True
        return i - rows[0] + 1, False

    def report(columns, t, i, before):
        rows = contacts(t, i, before)
        mean, variance = _gap_stats([t[j][0] for j in rows])
        ports = sorted({t[j][1] for j in rows})[:5]
        return mean, variance, len(rows), ",".join(ports)

    # a contact has two rows at most
    return StateMachine(2 * keep, step, report,
                        "mean_interval double, variance double, samples bigint, ports string", marks="port")


CONTACT_KEYS = ["agent_id", "pid_key", "host"]


def beacon_alerts(events: DataFrame, keep: int = 20, ttl_seconds: int = 3600, least: int = 5,
                  max_variance: float = 5.0, block_rows: int = BLOCK_ROWS,
                  slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """HIGH when the gaps of the last contacts with a host are regular; then start anew.

    The last ``keep`` contacts count; a pause of ``ttl_seconds`` forgets them.
    """
    contacts = public_contacts(events)
    numbered = number_rows(contacts, CONTACT_KEYS, ["ts", "event_id", "pos"],
                           slot_seconds=slot_seconds)
    machine = _beacon_machine(keep, ttl_seconds * 1_000_000, least, max_variance)
    fired = fold_blocks(numbered, CONTACT_KEYS, machine,
                        ["event_id", "ts", "process_name", "port"], block_rows=block_rows)
    return fired.select(
        "agent_id", "pid_key", "host", "event_id", F.col("ts").alias("timestamp"),
        F.lit("HIGH").alias("severity"),
        F.coalesce(blank_to_null(F.col("process_name")), F.lit("unknown")).alias("process_name"),
        F.lit("correlation_beacon").alias("event_type"), "mean_interval", "variance", "samples",
        "ports",
        F.format_string("Potential C2 beacon detected: process '%s' (PID %s) connecting to %s:%s "
                        "every %.1fs (variance=%.2f, %d samples).",
                        or_none(F.col("process_name")), F.col("pid_key"), F.col("host"),
                        F.col("ports"), F.col("mean_interval"), F.col("variance"),
                        F.col("samples")).alias("description"))


def beacon_candidates(events: DataFrame, keep: int = 20, least: int = 5,
                      block_rows: int = BLOCK_ROWS, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Gap statistics over the last contacts, without reset: an analyst's view."""
    contacts = public_contacts(events).where("NOT repeat").drop("repeat")
    numbered = number_rows(contacts, CONTACT_KEYS, ["ts", "event_id", "pos"], slot_seconds=slot_seconds)
    blocks = with_blocks(numbered, keep, block_rows)
    order = Window.partitionBy(*CONTACT_KEYS, "_blk").orderBy("_seq")
    # the first of the kept contacts opens a gap that reaches outside the window
    gap = (micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(order)) / 1e6
    frame = look_back_window(CONTACT_KEYS, -(keep - 2), 0)
    stats = (blocks.withColumn("_gap", gap)
             .withColumns({"mean_interval": F.avg("_gap").over(frame),
                           "variance": F.var_pop("_gap").over(frame),
                           "samples": F.count("_gap").over(frame) + 1}))
    return stats.where(~F.col("_halo") & (F.col("samples") >= least)).select(
        *CONTACT_KEYS, "event_id", F.col("ts").alias("timestamp"), "port", "mean_interval",
        "variance", "samples")


# ---------------------------------------------------------------- anomalies

def unpivot_metrics(events: DataFrame) -> DataFrame:
    """(agent, time, event, metric, value) of cpu and ram usage, nulls dropped."""
    return (events.select("agent_id", "ts", "event_id", F.col("cpu_usage").cast("double"),
                          F.col("ram_usage").cast("double"))
            .unpivot(["agent_id", "ts", "event_id"], ["cpu_usage", "ram_usage"], "metric", "value")
            .where(F.col("value").isNotNull()))


def zscore_anomalies(metrics: DataFrame, window: int = 60, threshold: float = 4.0,
                     min_samples: int = 60, block_rows: int = BLOCK_ROWS,
                     slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Values far from the mean of the ``window`` values before them, per agent and metric."""
    keys = ["agent_id", "metric"]
    numbered = number_rows(metrics, keys, ["ts", "event_id"], slot_seconds=slot_seconds)
    blocks = with_blocks(numbered, window, block_rows)
    frame = look_back_window(keys, -window, -1)
    scored = blocks.withColumns({
        "mean": F.avg("value").over(frame), "std": F.stddev_samp("value").over(frame),
        "samples": F.count("value").over(frame)})
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    hits = (scored.where(~F.col("_halo") & (F.col("samples") >= min_samples) & (F.col("std") > 0))
            .withColumn("z", z).where(F.col("z") > threshold))
    return hits.select(
        "agent_id", "metric", "event_id", F.col("ts").alias("timestamp"), "value", "mean", "std",
        F.round("z", 2).alias("z_score"),
        F.when(F.col("z") > threshold * 1.5, "HIGH").otherwise("MEDIUM").alias("severity"))


PROCESS_SCORE_KEYS = {
    "cpu": ["cpu_percent", "cpu_usage", "cpu", "percent"],
    "ram": ["memory_percent", "ram_usage", "mem_usage", "ram", "memory"],
}


def parse_process_strings(processes: Column) -> Column:
    """``name(pid)`` strings as structs; strings without a bracket are left out."""
    bracketed = F.filter(processes, lambda s: F.contains(s, F.lit("(")))
    return F.transform(bracketed, lambda s: F.struct(
        strip(F.split(s, r"\(").getItem(0)).alias("name"),
        F.coalesce(F.regexp_replace(F.split(s, r"\(").getItem(1), r"\)+$", "").try_cast("bigint"),
                   F.lit(0).cast("bigint")).alias("pid"),
        F.lit(0.0).alias("cpu_percent")))


def top_process(processes: Column, fields: list[str], metric: Column) -> Column:
    """Name of the busiest process for a metric, else the first one, else ``unknown``.

    ``fields`` are the field names of the process struct.
    """
    def score(p: Column, kind: str) -> Column:
        found = [p[f].try_cast("double") for f in PROCESS_SCORE_KEYS[kind] if f in fields]
        return F.coalesce(*found, F.lit(0.0))

    def name(p: Column, *names: str) -> Column:
        return F.coalesce(*[blank_to_null(p[n]) for n in names if n in fields], F.lit("unknown"))

    def ranked(p: Column, i: Column) -> Column:
        value = F.when(F.contains(metric, F.lit("cpu")), score(p, "cpu")).otherwise(score(p, "ram"))
        return F.struct(value.alias("score"), (-i).alias("place"),
                        name(p, "name", "process_name").alias("name"))

    busiest = F.array_max(F.filter(F.transform(processes, ranked), lambda r: r["score"] > 0))["name"]
    first = F.get(F.transform(processes, lambda p: name(p, "name")), F.lit(0))
    return F.coalesce(busiest, first, F.lit("unknown"))


# The texts of the alerts here and above, which users of the alerts match on.
def direct_anomaly_text(metric: Column, z: Column, process: Column, value: Column) -> Column:
    return F.format_string(
        "Suspicious %s spike (z-score=%.1f, threshold=4.0) on process '%s': current=%.1f%% — "
        "significantly above normal baseline. ",
        F.initcap(F.replace(metric, F.lit("_"), F.lit(" "))), z, process, value)


def queue_anomaly_text(metric: Column, z: Column, value: Column) -> Column:
    return F.concat(F.lit("Anomaly in "), metric, F.lit(": "), value.cast("string"),
                    F.format_string(" (z=%.1f)", z))


def anomaly_alerts(anomalies: DataFrame, route: str = "direct") -> DataFrame:
    """Alert rows; the direct route needs ``top_process`` beside the anomaly columns."""
    direct = route == "direct"
    name = F.col("top_process") if direct else F.lit("System")
    text = (direct_anomaly_text(F.col("metric"), F.col("z_score"), name, F.col("value")) if direct
            else queue_anomaly_text(F.col("metric"), F.col("z_score"), F.col("value")))
    return anomalies.select(
        "agent_id", "event_id", "timestamp", "severity", name.alias("process_name"),
        F.lit("statistical_anomaly").alias("event_type"), text.alias("description"))


# ---------------------------------------------------------------- request quota

QUOTA_BLOCK_SECONDS = 3600


def _quota_table(t: np.ndarray, n: np.ndarray, ttl: int) -> tuple[list, list, list]:
    """For a window that starts at row p: the window open after the block.

    Only the last p of each run with an equal result is kept.
    """
    size = len(t)
    upto = np.concatenate([[0], np.cumsum(n)])
    following = np.searchsorted(t, t + ttl)
    last = np.arange(size)
    for p in range(size - 1, -1, -1):
        if following[p] < size:
            last[p] = last[following[p]]
    reachable = min(size, int(np.searchsorted(t, t[0] + ttl)) + 1)
    ends = np.flatnonzero(np.append(last[1:reachable] != last[:reachable - 1], True))
    return (t[ends].tolist(), t[last[ends]].tolist(), (upto[size] - upto[last[ends]]).tolist())


def request_quota(log: DataFrame, limit: int = 20, ttl_seconds: int = 60, user: str = "user_id",
                  block_seconds: int = QUOTA_BLOCK_SECONDS) -> DataFrame:
    """Request log with ``request_number`` in its window and ``allowed``.

    A user's window opens at a request and lasts ``ttl_seconds`` (to the
    microsecond); the counter is not reset at the limit.  Requests without a
    user share one window.  Requests are counted per microsecond first; users are cut into time blocks, and only blocks that
    follow their predecessor without a pause of one ttl are chained.
    """
    ttl, block = ttl_seconds * 1_000_000, block_seconds * 1_000_000
    if block < ttl:
        raise ValueError("a block must be at least as long as the ttl")
    who, user = user, "_user"
    timed = log.withColumns({"_us": F.unix_micros("ts"),
                             user: F.coalesce(F.concat(F.lit("="), F.col(who).cast("string")), F.lit("none"))})
    counts = (timed.groupBy(user, "_us").agg(F.count("*").alias("_n"))
              .withColumn("_blk", F.call_function("div", F.col("_us"), F.lit(block))))
    extents = counts.groupBy(user, "_blk").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    per_user = Window.partitionBy(user).orderBy("_blk")
    linked = extents.withColumn(
        "_fresh", F.coalesce(F.col("_lo") - F.lag("_hi").over(per_user) >= ttl, F.lit(True)))
    run_id = F.sum(F.col("_fresh").cast("bigint")).over(per_user)
    linked = linked.withColumn("_run", run_id).withColumn(
        "_len", F.count("*").over(Window.partitionBy(user, "_run")))
    chained = linked.where(F.col("_len") > 1).select(user, "_blk", "_run")

    by = [user, "_blk"]
    user_field = T.StructField(user, T.StringType())
    table_schema = T.StructType([
        user_field, T.StructField("_blk", T.LongType()), T.StructField("_run", T.LongType()), T.StructField("total", T.LongType()),
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("at", "start", "used")]])

    def tables(batches):
        for frame, begin in whole_groups(batches, by):
            t, n = frame["_us"].to_numpy(), frame["_n"].to_numpy()
            made = [_quota_table(t[b:e], n[b:e], ttl) for b, e in spans(begin, len(t))]
            heads = frame.iloc[begin][[*by, "_run"]].reset_index(drop=True)
            yield heads.assign(total=np.add.reduceat(n, begin), at=[m[0] for m in made],
                               start=[m[1] for m in made], used=[m[2] for m in made])

    enter_schema = T.StructType([user_field, T.StructField("_blk", T.LongType()),
                                 T.StructField("_anchor", T.LongType()),
                                 T.StructField("_count", T.LongType())])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        anchor, count, rows = None, 0, []
        for row in group.sort_values("_blk").to_dict("records"):
            p = 0
            if anchor is not None:
                rows.append((row[user], row["_blk"], anchor, count))
                p = int(np.searchsorted(row["at"], anchor + ttl))
            if p < len(row["at"]):
                anchor, count = int(row["start"][p]), int(row["used"][p])
            else:
                count += int(row["total"])
        return pd.DataFrame(rows, columns=[user, "_blk", "_anchor", "_count"])

    entered = (counts.join(chained, by).select(user, "_blk", "_run", "_us", "_n")
               .repartition(*by).sortWithinPartitions(*by, "_us")
               .mapInPandas(tables, table_schema)
               .groupBy(user, "_run").applyInPandas(chain, enter_schema))

    walk_schema = T.StructType([user_field, T.StructField("_us", T.LongType()),
                                T.StructField("_start", T.LongType()),
                                T.StructField("_before", T.LongType())])

    def walk(batches):
        for frame, begin in whole_groups(batches, by):
            t, n = frame["_us"].tolist(), frame["_n"].tolist()
            known = frame["_anchor"].to_numpy(dtype=float, na_value=np.nan)
            counts = frame["_count"].to_numpy(dtype=float, na_value=np.nan)
            starts, before = [0] * len(t), [0] * len(t)
            for b, e in spans(begin, len(t)):
                anchor, count = float("-inf"), 0
                if known[b] == known[b]:
                    anchor, count, b = int(known[b]), int(counts[b]), b + 1
                for i in range(b, e):
                    if t[i] - anchor >= ttl:
                        anchor, count = t[i], 0
                    starts[i], before[i] = anchor, count
                    count += n[i]
            out = frame[[user, "_us"]].assign(_start=starts, _before=before)
            yield out[~(known == known)]

    none = F.lit(None).cast("bigint")
    rows = (counts.withColumns({"_anchor": none, "_count": none})
            .unionByName(entered.withColumns({"_us": F.lit(-1).cast("bigint"),
                                              "_n": F.lit(0).cast("bigint")})))
    windows = (rows.repartition(*by).sortWithinPartitions(*by, "_us").mapInPandas(walk, walk_schema))
    place = F.row_number().over(Window.partitionBy(user, "_us").orderBy("ts", "event_id"))
    return (timed.withColumn("_place", place).join(windows, [user, "_us"])
            .withColumn("request_number", F.col("_before") + F.col("_place"))
            .withColumns({"allowed": F.col("request_number") <= limit,
                          "window_start": F.timestamp_micros("_start")})
            .drop("_us", "_place", "_start", "_before", user))


# ---------------------------------------------------------------- snapshots and queues

def new_processes(snapshots: DataFrame) -> DataFrame:
    """Processes present now and absent in the host's previous snapshot.

    ``snapshots`` holds (host, ts, pid, ...); a host's first snapshot is the
    baseline.  The previous time is looked up on the distinct (host, ts) pairs.
    """
    times = snapshots.select("host", "ts").distinct().withColumn(
        "_prev", F.lag("ts").over(Window.partitionBy("host").orderBy("ts")))
    current = snapshots.join(times.where(F.col("_prev").isNotNull()), ["host", "ts"])
    seen = snapshots.select("host", F.col("ts").alias("_prev"), "pid").distinct()
    return current.join(seen, ["host", "_prev", "pid"], "left_anti").drop("_prev")


def bounded_queue(commands: DataFrame, size: int = 100) -> DataFrame:
    """The newest ``size`` commands per agent (Spark prunes before the shuffle)."""
    place = F.row_number().over(
        Window.partitionBy("agent_id").orderBy(F.desc("sequence")))
    return commands.withColumn("place", place).where(F.col("place") <= size)


def agent_last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("agent_id").agg(F.max("ts").alias("last_seen"))
