"""Block-wise folds equal plain simulations, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from watchframe.operators import correlation as C
from watchframe.operators import sequence as Q

T0 = 1_704_067_200_000_000


def skewed(seed, n=1500, gap=30, usual=(1, 2, 7, 20)):
    """(agent, micros, id): agent hot has two thirds of the rows; times repeat and pause."""
    rng, rows, clock = random.Random(seed), [], {}
    for i in range(n):
        agent = "hot" if rng.random() < 0.66 else f"a{rng.randrange(8)}"
        step = 0 if rng.random() < 0.1 else rng.choice([1, 5, gap, gap, 61, 120] if rng.random() < 0.3 else usual)
        clock[agent] = clock.get(agent, 0) + step * 1_000_000
        rows.append((agent, clock[agent], i))
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(a, T0 + t, i) for a, t, i in rows], "agent_id string, us bigint, event_id bigint"
                                 ).withColumn("ts", F.timestamp_micros("us"))


def by_agent(rows):
    out = {}
    for a, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(a, []).append((t, i))
    return out


@pytest.mark.parametrize("seed,block,slot", [(1, 4, 30), (2, 7, 300), (3, 50, 10), (4, 500_000, 60)])
def test_brute_force(spark, seed, block, slot):
    rows = skewed(seed)
    want = set()
    for agent, seq in by_agent(rows).items():
        t0, n = None, 0
        for t, i in seq:
            if n == 0 or t - t0 >= 60_000_000:
                t0, n = t, 0
            n += 1
            if n == 5:
                want.add((agent, i))
                n = 0
    e = frame(spark, rows).withColumns({"event_type": F.lit("SYSLOG_NETWORK"), "hostname": F.lit("h"),
                                        "message": F.lit("Authentication FAILURE for x")})
    got = C.brute_force_alerts(e, block_rows=block, slot_seconds=slot)
    assert {(r.agent_id, r.event_id) for r in got.collect()} == want and want


def test_brute_force_boundaries(spark):
    seconds = [0, 10, 20, 30, 59, 61, 62, 63, 64, 70, 200, 261]
    rows = [("x", s * 1_000_000, s) for s in seconds] + [("y", s * 1_000_000, s) for s in (0, 1, 2, 3, 60)] + [
        ("z", s, n) for n, s in enumerate((0, 1, 2, 3, 59_999_999))]
    e = frame(spark, rows).withColumns({"event_type": F.lit("SYSLOG_NETWORK"), "hostname": F.lit("h"),
                                        "message": F.lit("failed password")})
    for block in (4, 500_000):
        got = {(r.agent_id, r.event_id) for r in C.brute_force_alerts(e, block_rows=block).collect()}
        assert got == {("x", 59), ("x", 70), ("z", 4)}


def conns(spark, rows, ports=lambda i: "443"):
    schema = "agent_id string, us bigint, event_id bigint, pid bigint, network_connections array<struct<proto:string,local:string,remote:string,state:string>>"
    data = [(a, T0 + t, i, None if i % 2 else 0, [("tcp", "l", f"8.8.4.4:{ports(i)}", "ESTABLISHED")]) for a, t, i in rows]
    return spark.createDataFrame(data, schema).withColumns({"ts": F.timestamp_micros("us"), "process_name": F.lit("p")})


def simulate_beacons(seq, keep=20, ttl=3600, least=5, limit=5.0):
    held, out = [], []
    for t, i, port in seq:
        if held and t - held[-1][0] >= ttl * 1_000_000:
            held = []
        if (t, port) in held:
            continue
        held = [*held, (t, port)][-keep:]
        if len(held) >= least:
            gaps = [(b[0] - a[0]) / 1e6 for a, b in zip(held, held[1:])]
            mean = sum(gaps) / len(gaps)
            var = sum((g - mean) ** 2 for g in gaps) / len(gaps)
            if var < limit and mean > 0:
                out.append((i, len(held)))
                held = []
    return out


@pytest.mark.parametrize("seed,block,ttl", [(1, 40, 3600), (2, 53, 100), (3, 41, 61), (4, 500_000, 3600)])
def test_beacons(spark, seed, block, ttl):
    rows = skewed(seed, 900, 25, usual=(24, 25, 25, 26) if seed % 2 else (1, 2, 3))
    want = {(a, i, n) for a, seq in by_agent(rows).items()
            for i, n in simulate_beacons([(t, i, "443") for t, i in seq], ttl=ttl)}
    got = C.beacon_alerts(conns(spark, rows), ttl_seconds=ttl, block_rows=block, slot_seconds=45)
    assert {(r.agent_id, r.event_id, r.samples) for r in got.collect()} == want and want


@pytest.mark.parametrize("block", [40, 500_000])
def test_beacons_with_repeats(spark, block):
    """Equal connections of one event count once, but anew after an alert."""
    rows = skewed(5, 500, 9, usual=(24, 25, 25, 26))
    want = {(a, i, n) for a, seq in by_agent(rows).items()
            for i, n in simulate_beacons([(t, i, "443") for t, i in seq for _ in range(3)])}
    thrice = conns(spark, rows).withColumn("network_connections", F.flatten(F.array(*["network_connections"] * 3)))
    got = C.beacon_alerts(thrice, block_rows=block, slot_seconds=45)
    assert {(r.agent_id, r.event_id, r.samples) for r in got.collect()} == want and want
    even = conns(spark, [("x", n * 10_000_000, n) for n in range(1, 11)])
    twice = even.withColumn("network_connections", F.flatten(F.array(*["network_connections"] * 2)))
    assert sorted(r.event_id for r in C.beacon_alerts(even, block_rows=block).collect()) == [5, 10]
    assert sorted(r.event_id for r in C.beacon_alerts(twice, block_rows=block).collect()) == [5, 9]


def test_beacon_edges(spark):
    rows = [("x", s * 10_000_000, s) for s in range(6)]
    got = C.beacon_alerts(conns(spark, rows)).collect()
    assert [(r.event_id, r.samples, r.mean_interval, r.variance) for r in got] == [(4, 5, 10.0, 0.0)]
    two_ports = [("x", 0, 0), ("x", 0, 1)] + [("x", s * 10_000_000, s + 1) for s in range(1, 5)]
    got = C.beacon_alerts(conns(spark, two_ports, lambda i: "80" if i == 0 else "443")).collect()
    assert all("80" in r.ports for r in got)


@pytest.mark.parametrize("block,slot", [(12, 20), (500_000, 60)])
def test_zscore_and_candidates(spark, block, slot):
    rows = skewed(9, 700)
    rng = random.Random(5)
    value = {i: rng.choice([1.0, 2.0, 3.0, 40.0 if rng.random() < 0.05 else 2.5]) for _, _, i in rows}
    want = set()
    for agent, seq in by_agent(rows).items():
        v = [value[i] for _, i in seq]
        for k, (_, i) in enumerate(seq):
            past = v[max(0, k - 12):k]
            if len(past) >= 12:
                mean = sum(past) / 12
                std = (sum((x - mean) ** 2 for x in past) / 11) ** 0.5
                if std > 0 and abs(v[k] - mean) / std > 3:
                    want.add((agent, i))
    values = spark.createDataFrame(list(value.items()), "event_id bigint, value double")
    m = frame(spark, rows).join(values, "event_id").withColumn("metric", F.lit("cpu_usage"))
    got = C.zscore_anomalies(m, 12, 3.0, 12, block_rows=block, slot_seconds=slot)
    assert {(r.agent_id, r.event_id) for r in got.collect()} == want and want


@pytest.mark.parametrize("seed,block", [(1, 60), (2, 120), (3, 3600), (5, 100)])
def test_request_quota(spark, seed, block):
    rows = [(a, t + random.Random(i).randrange(1000) * 1000, i) for a, t, i in skewed(seed, 1200, 15)]
    want = {}
    for agent, seq in by_agent(rows).items():
        t0, n = None, 0
        for t, i in seq:
            ms = (T0 + t) // 1000
            if t0 is None or ms - t0 >= 60_000:
                t0, n = ms, 0
            n += 1
            want[i] = (n, n <= 5, t0)
    got = C.request_quota(frame(spark, rows), 5, user="agent_id", block_seconds=block)
    assert {r.event_id: (r.request_number, r.allowed, int(r.window_start.timestamp() * 1000)) for r in
            got.collect()} == want


def test_quota_of_one_burst(spark):
    rows = [("u", i * 1_000_000, i) for i in range(25)]
    got = C.request_quota(frame(spark, rows), 20, user="agent_id").where("allowed")
    assert sorted(r.event_id for r in got.collect()) == list(range(20))


def test_lineage_boundaries(spark):
    rows = [(0, "winword.exe", "cmd.exe", 0), (100, "x", "a", None), (300, "x", "a", 0), (310, "winword.exe", "cmd.exe", None),
            (609, "x", "a", 0), (610, "x", "a", 0)]
    e = spark.createDataFrame([(s, T0 + s * 1_000_000, p, c, pp) for s, p, c, pp in rows],
                              "event_id bigint, us bigint, parent_process_name string, process_name string, parent_pid bigint")
    e = e.withColumns({"ts": F.timestamp_micros("us"), "agent_id": F.lit("a"), "event_type": F.lit("PROCESS_CREATED"),
                       "pid": F.lit(7)})
    assert sorted(r.event_id for r in C.lineage_escalation_alerts(e).collect()) == [100, 609]


def test_row_numbers(spark):
    rows = skewed(11, 800)
    want = {i: k for seq in by_agent(rows).values() for k, (_, i) in enumerate(seq, 1)}
    got = Q.number_rows(frame(spark, rows), ["agent_id"], ["ts", "event_id"], slot_seconds=7)
    totals = {a: len(s) for a, s in by_agent(rows).items()}
    assert {r.event_id: r._seq for r in got.collect()} == want
    assert all(r._total == totals[r.agent_id] for r in got.collect())
    with pytest.raises(ValueError):
        Q.with_blocks(got, 10, 5)


def test_new_processes(spark):
    snaps = [("h", 1, 1), ("h", 1, 2), ("h", 2, 2), ("h", 2, 3), ("h", 3, 1), ("h", 3, 2), ("g", 9, 1)]
    df = spark.createDataFrame(snaps, "host string, n bigint, pid bigint").withColumn("ts", F.timestamp_seconds("n"))
    assert sorted((r.n, r.pid) for r in C.new_processes(df).collect()) == [(2, 3), (3, 1)]
