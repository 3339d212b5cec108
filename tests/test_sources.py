"""Readers, checks, text tables, sinks."""

import hashlib

from pyspark.sql import functions as F

from watchframe.sources import events as EV
from watchframe.sources import hosts as HO


def test_read_both_key_styles(spark, tmp_path):
    (tmp_path / "e.json").write_text(
        '{"agent_id": "a", "timestamp": "2024-01-01T00:00:00Z", "event_type": "X", "parent_pid": 4, "processes": [{"name": "n", "pid": 1}]}\n'
        '{"agentId": "b", "timestamp": "2024-01-01T00:00:00Z", "eventType": "Y", "parentPid": 5, "networkConnections": [{"remote": "r:1", "state": "S"}],'
        ' "users": [{"username": "u", "active": "true"}]}\n{broken\n')
    rows = {r.agent_id: r for r in EV.read_events(spark, str(tmp_path)).collect()}
    assert (rows["a"].event_type, rows["a"].parent_pid, rows["a"].processes[0].name) == ("X", 4, "n")
    assert (rows["b"].event_type, rows["b"].parent_pid, rows["b"].network_connections[0].remote) == ("Y", 5, "r:1")
    assert rows["b"].users == [{"username": "u", "active": "true"}]
    valid, bad = EV.validate_events(EV.read_events(spark, str(tmp_path)).cache())
    assert valid.count() == 2 and "not valid JSON" in bad.first().reasons


def test_limits(spark):
    df = spark.createDataFrame([("a", "x" * 64, "y"), (" ", "x" * 65, "y"), ("b", None, None)], "agent_id string, file_hash string, event_type string")
    valid, bad = EV.validate_events(df)
    assert valid.count() == 1
    assert sorted(tuple(r.reasons) for r in bad.collect()) == [
        ("agent_id is missing", "file_hash is longer than 64"), ("event_type is missing",)]


def test_long_syslog_is_kept(spark):
    lines = spark.createDataFrame([(None, "<86>sshd[1]: Failed password " + "x" * 99)], "host string, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    event = EV.normalise_syslog(lines).first()
    assert event.agent_id == "network-device-unknown" and len(event.message) > 100
    row = EV.syslog_rows(lines).first()
    assert (row.facility, row.severity, row.app_name) == (10, 6, "sshd")


def test_telemetry_nesting(spark):
    schema = ("device_id string, ts timestamp, ip_local string, cpu_usage double, ram_usage double, processes array<struct<name:string,pid:bigint>>, "
              "users array<map<string,string>>, network_flows array<map<string,string>>")
    snap = spark.createDataFrame([("d", None, "10.0.0.2", 12.5, 34.0, [("n", 3)], [{"username": "u"}], [{"src": "s", "port": "1"}])], schema)
    row = EV.normalise_metrics(snap).first()
    assert (row.ip_address, row.processes[0].name, row.users, row.network_flows) == ("10.0.0.2", "n", [{"username": "u"}], [{"src": "s", "port": "1"}])
    table = EV.telemetry_from_events(EV.normalise_metrics(snap)).first()
    assert table.processes.list[0].pid == 3 and table.cpu_usage == 12.5


def test_append_alerts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00")], "agent_id string, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    EV.append_alerts(rows, str(tmp_path / "t"))
    EV.append_alerts(rows, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 4 and table.where("dt = '2024-01-01' AND NOT is_resolved").count() == 2
    assert "dt=2024-01-01" in {p.name for p in (tmp_path / "t").iterdir()}


def test_oui(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# head\n\n00:00:0C\tCisco\tCisco Systems\n00:00:0c:00\t Other \nno tab\n")
    rows = {r.prefix: r.vendor for r in HO.read_oui(spark, str(tmp_path)).collect()}
    assert rows == {"00000C": "Other"}


def test_socket_tables(spark):
    lines = [("h", "linux", "Netid State Recv-Q Send-Q Local Peer Process"), ("h", "linux", 'tcp ESTAB 0 0.0.0.0:1 8.8.8.8:53 users:(("x",pid=7,fd=3))'),
             ("h", "linux", "udp UNCONN 0 0 1.1.1.1:1"), ("w", "windows", "  TCP 1.1.1.1:5 2.2.2.2:6 ESTABLISHED 44"), ("w", "windows", "  TCP 1.1.1.1:5 2.2.2.2:6 LISTENING 0"),
             ("w", "windows", "  Proto  Local Address  Foreign Address  State PID"), ("m", "macos", "COMMAND PID USER FD TYPE DEVICE SIZE NODE NAME x"),
             ("m", "macos", "app 9 u 1u IPv4 0x1 0t0 TCP 1.1.1.1:1->2.2.2.2:2 (ESTABLISHED)"), ("m", "macos", "app 9 u 1u IPv4 0x1 0t0 UDP 1.1.1.1:1")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(lines)], "host string, os string, line string, line_no int").withColumn("ts", F.lit(0))
    got = {(r.host, r.pid): [tuple(c) for c in r.network_connections] for r in HO.parse_socket_table(df).collect()}
    assert got[("h", 7)] == [("tcp", "0.0.0.0:1", "8.8.8.8:53", "ESTAB")]
    assert got[("w", 44)] == [("TCP", "1.1.1.1:5", "2.2.2.2:6", "ESTABLISHED")]
    assert got[("m", 9)][0] == ("0t0", "1.1.1.1:1->2.2.2.2:2", "1.1.1.1:1->2.2.2.2:2", "(ESTABLISHED)")
    assert got[("m", 9)][1][1:] == ("1.1.1.1:1", "", None) and len(got) == 3


def test_arp(spark):
    df = spark.createDataFrame([("h", "windows", "  10.0.0.1   aa-bb-cc-dd-ee-0f  dynamic"), ("h", "linux", "10.0.0.2 ether aa:bb:cc:dd:ee:01 C eth0"),
                                ("h", "linux", "10.0.0.3 ether 00:00:00:00:00:00 C"), ("h", "linux", "Address HWtype HWaddress"), ("h", "linux", "10.0.0.4 (incomplete)")],
                               "host string, os string, line string")
    assert {(r.ip_address, r.mac_address) for r in HO.parse_arp_table(df).collect()} == {
        ("10.0.0.1", "AA:BB:CC:DD:EE:0F"), ("10.0.0.2", "AA:BB:CC:DD:EE:01")}


def test_hashes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"hello")
    row = HO.hash_files(spark, str(tmp_path)).first()
    assert row.sha256 == hashlib.sha256(b"hello").hexdigest()
    assert spark.range(1).select(HO.content_hash(F.lit(None).cast("binary")).alias("h")).first().h == ""
    e = spark.createDataFrame([(row.path,), (None,), ("",)], "process_path string")
    assert sorted(r.file_hash for r in HO.with_file_hashes(e, HO.hash_files(spark, str(tmp_path))).collect()) == ["", "", row.sha256]


def test_sender(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "agent_id string, sender_id string")
    assert EV.match_sender(df).count() == 1
