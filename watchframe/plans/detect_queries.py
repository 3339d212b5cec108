"""Checked queries: sources, static rules, custom rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchframe.functions import conditions as CO
from watchframe.functions.patterns import match_pattern_column
from watchframe.functions import net
from watchframe.functions import signatures as sig
from watchframe.functions.ids import agent_uuid
from watchframe.functions.rules import is_allowed_updater
from watchframe.operators import detection as D
from watchframe.plans import adapters as A
from watchframe.plans import controls as K
from watchframe.plans import oracle as O
from watchframe.plans.oracle import q, with_
from watchframe.plans.registry import query
from watchframe.sources import events as EV
from watchframe.sources import hosts as HO

MATCH = "rule, severity, description, tactic_id, tactic, technique, technique_id"


# ---------------------------------------------------------------- sources

def _raw_events(spark, d):
    i = F.col("event_id")
    return A.sec_events(spark, d).withColumns({
        "timestamp": F.when(i % 53 != 0, F.col("ts")),
        "agent_id": F.when(i % 37 == 0, "  ").otherwise(F.col("agent_id")),
        "process_path": F.when(i % 41 == 0, F.repeat("process_path", 60)).otherwise(F.col("process_path")),
        "hostname": F.when(i % 43 == 0, F.repeat("hostname", 50)).otherwise(F.col("hostname"))})


_RAW = """raw AS (SELECT event_id,
  concat_ws('|', CASE WHEN event_id%37=0 THEN 'agent_id is missing' END,
    CASE WHEN event_id%53=0 THEN 'timestamp is missing' END,
    CASE WHEN event_id%43=0 AND length(hostname)*50>255 THEN 'hostname is longer than 255' END,
    CASE WHEN event_id%41=0 AND length(process_path)*60>1024 THEN 'process_path is longer than 1024' END
  ) AS reasons FROM sec)"""


@query("a02_valid_events", with_("sec", more=_RAW) + "SELECT event_id FROM raw WHERE reasons=''")
def _(spark, d):
    return EV.validate_events(_raw_events(spark, d))[0].select("event_id")


@query("a02_rejected_events", with_("sec", more=_RAW) + "SELECT event_id, reasons FROM raw WHERE reasons<>''")
def _(spark, d):
    return EV.validate_events(_raw_events(spark, d))[1].select("event_id", "reasons")


@query("a03_match_sender", with_("sec") + "SELECT event_id, agent_id FROM sec WHERE event_id%6<>0")
def _(spark, d):
    e = A.sec_events(spark, d)
    sender = F.when(F.col("event_id") % 6 == 0, "someone").otherwise(F.col("agent_id"))
    return EV.match_sender(e.withColumn("sender_id", sender)).select("event_id", "agent_id")


@query("a04_route_events", with_("sec") + """SELECT 'security' AS branch, count(*) AS n FROM sec
  WHERE event_type='PROCESS_CREATED' UNION ALL SELECT 'telemetry', count(*) FROM sec
  WHERE event_type IN ('METRICS_REPORT','AGENT_HEARTBEAT') UNION ALL SELECT 'correlation', count(*) FROM sec""")
def _(spark, d):
    branches = EV.route_events(A.sec_events(spark, d))
    counts = [b.agg(F.lit(name).alias("branch"), F.count("*").alias("n")) for name, b in branches.items()]
    return counts[0].union(counts[1]).union(counts[2])


def _syslog_lines(spark, d):
    i = F.col("event_id")
    return A.sec_events(spark, d).where(F.col("message").isNotNull()).select(
        "event_id", F.when(i % 9 != 0, F.col("hostname")).alias("host"), "ts",
        F.concat(F.lit("<"), i % 192, F.lit(">sshd["), F.col("pid"), F.lit("]: "), F.col("message")).alias("text"))


_LINES = """lines AS (SELECT event_id, CASE WHEN event_id%9<>0 THEN hostname ELSE 'unknown' END AS host, ts_us,
  '<'||(event_id%192)||'>sshd['||pid||']: '||message AS text FROM sec WHERE message IS NOT NULL)"""


@query("a05_normalise_syslog", with_("sec", more=_LINES) + """SELECT 'network-device-'||host AS agent_id, ts_us AS ts,
  'SYSLOG_NETWORK' AS event_type, host AS hostname, 'Network/Appliance' AS os, 'syslog' AS process_name,
  'udp' AS process_path, text AS message FROM lines""")
def _(spark, d):
    return EV.normalise_syslog(_syslog_lines(spark, d))


def _syslog_table(spark, d):
    return EV.syslog_rows(_syslog_lines(spark, d))


@query("a05_syslog_rows", with_("sec", more=_LINES) + """SELECT ts_us AS "timestamp", event_id%192//8 AS facility,
  event_id%192%8 AS severity, host AS hostname, 'sshd' AS app_name, text AS message FROM lines""")
def _(spark, d):
    return _syslog_table(spark, d)


@query("a06_normalise_metrics", with_("telemetry") + """SELECT device_id AS agent_id, "timestamp" AS ts,
  'METRICS_REPORT' AS event_type, '10.0.0.'||(id%200) AS ip_address, '10.0.0.'||(id%200) AS ip_local,
  round(cpu_usage,6) AS cpu_usage, round(ram_usage,6) AS ram_usage, disk_free, disk_total FROM telemetry""")
def _(spark, d):
    t = A.sec_telemetry(spark, d).withColumn("ip_local", F.concat(F.lit("10.0.0."), F.col("id") % 200))
    return EV.normalise_metrics(t.withColumnRenamed("timestamp", "ts").drop("processes"))


@query("a07_agent_uuid", with_("sec") + f"""SELECT agent_id, {O.uuid5('agent_id')} AS uuid,
  {O.uuid5('agent_id')} AS again FROM (SELECT DISTINCT agent_id FROM sec)""")
def _(spark, d):
    ids = A.sec_events(spark, d).select("agent_id").distinct().withColumn("uuid", agent_uuid(F.col("agent_id")))
    return ids.withColumn("again", agent_uuid(F.upper(F.replace("uuid", F.lit("-"), F.lit("")))))


@query("a08_telemetry_from_events", with_("sec") + f"""SELECT {O.uuid5('agent_id')} AS device_id, ts_us AS "timestamp",
  round(cpu_usage,6) AS cpu_usage, round(ram_usage,6) AS ram_usage FROM sec
  WHERE event_type IN ('METRICS_REPORT','AGENT_HEARTBEAT')""")
def _(spark, d):
    return EV.telemetry_from_events(A.sec_events(spark, d))


@query("a09_alert_rows", with_("alerts") + f"""SELECT id, {O.uuid5('agent_id')} AS agent_id,
  coalesce(is_resolved,false) AS is_resolved, CAST(CAST(make_timestamp("timestamp") AS DATE) AS VARCHAR) AS dt FROM alerts""")
def _(spark, d):
    return EV.alert_rows(A.sec_alerts(spark, d)).select("id", "agent_id", "is_resolved", "dt")


@query("a11_vendor_prefixes", """WITH l AS (SELECT event_id, printf('%06X', event_id*7919%4096) AS prefix,
  'Vendor '||(event_id%97) AS vendor FROM events WHERE event_id%10<>0)
  SELECT prefix, arg_max(vendor, event_id) AS vendor FROM l GROUP BY prefix""")
def _(spark, d):
    i = F.col("event_id")
    code = F.lpad(F.hex(i * 7919 % 4096), 6, "0")
    colons = F.concat_ws(":", *[F.lower(F.substring(code, p, 2)) for p in (1, 3, 5)])
    line = F.when(i % 10 == 0, F.concat(F.lit("# "), colons)).otherwise(
        F.concat(colons, F.lit(":00:00:00/36\tVendor "), i % 97, F.lit(" \tlong name")))
    return HO.parse_oui(A.table(spark, d, "events").select(i.alias("line_no"), line.alias("value")))


_SOCK = """sock AS (SELECT event_id, ts_us, hostname AS host, event_id%7 AS pid, event_id%3 AS kind,
  CASE event_id%3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'TCP' ELSE '0t0' END AS proto,
  CASE event_id%3 WHEN 2 THEN '10.0.0.1:'||(event_id%99)||'->8.8.8.8:53' ELSE '10.0.0.1:'||(event_id%99) END AS "local",
  CASE event_id%3 WHEN 2 THEN '10.0.0.1:'||(event_id%99)||'->8.8.8.8:53' ELSE '8.8.8.8:53' END AS remote,
  CASE event_id%3 WHEN 0 THEN 'ESTAB' WHEN 1 THEN 'ESTABLISHED' ELSE '(ESTABLISHED)' END AS state FROM sec)"""


def _socket_lines(spark, d):
    i, pid = F.col("event_id"), F.col("event_id") % 7
    port = (i % 99).cast("string")
    text = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    line = (F.when(i % 3 == 0, text("tcp ESTAB 0 10.0.0.1:", port, "   8.8.8.8:53 users:((\"app\",pid=", pid, ",fd=3))"))
            .when(i % 3 == 1, text("  TCP    10.0.0.1:", port, "  8.8.8.8:53  ESTABLISHED   ", pid))
            .otherwise(text("app ", pid, " root 3u IPv4 0xabc 0t0 TCP 10.0.0.1:", port,
                            "->8.8.8.8:53 (ESTABLISHED)")))
    # the listing of the third system keeps its own column order
    return A.sec_events(spark, d).select(
        F.col("hostname").alias("host"), A.pick(["linux", "windows", "macos"], i).alias("os"),
        i.alias("line_no"), F.col("ts"), line.alias("line"))


@query("a12_socket_rows", with_("sec", more=_SOCK) + """SELECT event_id AS line_no, host, pid, proto, "local", remote, state FROM sock WHERE kind=0 OR pid>0""")
def _(spark, d):
    return HO.socket_rows(_socket_lines(spark, d)).select(
        "line_no", "host", "pid", "conn.proto", "conn.local", "conn.remote", "conn.state")


@query("a12_parse_socket_table", with_("sec", more=_SOCK) + """SELECT host, ts_us AS ts, pid, count(*) AS connections,
  string_agg(proto||','||"local"||','||remote||','||state, ';' ORDER BY event_id) AS listing
  FROM sock WHERE kind=0 OR pid>0 GROUP BY host, ts_us, pid""")
def _(spark, d):
    listed = HO.parse_socket_table(_socket_lines(spark, d))
    one = lambda c: F.concat_ws(",", c["proto"], c["local"], c["remote"], c["state"])
    return listed.select("host", "ts", "pid", F.size("network_connections").cast("bigint").alias("connections"),
                         F.array_join(F.transform("network_connections", one), ";").alias("listing"))


@query("a13_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select(
        "doc_id", HO.content_hash(F.col("text").cast("binary")).alias("sha256"))


@query("a14_parse_arp_table", with_("sec") + """SELECT hostname AS host, ip_address,
  'AA:BB:CC:00:00:'||printf('%02X', event_id%256) AS mac_address FROM sec WHERE event_id%5<>0""")
def _(spark, d):
    i = F.col("event_id")
    last = F.lpad(F.lower(F.hex(i % 256)), 2, "0")
    dashed = F.concat(F.lit("aa-bb-cc-00-00-"), last)
    mac = F.when(i % 5 == 0, "00:00:00:00:00:00").otherwise(
        F.when(i % 2 == 0, dashed).otherwise(F.replace(dashed, F.lit("-"), F.lit(":"))))
    line = F.when(i % 2 == 0, F.concat_ws("   ", F.lit(""), F.col("ip_address"), mac, F.lit("dynamic"))
                  ).otherwise(F.concat_ws(" ", F.col("ip_address"), F.lit("ether"), mac, F.lit("C eth0")))
    return HO.parse_arp_table(A.sec_events(spark, d).select(
        F.col("hostname").alias("host"), A.pick(["windows", "linux"], i).alias("os"), line.alias("line")))


# ---------------------------------------------------------------- static rules

_SLUGS = ["known_attack_tool", "parent_child", "malware_family", "suspicious_path", "privilege_escalation",
          "double_extension", "encoded_command", "persistence_path", "script_interpreter", "network_tool",
          "dll_hijack", "lolbin", "thread_count", "outbound_connection", "autorun_lookalike"]
_IDS = ["b01", "b02", "b03", "b04", "b05", "b06", "b07", "b08", "b09", "b10", "b11", "b12", "b13", "b14", "b15"]


def _register_rule(position: int, key: str, rule: str) -> None:
    conns = rule == "Network Beacon"
    source, cte = (A.sec_conns_mix, "prepc") if conns else (A.sec_events, "prep")

    @query(key, with_(cte) + f"SELECT event_id, {MATCH} FROM ({O.hits(rule, position, cte)})")
    def _(spark, d):
        e = source(spark, d)
        return D.rule_hits(e, rule).select("event_id", *D.MATCH_FIELDS)


for _i, (_id, _slug, _rule) in enumerate(zip(_IDS, _SLUGS, sig.STATIC_RULES)):
    _register_rule(_i, f"{_id}_{_slug}", _rule[0])


def _hosts(spark, d):
    i = F.col("event_id")
    v4 = F.concat_ws(".", A.pick(["10", "172", "192", "127", "169", "0", "8"], i), i * 7 % 256,
                     i * 3 % 256, i % 256)
    host = (F.when(i % 11 == 0, F.concat(F.lit("FE80::"), i % 9)).when(i % 13 == 0, "::1")
            .when(i % 17 == 0, F.concat(F.lit("192.168.1."), i % 256)).otherwise(v4))
    return A.table(spark, d, "events").select("event_id", host.alias("host"))


_HOSTS = f"""hosts AS (SELECT event_id, CASE WHEN event_id%11=0 THEN 'FE80::'||(event_id%9) WHEN event_id%13=0 THEN '::1'
  WHEN event_id%17=0 THEN '192.168.1.'||(event_id%256) ELSE
  {O.pick(["10", "172", "192", "127", "169", "0", "8"], 'event_id')}||'.'||(event_id*7%256)||'.'||(event_id*3%256)||'.'||(event_id%256)
  END AS host FROM events)"""


@query("b16_is_private_v4", f"WITH {_HOSTS} SELECT event_id, host, regexp_matches(host, {q(sig.PRIVATE_V4)}) AS private FROM hosts")
def _(spark, d):
    return _hosts(spark, d).withColumn("private", net.is_private_v4(F.col("host")))


@query("b17_is_private", f"""WITH {_HOSTS} SELECT event_id, host, regexp_matches(host, {q(sig.PRIVATE_V4)})
  OR regexp_matches(host, {q(sig.PRIVATE_V6)}, 'i') AS private FROM hosts""")
def _(spark, d):
    return _hosts(spark, d).withColumn("private", net.is_private(F.col("host")))


@query("b18_split_host_port", with_("mix") + r"""SELECT event_id,
  CASE WHEN contains(remote, ':') THEN regexp_extract(remote, '^(.*):([^:]*)$', 1) END AS host,
  CASE WHEN contains(remote, ':') THEN regexp_extract(remote, '^(.*):([^:]*)$', 2) END AS port FROM mix""")
def _(spark, d):
    remote = F.col("network_connections")[0]["remote"]
    return A.sec_conns_mix(spark, d).select("event_id", net.remote_host(remote).alias("host"),
                                            net.remote_port(remote).alias("port"))


@query("b19_allow_list", with_("prep") + f"SELECT event_id, process_name FROM prep WHERE {O.within('n', sig.ALLOWED_UPDATERS)}")
def _(spark, d):
    return A.sec_events(spark, d).where(is_allowed_updater(F.col("process_name"))).select("event_id", "process_name")


_CATALOG = " UNION ALL ".join(
    f"SELECT {i} AS position, {q(r[0])} AS name, {q(r[1])} AS severity, {q(r[5])} AS technique_id"
    for i, r in enumerate(sig.STATIC_RULES, 1))


@query("b20_rule_catalog_hits", with_("prep", more=f"cat AS ({_CATALOG}), h AS ({O.all_hits()})") + """
  SELECT CAST(position AS BIGINT) AS position, name, cat.severity, cat.technique_id, count(h.event_id) AS hits
  FROM cat LEFT JOIN h ON h.rule=cat.name GROUP BY ALL""")
def _(spark, d):
    found = D.match_all_rules(A.sec_events(spark, d)).groupBy(F.col("rule").alias("name")).agg(
        F.count("*").alias("hits"))
    return D.rule_catalog(spark).join(found, "name", "left").select(
        "position", "name", "severity", "technique_id", F.coalesce("hits", F.lit(0)).alias("hits"))


# ---------------------------------------------------------------- evaluation

_SINGLE = """SELECT event_id, 15 AS pos, 'transfer tools' AS rule, 'HIGH' AS severity,
    '[CUSTOM: transfer tools] Match on process_name' AS description, CAST(NULL AS VARCHAR) AS tactic_id, 'Exfiltration' AS tactic,
    'Transfer' AS technique, 'T1048' AS technique_id FROM prep WHERE regexp_matches(process_name, 'curl|wget', 'i')
  UNION ALL SELECT event_id, 16, 'shell off host one', 'CRITICAL', '[CUSTOM: shell off host one] Match on process_name',
    NULL, NULL, NULL, NULL FROM prep WHERE regexp_matches(process_name, 'x', 'i')
  UNION ALL SELECT event_id, 17, 'root or tmp', 'MEDIUM', '[CUSTOM: root or tmp] Match on user',
    NULL, NULL, NULL, NULL FROM prep WHERE regexp_matches("user", 'x', 'i')
  UNION ALL SELECT event_id, 21, 'empty or', 'CRITICAL', '[CUSTOM: empty or] Match on process_name',
    NULL, NULL, NULL, NULL FROM prep WHERE process_name<>''
  UNION ALL SELECT event_id, 22, 'java by path', 'low', '[CUSTOM: java by path] Match on process_path',
    NULL, 'Execution', 'Scripting', NULL FROM prep WHERE regexp_matches(process_path, '\\\\temp\\\\', 'i')"""
# custom rules of plans.controls written out by hand; o is the order after the static rules
_CUSTOM = """SELECT event_id, 15 AS pos, 'transfer tools' AS rule, 'HIGH' AS severity,
    '[CUSTOM RULE: transfer tools] Match on process_name='''||sn||'''' AS description, CAST(NULL AS VARCHAR) AS tactic_id, 'Exfiltration' AS tactic,
    'Transfer' AS technique, 'T1048' AS technique_id FROM prep WHERE regexp_matches(process_name, 'curl|wget', 'i')
  UNION ALL SELECT event_id, 16, 'shell off host one', 'CRITICAL', '[CUSTOM RULE: shell off host one] Match on process_name='''||sn||'''',
    NULL, NULL, NULL, NULL FROM prep WHERE contains(lower(process_name), 'power') AND lower(hostname)<>'host-1'
  UNION ALL SELECT event_id, 17, 'root or tmp', 'MEDIUM', '[CUSTOM RULE: root or tmp] Match on user='''||coalesce("user",'None')||'''',
    NULL, NULL, NULL, NULL FROM prep WHERE hostname<>'host-3' AND (lower("user")='root' OR regexp_matches(process_path, '^/tmp', 'i'))
  UNION ALL SELECT event_id, 19, 'match all', 'LOW', '[CUSTOM RULE: match all] Match on os=''''',
    NULL, NULL, NULL, NULL FROM prep
  UNION ALL SELECT event_id, 23, 'java by path', 'low', '[CUSTOM RULE: java by path] Match on process_path='''||sp||'''',
    NULL, 'Execution', 'Scripting', NULL FROM prep WHERE ip_address<>'10.0.4.5' AND regexp_matches(process_path, '\\\\temp\\\\', 'i')"""
_RULE_ID = {15: 1, 16: 2, 17: 3, 19: 5, 23: 9}


@query("c01_match_all_rules", with_("prep", more=f"h AS ({O.all_hits()} UNION ALL {_SINGLE})") +
       f"SELECT event_id, {MATCH} FROM h")
def _(spark, d):
    return D.match_all_rules(A.sec_events(spark, d), K.custom_rules(spark)).select(
        "event_id", *D.MATCH_FIELDS)


_FIRST = with_("prep", more=f"""h AS ({O.all_hits()}), f AS (SELECT h.* FROM h JOIN sec USING (event_id)
  WHERE event_type='PROCESS_CREATED' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY pos)=1)""")


@query("c02_first_match_alerts", _FIRST + """SELECT event_id, agent_id, ts_us AS "timestamp", severity, pid, parent_pid,
  parent_process_name, coalesce(process_name,'unknown') AS process_name, process_path, event_type, rule, description,
  tactic_id AS mitre_tactic_id, tactic AS mitre_tactic_name, technique_id AS mitre_technique_id,
  technique AS mitre_technique_name FROM f JOIN sec USING (event_id)""")
def _(spark, d):
    return D.first_match_alerts(A.sec_events(spark, d))


def _worst(spark, d):
    return D.worst_match_alerts(A.sec_events(spark, d), K.custom_rules(spark))


_WORST = with_("prep", more=f"""h AS ({O.all_hits()} UNION ALL {_CUSTOM}),
  g AS (SELECT h.*, count(*) OVER (PARTITION BY event_id) AS rule_count,
    bool_or(rule='transfer tools') OVER (PARTITION BY event_id) AS r1,
    bool_or(rule='root or tmp') OVER (PARTITION BY event_id) AS r3
    FROM h JOIN prep USING (event_id) WHERE event_type='PROCESS_CREATED' AND NOT {O.within('n', sig.ALLOWED_UPDATERS)}),
  w AS (SELECT * EXCLUDE (r1, r3), CASE WHEN r3 THEN 'isolate_host' WHEN r1 THEN 'kill_process' END AS auto_remediation FROM g
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3
      WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, pos)=1)""")


@query("c03_worst_match_alerts", _WORST + """SELECT event_id, agent_id, severity, rule, description, rule_count,
  auto_remediation, coalesce(process_name,'unknown') AS process_name, tactic AS mitre_tactic_name,
  technique_id AS mitre_technique_id, technique AS mitre_technique_name FROM w JOIN sec USING (event_id)""")
def _(spark, d):
    return _worst(spark, d).select(
        "event_id", "agent_id", "severity", "rule", "description", "rule_count", "auto_remediation",
        "process_name", "mitre_tactic_name", "mitre_technique_id", "mitre_technique_name")


@query("c04_eval_condition", with_("sec") + r"""SELECT event_id, coalesce(regexp_matches(process_path, '^c:\\', 'i'), false) AS by_regex,
  coalesce(lower(process_name)='powershell.exe', false) AS by_equals, coalesce(contains(lower("user"),'oo'), false) AS by_contains,
  coalesce(lower(parent_process_name)<>'winword.exe', false) AS by_not_equals, false AS on_missing, false AS on_number, false AS odd_operator FROM sec""")
def _(spark, d):
    e = A.sec_events(spark, d)
    cases = {
        "by_regex": ("process_path", r"^c:\\", "regex"), "by_equals": ("process_name", "PowerShell.exe", "equals"),
        "by_contains": ("user", "OO", "contains"), "by_not_equals": ("parent_process_name", "WINWORD.exe", "not_equals"),
        "on_missing": ("nothing", "x", "not_equals"), "on_number": ("pid", ".", "regex"), "odd_operator": ("user", "root", "like")}
    return e.select("event_id", *[
        CO.eval_condition({"target_field": f, "pattern": p, "operator": o}, e.columns).alias(name)
        for name, (f, p, o) in cases.items()])


#: Texts that dialects read differently, and the numbers of the texts in which each pattern is found, by hand.
_ODD_TEXTS = ["CAFÉ", "café", "٣", "a\u00a0b", "a\r", "a\u2028b", "a{,3}b", "aaab", "curl", "x{a}"]
_ODD_PATTERNS = {"accent": ("é", "0, 1"), "word": (r"^\w+$", "0, 1, 2, 7, 8"), "digit": (r"^\d+$", "2"), "blank": (r"a\sb", "3, 5"),
                 "any": ("a.b", "3, 5, 7"), "text_end": ("a.$", "4, 7, 9"), "up_to": ("a{,3}b", "3, 5, 6, 7"), "brace": ("x{a}", "9"),
                 "open_brace": ("{", "6, 9"), "comment": ("(?#note)curl", "8"), "bad": ("(", "-1")}


@query("c04_dialect", with_("sec") + "SELECT event_id, " + ", ".join(
    f"event_id % 10 IN ({found}) AS {name}" for name, (_, found) in _ODD_PATTERNS.items()) + " FROM sec")
def _(spark, d):
    e = A.sec_events(spark, d).withColumn("message", A.pick(_ODD_TEXTS, F.col("event_id")))
    return e.select("event_id", *[CO.eval_condition(
        {"target_field": "message", "pattern": p, "operator": "regex", "pattern_ok": CO.is_valid_pattern(spark, p)}, e.columns).alias(name)
        for name, (p, _) in _ODD_PATTERNS.items()])


@query("c05_eval_rule", with_("prep", more=f"h AS ({_CUSTOM})") + """SELECT prep.event_id, coalesce(bool_or(rule='shell off host one'),false) AS r2,
  coalesce(bool_or(rule='match all'),false) AS r5, coalesce(bool_or(rule='transfer tools'),false) AS r1, false AS r4, false AS r6, false AS r8
  FROM prep LEFT JOIN h USING (event_id) GROUP BY prep.event_id""")
def _(spark, d):
    e = A.sec_events(spark, d)
    rules = {r["id"]: r for r in CO.load_rules(K.custom_rules(spark))}
    return e.select("event_id", *[CO.eval_rule(rules[n], e.columns).alias(f"r{n}") for n in (1, 2, 4, 5, 6, 8)])


@query("c06_whitelist", with_("sec") + """SELECT event_id, hostname, hostname<>'host-3' AS by_host, ip_address<>'10.0.4.5' AS by_ip, true AS unlisted FROM sec""")
def _(spark, d):
    e = A.sec_events(spark, d)
    rules = {r["id"]: r for r in CO.load_rules(K.custom_rules(spark))}
    return e.select("event_id", "hostname", *[CO.passes_whitelist(rules[n], e.columns).alias(name)
                                              for n, name in ((3, "by_host"), (9, "by_ip"), (1, "unlisted"))])


_LISTED = r"""procs AS (SELECT id, device_id, "timestamp", 0 AS i, n1 AS n, p1 AS p FROM telemetry
  UNION ALL SELECT id, device_id, "timestamp", 1, n2, p2 FROM telemetry),
 t AS (SELECT *, 1 AS rid, 'HIGH' AS severity, n AS v, 'transfer tools' AS name, 'process_name' AS f, 'curl|wget' AS pat FROM procs WHERE n<>'' AND regexp_matches(n,'curl|wget','i')
  UNION ALL SELECT *, 2, 'CRITICAL', n, 'shell off host one', 'process_name', 'x' FROM procs WHERE n<>'' AND regexp_matches(n,'x','i')
  UNION ALL SELECT *, 8, 'CRITICAL', n, 'empty or', 'process_name', '.' FROM procs WHERE n<>''
  UNION ALL SELECT *, 9, 'LOW', p, 'java by path', 'process_path', '\\temp\\' FROM procs WHERE p<>'' AND regexp_matches(p,'\\temp\\','i')),
 hit AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id, rid ORDER BY i)=1)"""


@query("c07_process_list_rule_alerts", with_("telemetry", more=_LISTED) + """SELECT id, device_id, "timestamp", CAST(rid AS BIGINT) AS rule_id, severity,
  coalesce(nullif(n,''),'Unknown') AS process_name, 'Rule '''||name||''' matched: '||f||'='''||v||''' matched pattern /'||pat||'/' AS description,
  CASE rid WHEN 1 THEN 'Exfiltration' WHEN 9 THEN 'Execution' END AS mitre_tactic_id,
  CASE rid WHEN 1 THEN 'T1048' WHEN 9 THEN 'Scripting' END AS mitre_technique_id, 'custom_rule' AS event_type FROM hit""")
def _(spark, d):
    return D.process_list_rule_alerts(
        A.sec_telemetry(spark, d), K.custom_rules(spark), ("id", "device_id", "timestamp")).drop(
        "mitre_tactic_name", "mitre_technique_name")


_HIT_IDS = "CASE pos " + " ".join(f"WHEN {p} THEN {i}" for p, i in _RULE_ID.items()) + " END"


@query("c08_rule_hit_counters", with_("prep", more=f"""h AS ({_CUSTOM}), n AS (SELECT {_HIT_IDS} AS id, count(*) AS hits, max(ts_us) AS last
  FROM h JOIN prep USING (event_id) WHERE event_type='PROCESS_CREATED' AND NOT {O.within('n', sig.ALLOWED_UPDATERS)} GROUP BY 1), ids AS (SELECT unnest(range(1,10)) AS id)""") +
       "SELECT ids.id, ids.id+coalesce(hits,0) AS trigger_count, last AS last_triggered FROM ids LEFT JOIN n USING (id)")
def _(spark, d):
    rules = K.custom_rules(spark)
    hits = D.custom_rule_matches(A.sec_events(spark, d), rules)
    return D.rule_hit_counters(rules, hits).select("id", "trigger_count", "last_triggered")


@query("c09_auto_remediation_plan", _WORST + """SELECT event_id, agent_id, auto_remediation AS action,
  coalesce(nullif(process_name,''), ip_address, 'unknown') AS target, pid, 'planned' AS status FROM w JOIN sec USING (event_id)
  WHERE auto_remediation IS NOT NULL""")
def _(spark, d):
    return D.auto_remediation_plan(_worst(spark, d))


@query("c10_mitre_names", with_("sec") + """SELECT event_id, CASE event_id%3 WHEN 0 THEN 'TA0002' ELSE 'Execution' END AS tactic FROM sec""")
def _(spark, d):
    i = F.col("event_id")
    first = F.when(i % 3 == 0, "TA0002").when(i % 3 == 1, "")
    return A.sec_events(spark, d).select("event_id", D.coalesce_names(first, F.lit("Execution")).alias("tactic"))


def _part_rules(spark, d):
    i = F.col("p_partkey")
    return A.table(spark, d, "part").select(
        i.alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("pattern"),
        A.pick(["LOW", "MEDIUM", "HIGH", "CRITICAL", "high", "SEVERE"], i).alias("severity"),
        F.timestamp_micros(i % 500 * 1_000_000).alias("created_at"))


_PART_RULES = f"""pr AS (SELECT p_partkey AS id, p_name AS name, p_name AS pattern,
  {O.pick(["LOW", "MEDIUM", "HIGH", "CRITICAL", "high", "SEVERE"], 'p_partkey')} AS severity, p_partkey%500*1000000 AS created_at FROM part)"""


@query("c11_create_rules", f"WITH {_PART_RULES} SELECT id, severity, severity IN ('LOW','MEDIUM','HIGH','CRITICAL') AS stored FROM pr")
def _(spark, d):
    new = _part_rules(spark, d)
    stored, rejected = D.create_rule(new.limit(0), new)
    return stored.select("id", "severity", F.lit(True).alias("stored")).union(
        rejected.select("id", "severity", F.lit(False)))


@query("c11_update_and_delete_rules", f"""WITH {_PART_RULES} SELECT id, CASE id WHEN 7 THEN 'LOW' ELSE severity END AS severity,
  CASE id WHEN 7 THEN 'new' ELSE pattern END AS pattern FROM pr WHERE id<>8""")
def _(spark, d):
    changed = D.update_rule(_part_rules(spark, d), 7, {"severity": "LOW", "pattern": "new", "no_such": 1})
    return D.delete_rule(changed, 8).select("id", "severity", "pattern")


@query("c11_list_rules", f"WITH {_PART_RULES} SELECT id, name, created_at FROM pr")
def _(spark, d):
    return D.list_rules(_part_rules(spark, d)).select("id", "name", "created_at")


#: Patterns of the column, and the same for the engine that checks them; a bad one finds nothing.
_DYNAMIC = {"^C:": "^C:", "POWER.*exe": "POWER.*exe", r"\.exe$": r"\.exe$", "[aeiou]{2}": "[aeiou]{2}", "(": r"[^\s\S]", "{": r"\{",
            r"(?#names)^(?P<x>[a-z])\w*\.exe\Z": r"^[a-z]\w*\.exe$"}


@query("c12_pattern_column", with_("sec") + f"""SELECT event_id, coalesce(regexp_matches(process_name,
  '(?i)'||{O.pick(list(_DYNAMIC.values()), 'event_id')}), false) AS matched FROM sec""")
def _(spark, d):
    rows = A.sec_events(spark, d).select("event_id", "process_name", A.pick(list(_DYNAMIC), F.col("event_id")).alias("pattern"))
    return match_pattern_column(rows, "process_name", "pattern").select("event_id", "matched")
