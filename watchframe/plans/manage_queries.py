"""Checked queries: alert management, dashboard, assets, agents, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchframe.functions import net
from watchframe.functions import signatures as sig
from watchframe.functions.text import is_prompt_suspicious, redact, tag_tokens, thread_title
from watchframe.operators import agents as AG
from watchframe.operators import assets as H
from watchframe.operators import dashboard as G
from watchframe.operators import prompts as P
from watchframe.plans import adapters as A
from watchframe.plans import oracle as O
from watchframe.plans.detect_queries import _LINES, _syslog_table
from watchframe.plans.enrich_queries import _threats
from watchframe.plans.oracle import q, with_
from watchframe.plans.registry import query

KINDS = [A.METRICS_AGENT, A.METRICS_AGENT.title()]
_KINDS = "('metrics','Metrics')"
_OPEN = "is_resolved IS NOT true"


@query("g01_list_alerts", with_("alerts") + f"""SELECT id, severity, "timestamp" FROM alerts WHERE severity='HIGH' AND {_OPEN}
  ORDER BY "timestamp" DESC, id DESC LIMIT 200 OFFSET 5""")
def _(spark, d):
    return G.list_alerts(A.sec_alerts(spark, d), "HIGH", skip=5).select("id", "severity", "timestamp")


@query("g01_list_alerts_after", with_("alerts") + f"""SELECT id, severity, "timestamp" FROM alerts WHERE severity='HIGH' AND {_OPEN}
  ORDER BY "timestamp" DESC, id DESC LIMIT 50 OFFSET 100""")
def _(spark, d):
    """The third page, each found from the last row of the one before."""
    alerts, cursor = A.sec_alerts(spark, d), None
    for _page in range(2):
        last = G.list_alerts_after(alerts, cursor, "HIGH", limit=50).select("timestamp", "id").tail(1)
        cursor = tuple(last[0]) if last else cursor
    return G.list_alerts_after(alerts, cursor, "HIGH", limit=50).select("id", "severity", "timestamp")


@query("g22_newest_alerts_of_reporters", with_("alerts") + """SELECT id, agent_id, "timestamp", severity FROM alerts
  WHERE agent_id IN (SELECT agent_id FROM sec WHERE event_type='METRICS_REPORT')
  QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY "timestamp" DESC, id DESC)<=5""")
def _(spark, d):
    reports = A.sec_events(spark, d).where(F.col("event_type") == "METRICS_REPORT")
    return G.newest_alerts_of(A.sec_alerts(spark, d), reports).select("id", "agent_id", "timestamp", "severity")


def _remediations(spark, d):
    i = F.col("event_id")
    return A.sec_events(spark, d).select(
        i.alias("id"), F.when(i % 4 != 0, i - i % 2).otherwise(-1).alias("alert_id"), A.pick(["kill", "block"], i).alias("action"),
        F.col("process_name").alias("target"), F.lit("completed").alias("status"),
        F.col("ts").alias("executed_at"), F.lit("done").alias("details"))


@query("g02_alert_overview", with_("alerts", "telemetry", "agents", more="""t AS (SELECT * FROM telemetry
   QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY "timestamp" DESC, id DESC)=1)""") + """
  SELECT a.id, a.agent_id, g.hostname AS agent_hostname, a.severity, round(t.cpu_usage,6) AS cpu_usage
  FROM alerts a LEFT JOIN agents g USING (agent_id) LEFT JOIN t ON t.device_id=a.agent_id""")
def _(spark, d):
    found = G.alert_overview(A.sec_alerts(spark, d), A.sec_agents(spark, d), A.sec_telemetry(spark, d))
    return found.select("id", "agent_id", "agent_hostname", "severity", "telemetry.cpu_usage")


@query("g02_alert_sections", with_("sec") + """SELECT event_id AS id, 'threat_report' AS section, ts_us AS "at", event_id AS entry_id,
   'summary '||event_id AS what FROM sec WHERE event_id%7<>0
   UNION ALL SELECT event_id-event_id%2, 'remediation', ts_us, event_id, CASE event_id%2 WHEN 0 THEN 'kill' ELSE 'block' END FROM sec WHERE event_id%4<>0""")
def _(spark, d):
    rows = G.alert_sections(A.sec_alerts(spark, d), _threats(spark, d), _remediations(spark, d))
    what = F.coalesce(F.get_json_object("body", "$.summary"), F.get_json_object("body", "$.action"))
    return rows.withColumn("what", what).drop("body")


@query("g03_resolve_all", with_("alerts") + f"SELECT true AS is_resolved, count(*) AS n, (SELECT count(*) FROM alerts WHERE {_OPEN}) AS resolved FROM alerts")
def _(spark, d):
    table, count = G.resolve_all(A.sec_alerts(spark, d))
    sums = table.groupBy("is_resolved").agg(F.count("*").alias("n"))
    rows = sums.unionByName(count, allowMissingColumns=True)
    return rows.agg(F.max("is_resolved").alias("is_resolved"), F.max("n").alias("n"), F.max("resolved").alias("resolved"))


@query("g04_delete_all", with_("alerts") + "SELECT count(*) AS deleted, CAST(0 AS BIGINT) AS kept FROM alerts")
def _(spark, d):
    table, count = G.delete_all(A.sec_alerts(spark, d))
    kept = table.agg(F.count("*").alias("kept"))
    return count.unionByName(kept, allowMissingColumns=True).agg(F.max("deleted").alias("deleted"), F.max("kept").alias("kept"))


def _changes(spark, d):
    """Some alerts are named twice."""
    i, events = F.col("event_id"), A.table(spark, d, "events")
    once = events.select(F.when(i % 5 == 0, i).otherwise(-1 - i).alias("id"), (i % 2 == 0).alias("resolved"))
    return once.unionByName(events.where(i % 10 == 5).select(i.alias("id"), (i % 3 == 0).alias("resolved")))


@query("g05_resolve_alerts", with_("alerts") + "SELECT id, CASE WHEN id%5=0 THEN id%2=0 OR id%3=0 AND id%10=5 ELSE is_resolved END AS is_resolved FROM alerts")
def _(spark, d):
    return G.resolve_alerts(A.sec_alerts(spark, d), _changes(spark, d))[0].select("id", "is_resolved")


@query("g05_kill_commands", with_("alerts") + f"""SELECT agent_id, 'KILL_PROCESS' AS command, pid, process_name, id AS alert_id FROM alerts
  WHERE {_OPEN} AND id%3=2 AND event_type='PROCESS_CREATED' AND pid IS NOT NULL""")
def _(spark, d):
    i = F.col("event_id")
    changes = A.table(spark, d, "events").select(i.alias("id"), (i % 3 == 2).alias("resolved"))
    return G.resolve_alerts(A.sec_alerts(spark, d), changes)[1]


@query("g06_list_agents", with_("agents") + f"""SELECT agent_id, hostname, agent_type, last_seen FROM agents
  WHERE last_seen>={O.NOW}-900000000 AND NOT is_demo ORDER BY last_seen DESC, agent_id DESC LIMIT 100""")
def _(spark, d):
    return G.list_agents(A.sec_agents(spark, d), A.now(), active_only=True).select(
        "agent_id", "hostname", "agent_type", "last_seen")


_RECENT = f"""SELECT t.id, device_id, hostname, agent_type, "timestamp", round(cpu_usage,6) AS cpu_usage FROM telemetry t
  JOIN agents a ON a.agent_id=t.device_id WHERE agent_type IN {_KINDS} ORDER BY "timestamp" DESC, t.id DESC LIMIT 50"""


@query("g07_recent_telemetry", with_("telemetry", "agents") + _RECENT)
def _(spark, d):
    return G.recent_telemetry(A.sec_telemetry(spark, d), A.sec_agents(spark, d), KINDS).select(
        "id", "device_id", "hostname", "agent_type", "timestamp", "cpu_usage")


@query("g08_activity", with_("alerts", "telemetry", "agents", more="""t AS (SELECT 'telemetry' AS type, t.id, "timestamp", device_id AS agent_id, hostname, CAST(NULL AS VARCHAR) AS severity,
   'Telemetry OK: CPU '||round(CAST(coalesce(cpu_usage, 0) AS DECIMAL(30,15)), 1)||'% / RAM '||round(CAST(coalesce(ram_usage, 0) AS DECIMAL(30,15)), 1)||'%' AS summary FROM telemetry t JOIN agents a ON a.agent_id=device_id ORDER BY "timestamp" DESC, t.id DESC LIMIT 30),
  l AS (SELECT 'alert' AS type, l.id, "timestamp", agent_id, hostname, severity, description AS summary FROM alerts l JOIN agents a USING (agent_id) ORDER BY "timestamp" DESC, l.id DESC LIMIT 30)""") +
       """SELECT * FROM (SELECT * FROM t UNION ALL SELECT * FROM l) ORDER BY "timestamp" DESC, type DESC, id DESC LIMIT 30""")
def _(spark, d):
    return G.activity(A.sec_telemetry(spark, d), A.sec_alerts(spark, d), A.sec_agents(spark, d))


_COUNTS = f"""s AS (SELECT * FROM (SELECT count(*) AS total_alerts, count(*) FILTER (WHERE {_OPEN}) AS unresolved_alerts,
  count(*) FILTER (WHERE {_OPEN} AND upper(severity)='CRITICAL') AS current_critical_alerts,
  count(*) FILTER (WHERE {_OPEN} AND upper(severity)='HIGH') AS current_high_alerts,
  count(*) FILTER (WHERE {_OPEN} AND upper(severity)='MEDIUM') AS current_medium_alerts,
  count(*) FILTER (WHERE {_OPEN} AND upper(severity)='LOW') AS current_low_alerts FROM alerts),
  (SELECT count(*) FILTER (WHERE last_seen>={O.NOW}-900000000) AS active_agents,
  count(*) FILTER (WHERE last_seen>={O.NOW}-900000000 AND is_demo) AS demo_agents FROM agents))"""


@query("g09_stats", with_("alerts", "agents", more=_COUNTS) + "SELECT * FROM s")
def _(spark, d):
    return G.stats(A.sec_alerts(spark, d), A.sec_agents(spark, d), A.now(), include_demo=True)


@query("g10_history", with_("telemetry") + """SELECT id, device_id, "timestamp" FROM telemetry WHERE device_id='agent-1' ORDER BY "timestamp" DESC, id DESC LIMIT 50""")
def _(spark, d):
    return G.history(A.sec_telemetry(spark, d), "agent-1").select("id", "device_id", "timestamp")


@query("g11_list_remediations", with_("sec") + "SELECT event_id AS id, ts_us AS executed_at FROM sec ORDER BY ts_us DESC, id DESC LIMIT 20")
def _(spark, d):
    return G.list_remediations(_remediations(spark, d)).select("id", "executed_at")


@query("g12_list_threat_reports", with_("sec") + "SELECT event_id AS id, 'summary '||event_id AS summary FROM sec ORDER BY ts_us DESC, event_id DESC LIMIT 50")
def _(spark, d):
    return G.list_threat_reports(_threats(spark, d)).select("id", "summary")


@query("g13_threat_level", with_("alerts", more=f"""h AS (SELECT agent_id, count(*) FILTER (WHERE upper(severity)='CRITICAL' AND id%40=3) AS c,
   count(*) FILTER (WHERE upper(severity)='HIGH' AND id%40=2) AS h, count(*) FILTER (WHERE upper(severity)='MEDIUM' AND id%8=1) AS m, count(*) FILTER (WHERE {_OPEN} AND id%3=2) AS u FROM alerts GROUP BY agent_id)""") +
       """SELECT agent_id, CASE WHEN c>0 THEN 'CRITICAL' WHEN h>2 OR u>20 THEN 'WARNING' WHEN h>0 OR m>5 OR u>5 THEN 'ELEVATED'
   WHEN u>0 THEN 'LOW' ELSE 'NORMAL' END AS level FROM h""")
def _(spark, d):
    i, level = F.col("id"), F.upper("severity")
    per_agent = A.sec_alerts(spark, d).groupBy("agent_id").agg(
        F.count_if((level == "CRITICAL") & (i % 40 == 3)).alias("current_critical_alerts"),
        F.count_if((level == "HIGH") & (i % 40 == 2)).alias("current_high_alerts"),
        F.count_if((level == "MEDIUM") & (i % 8 == 1)).alias("current_medium_alerts"),
        F.count_if(G.unresolved() & (i % 3 == 2)).alias("unresolved_alerts"))
    return G.threat_level(per_agent).select("agent_id", "level")


@query("g14_chart_series", with_("telemetry", "agents") + """SELECT t."timestamp"//1000 AS "time", round(cpu_usage,6) AS cpu, round(ram_usage,6) AS ram, hostname AS name
  FROM telemetry t JOIN agents a ON a.agent_id=t.device_id WHERE lower(agent_type)='metrics'""")
def _(spark, d):
    both = A.sec_telemetry(spark, d).join(
        A.sec_agents(spark, d).select(F.col("agent_id").alias("device_id"), "hostname", "agent_type"), "device_id")
    return G.chart_series(both, "metrics")


@query("g15_search_agents", with_("agents") + """SELECT agent_id, CASE agent_type WHEN 'metrics' THEN 'metrics' WHEN 'endpoint' THEN 'endpoint' ELSE 'other' END AS agent_group
  FROM agents WHERE contains(lower(hostname),'t-1') OR contains(ip_address,'t-1') OR contains(lower(agent_id),'t-1')""")
def _(spark, d):
    return G.search_agents(A.sec_agents(spark, d), "T-1", A.METRICS_AGENT, A.ENDPOINT_AGENT).select("agent_id", "agent_group")


@query("g16_last_seen_bucket", f"""WITH e AS (SELECT event_id, CASE WHEN event_id%9<>0 THEN epoch_us(ts) END AS t FROM events),
  s AS (SELECT *, CAST(floor((1706745600000000-t)/1000000) AS BIGINT) AS sec FROM e)
  SELECT event_id, CASE WHEN t IS NULL THEN 'Never' WHEN sec<60 THEN 'Just now' WHEN sec<3600 THEN (sec//60)||'m ago'
  WHEN sec<86400 THEN (sec//3600)||'h ago' ELSE strftime(make_timestamp(t), '%Y-%m-%d') END AS seen FROM s""")
def _(spark, d):
    ts = F.timestamp_micros(F.lit(A.EPOCH_US) + F.timestamp_diff(
        "MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")))
    seen = F.when(F.col("event_id") % 9 != 0, ts)
    return A.table(spark, d, "events").select(
        "event_id", G.last_seen_bucket(seen, F.timestamp_micros(F.lit(1_706_745_600_000_000))).alias("seen"))


_SYSTABLE = _LINES + """, sys AS (SELECT event_id AS id, ts_us AS "timestamp", event_id%192%8 AS severity, host AS hostname, text AS message FROM lines)"""


def _syslog(spark, d):
    table = _syslog_table(spark, d)
    return table.withColumn("id", F.regexp_extract("message", r"113\.(\d+)$", 1).cast("bigint"))


@query("g17_query_syslog", with_("sec", more=_SYSTABLE) + """SELECT "timestamp", severity, hostname FROM sys WHERE hostname ILIKE '%OST-1%' AND severity=3
  ORDER BY "timestamp" DESC LIMIT 200""")
def _(spark, d):
    return G.query_syslog(_syslog(spark, d), "OST-1", 3).select("timestamp", "severity", "hostname")


@query("g18_syslog_label", with_("sec", more=_SYSTABLE) + f"""SELECT "timestamp", severity, {O.lst(sig.SYSLOG_LABELS)}[severity+1] AS label FROM sys""")
def _(spark, d):
    return _syslog_table(spark, d).select("timestamp", "severity", G.syslog_label(F.col("severity")).alias("label"))


def _audit(spark, d):
    i = F.col("id")
    made = G.audit_rows(A.sec_alerts(spark, d).withColumn("n", i), "resolve_alert", "alert",
                        F.struct(F.col("severity"), F.col("n")), F.timestamp_micros(i * 1000), i,
                        username="Ann", user_id=1)
    return made.withColumns({"id": F.coalesce(F.col("resource_id").cast("bigint"), F.lit(0)),
                             "action": F.when(F.unix_millis("created_at") % 3 == 0, "login").otherwise(F.col("action"))})


@query("g19_audit_rows", with_("alerts") + """SELECT 'resolve_alert' AS action, 'alert' AS resource, nullif(CAST(id AS VARCHAR),'0') AS resource_id,
  '{"severity":"'||severity||'"}' AS details, 'Ann' AS username, CAST(1 AS BIGINT) AS user_id, CAST(NULL AS VARCHAR) AS ip_address,
  CAST(1704067524000000 AS BIGINT) AS created_at FROM alerts""")
def _(spark, d):
    return G.audit_rows(A.sec_alerts(spark, d), "resolve_alert", "alert", F.struct("severity"), A.now(),
                        F.col("id"), username="Ann", user_id=1)


@query("g20_query_audit", with_("alerts") + """SELECT id, 'login' AS action FROM alerts WHERE id%3=0 ORDER BY id DESC LIMIT 100 OFFSET 2""")
def _(spark, d):
    return G.query_audit(_audit(spark, d), "login", "LER", "ann", skip=2).select("id", "action")


@query("g21_merge_live", with_("alerts") + """SELECT agent_id, count(*) AS total, CASE WHEN count(*) FILTER (WHERE id%2=0)>0 AND min(id)%3=0
   THEN max(id) ELSE min(id) END AS mark FROM alerts GROUP BY agent_id""")
def _(spark, d):
    per = A.sec_alerts(spark, d).groupBy("agent_id").agg(
        F.count("*").alias("total"), F.min("id").alias("mark"), F.max("id").alias("top"))
    live = per.where(F.col("mark") % 3 == 0).select("agent_id", F.col("top").alias("mark"))
    return G.merge_live(per.select("agent_id", "total", "mark"), live, "agent_id")


# ---------------------------------------------------------------- assets

_PORTSETS = [[], [22], [80, 443], [8080, 3389], [8000], [9], [135, 22], [70000, 0, 443]]


def _ports(i):
    sets = F.array(*[F.array(*[F.lit(p) for p in s]).cast("array<int>") for s in _PORTSETS])
    return F.element_at(sets, (i % len(_PORTSETS) + 1).cast("int"))


_PORTS = "[" + ", ".join("[" + ",".join(map(str, s)) + "]::INTEGER[]" for s in _PORTSETS) + f"][{{}}%{len(_PORTSETS)}+1]"
_OS = """CASE WHEN list_has_any({0}, [3389,445,135]) THEN 'windows' WHEN list_contains({0}, 22) THEN 'linux'
  WHEN list_has_any({0}, [80,443,8080]) THEN 'network-service' WHEN list_contains({0}, 8000) THEN 'agent' ELSE 'unknown' END"""


@query("h01_guess_os", f"SELECT event_id, {_OS.format(_PORTS.format('event_id'))} AS os FROM events")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", H.guess_os(_ports(F.col("event_id"))).alias("os"))


@query("h02_mac_vendor", """SELECT event_id, CASE WHEN event_id%6=0 THEN NULL WHEN event_id%100<50 THEN 'Vendor '||(event_id%100) ELSE 'Unknown' END AS vendor FROM events""")
def _(spark, d):
    i = F.col("event_id")
    mac = F.concat(F.lit("0a-00-"), F.lpad(F.hex(i % 100), 2, "0"), F.lit("-01-02-03"))
    hosts = A.table(spark, d, "events").select("event_id", F.when(i % 6 != 0, mac).alias("mac_address"))
    oui = A.table(spark, d, "part").select(
        F.concat(F.when(F.col("p_partkey") < 50, "0A00").otherwise("FF"),
                 F.lpad(F.hex("p_partkey"), 2, "0")).alias("prefix"),
        F.concat(F.lit("Vendor "), "p_partkey").alias("vendor"))
    return H.mac_vendor(hosts, oui).select("event_id", "vendor")


def _known_hosts(spark, d):
    k = F.col("c_custkey")
    t0 = F.timestamp_micros(k * 1_000_000)
    return A.table(spark, d, "customer").select(
        F.concat(F.lit("10.1."), k % 250, F.lit("."), F.floor(k / 250)).alias("ip_address"),
        F.col("c_name").alias("hostname"), F.lit(None).cast("string").alias("mac_address"),
        F.lit(None).cast("string").alias("vendor"), F.lit("linux").alias("os_guess"),
        F.lit(55).alias("os_confidence"), F.lit("reachable").alias("status"),
        F.array(F.lit(22)).alias("open_ports"), F.lit("seed").alias("source"),
        A.pick(["active", "not_deployed", "deployed"], k).alias("endpoint_status"),
        F.lit("deployed").alias("metrics_status"), t0.alias("first_seen"), t0.alias("last_seen"))


_KNOWN = """known AS (SELECT '10.1.'||(c_custkey%250)||'.'||(c_custkey//250) AS ip_address, c_name AS hostname, c_custkey AS k FROM customer)"""


def _scan(spark, d):
    i = F.col("event_id")
    return A.table(spark, d, "events").select(
        F.concat(F.lit("10.1."), i % 77, F.lit("."), i % 2).alias("ip_address"), _ports(i).alias("open_ports"),
        F.when(i % 3 == 0, F.concat(F.lit("scan-"), i)).alias("hostname"),
        F.when(i % 4 == 0, F.concat(F.lit("AA:00:00:00:00:"), i % 90 + 10)).alias("mac_address"),
        F.when(i % 4 == 0, F.concat(F.lit("V"), i % 90)).alias("vendor"),
        F.lit("scan").alias("source"), F.timestamp_micros(i).alias("ts"))


_SCAN = f"""rows AS (SELECT '10.1.'||(event_id%77)||'.'||(event_id%2) AS ip_address, event_id AS i, {_PORTS.format('event_id')} AS ports FROM events),
 scan AS (SELECT ip_address, max(i) AS i, max(i) FILTER (i%3=0) AS named, max(i) FILTER (i%4=0) AS carded, arg_max(ports, i) AS ports,
  arg_max(ports, i) FILTER (len(ports)>0) AS open_ports, len(arg_min(ports, i))>0 AS first_open FROM rows GROUP BY 1),
 up AS (SELECT coalesce(k.ip_address, s.ip_address) AS ip_address, coalesce('scan-'||named, hostname) AS hostname,
  'AA:00:00:00:00:'||(carded%90+10) AS mac_address, 'V'||(carded%90) AS vendor,
  CASE WHEN i IS NULL THEN 'linux' WHEN s.open_ports IS NOT NULL THEN {_OS.format('s.open_ports')} WHEN k IS NULL THEN 'unknown' ELSE 'linux' END AS os_guess,
  CASE WHEN k IS NOT NULL THEN 55 WHEN first_open THEN 90 ELSE 10 END::BIGINT AS os_confidence,
  CASE WHEN i IS NULL OR len(ports)>0 THEN 'reachable' ELSE 'unknown' END AS status,
  array_to_string(CASE WHEN i IS NULL THEN [22] ELSE ports END, '|') AS open_ports, CASE WHEN i IS NULL THEN 'seed' ELSE 'scan' END AS source,
  coalesce(['active','not_deployed','deployed'][k%3+1], 'not_deployed') AS endpoint_status,
  CASE WHEN k IS NULL THEN 'not_deployed' ELSE 'deployed' END AS metrics_status,
  coalesce(k*1000000, {O.NOW}) AS first_seen, CASE WHEN i IS NULL THEN k*1000000 ELSE {O.NOW} END AS last_seen
  FROM known k FULL JOIN scan s ON s.ip_address=k.ip_address)"""


@query("h03_upsert_hosts", f"WITH {_KNOWN}, {_SCAN} SELECT * FROM up")
def _(spark, d):
    return H.upsert_hosts(_known_hosts(spark, d), _scan(spark, d), A.now())


def _host_agents(spark, d):
    i = F.col("event_id")
    return A.sec_events(spark, d).select(
        F.concat(F.lit("10.1."), i % 50, F.lit(".0")).alias("ip_address"),
        A.pick(["endpoint", "metrics", "Metrics", "other"], F.floor(i / 50)).alias("agent_type"),
        F.when(i % 2 == 0, F.timestamp_micros(F.unix_micros("ts") - 400_000_000)).alias("last_seen"))


_SYNC = f"""ag AS (SELECT '10.1.'||(event_id%50)||'.0' AS ip_address, {O.pick(["endpoint", "metrics", "Metrics", "other"], 'event_id//50')} AS t,
   CASE WHEN event_id%2=0 THEN ts_us-400000000 END AS seen FROM sec),
  pi AS (SELECT ip_address, max(CASE WHEN t='endpoint' THEN coalesce(seen,-1) END) AS e, max(CASE WHEN lower(t)='metrics' THEN coalesce(seen,-1) END) AS m FROM ag GROUP BY 1)"""
_STATUS = "CASE WHEN {0}>" + str(O.NOW - 600_000_000) + " THEN 'active' WHEN {0}>=0 THEN 'deployed' WHEN {0}=-1 THEN 'not_deployed' ELSE {1} END"


@query("h04_sync_agent_status", with_("sec", more=f"{_KNOWN}, {_SYNC}") + f"""SELECT ip_address, {_STATUS.format('e', "['active','not_deployed','deployed'][k%3+1]")} AS endpoint_status,
  {_STATUS.format('m', "'deployed'")} AS metrics_status FROM known LEFT JOIN pi USING (ip_address)""")
def _(spark, d):
    return H.sync_agent_status(_known_hosts(spark, d), _host_agents(spark, d), A.now(), ["endpoint"], KINDS
                               ).select("ip_address", "endpoint_status", "metrics_status")


@query("h05_host_summary_status", f"""WITH s AS (SELECT event_id, {O.pick(["active", "deployed", "not_deployed"], 'event_id')} AS g,
  {O.pick(["active", "deployed", "not_deployed"], 'event_id//3')} AS m FROM events)
  SELECT event_id, CASE WHEN g='active' AND m='active' THEN 'active (Endpoint + Metrics)' WHEN g='active' THEN 'active (Endpoint)' WHEN m='active' THEN 'active (Metrics)'
  WHEN g='deployed' OR m='deployed' THEN 'deployed' ELSE 'not_deployed' END AS status FROM s""")
def _(spark, d):
    i = F.col("event_id")
    states = ["active", "deployed", "not_deployed"]
    return A.table(spark, d, "events").select(
        "event_id", H.host_summary_status(A.pick(states, i), A.pick(states, F.floor(i / 3))).alias("status"))


@query("h06_list_hosts", f"WITH {_KNOWN} SELECT ip_address, k*1000000 AS last_seen FROM known ORDER BY last_seen DESC, ip_address LIMIT 250")
def _(spark, d):
    return H.list_hosts(_known_hosts(spark, d)).select("ip_address", "last_seen")


def _turned(mac):
    """The groups of a MAC in reverse order."""
    return F.array_join(F.reverse(F.split(mac, ":")), ":")


def _makers(spark, d):
    n = F.col("event_id")
    return A.table(spark, d, "events").where(n.between(10, 49)).select(
        F.concat(n, F.lit("0000")).alias("prefix"), F.concat(F.lit("Maker "), n).alias("vendor"))


@query("h07_ingest_scan", f"""WITH {_KNOWN}, {_SCAN}, ros AS (SELECT ip_address, arg_max('os'||i, i) AS os FROM (SELECT '10.1.'||(event_id%77)||'.'||(event_id%2) AS ip_address, event_id AS i FROM events WHERE event_id%5=0) GROUP BY 1)
  SELECT up.ip_address, hostname, coalesce(ros.os, os_guess) AS os_guess, CASE WHEN ros.os IS NOT NULL THEN 80 ELSE os_confidence END AS os_confidence,
  open_ports, CASE WHEN source='scan' THEN 'agent-scan:a' ELSE source END AS source, mac_address, CASE WHEN mac_address IS NULL THEN NULL
  WHEN carded%90+10<50 THEN 'Maker '||(carded%90+10) ELSE 'Unknown' END AS vendor FROM up LEFT JOIN (SELECT ip_address, carded FROM scan) USING (ip_address) LEFT JOIN ros USING (ip_address)""")
def _(spark, d):
    i = F.col("event_id")
    item = F.struct(F.concat(F.lit("10.1."), i % 77, F.lit("."), i % 2).alias("ip_address"),
                    F.when(i % 3 == 0, F.concat(F.lit("scan-"), i)).alias("hostname"),
                    F.when(i % 4 == 0, F.concat(F.lit("AA:00:00:00:00:"), i % 90 + 10)).alias("mac_address"),
                    _ports(i).alias("open_ports"), F.when(i % 5 == 0, F.concat(F.lit("os"), i)).alias("os_guess"))
    results = A.table(spark, d, "events").select(
        F.lit("a").alias("agent_id"), F.timestamp_micros(i).alias("ts"), F.array(item).alias("scan_hosts"))
    # the prefix table of the query has the last digits where prefixes have the first
    turned = results.withColumn("scan_hosts", F.transform("scan_hosts", lambda h: h.withField("mac_address", _turned(h["mac_address"]))))
    found = H.ingest_scan(_known_hosts(spark, d), turned, A.now(), _makers(spark, d))
    return found.withColumn("mac_address", _turned(F.col("mac_address"))).select(
        "ip_address", "hostname", "os_guess", "os_confidence", "open_ports", "source", "mac_address", "vendor")


def _h8(spark, d):
    i = F.col("event_id")
    e = A.table(spark, d, "events")
    ip = lambda prefix, n: e.select(F.concat(F.lit(prefix), i % n).alias("ip_address"))
    return ip("10.1.0.", 9), ip("10.1.0.", 40).union(ip("10.2.0.", 40)), ip("10.1.0.", 14)


@query("h08_live_hosts", """SELECT DISTINCT '10.1.0.'||(event_id%9) AS ip_address FROM events UNION SELECT '10.1.0.'||(event_id%14) FROM events
  UNION SELECT '10.1.0.'||(event_id%40) FROM events WHERE event_id%40<16""")
def _(spark, d):
    arp, known, up = _h8(spark, d)
    return H.live_hosts(arp, known, up, "10.1.0.0/28")


@query("h08_unreachable_hosts", "SELECT DISTINCT '10.1.0.'||(event_id%60) AS ip_address FROM events WHERE event_id%60>=16")
def _(spark, d):
    arp, known, up = _h8(spark, d)
    subnet = A.table(spark, d, "events").select(
        F.concat(F.lit("10.1.0."), F.col("event_id") % 60).alias("ip_address")).distinct()
    return H.unreachable_hosts(subnet, H.live_hosts(arp, known, up, "10.1.0.0/28"))


@query("h09_ip_in_cidr", """WITH e AS (SELECT event_id, '10.'||(event_id%3)||'.'||(event_id%5)||'.'||(event_id%300) AS ip, event_id%300<256 AS ok,
   (event_id%3)*65536+(event_id%5)*256+event_id%300 AS n, CASE event_id%4 WHEN 0 THEN '10.1.2.77/24' WHEN 1 THEN '10.0.0.0/8' WHEN 2 THEN '10.1.0.0/30' ELSE '8.8.8.0/24' END AS cidr FROM events)
  SELECT event_id, ip, cidr, CASE event_id%4 WHEN 0 THEN ok AND n//256=258 WHEN 1 THEN ok WHEN 2 THEN ok AND n//4=16384 ELSE false END AS inside,
  event_id%4 IN (0, 2) AS scannable FROM e
  UNION ALL SELECT event_id, '', ['198.18.0.0/24','203.0.113.0/24','240.0.0.0/24','192.0.2.0/25','::1/128','fd00::/120','2001:4860::/120','fd00::/119','100.64.0.0/24','::ffff:10.0.0.1/124','64:ff9b:1::/120','2002::/120','192.0.0.0/25','192.0.0.9/32','2001:1::1/128','::1/120'][event_id%16+1],
   false, event_id%16 IN (0,1,2,3,4,5,9,10,11,12) FROM events""")
def _(spark, d):
    i = F.col("event_id")
    ip = F.concat_ws(".", F.lit("10"), i % 3, i % 5, i % 300)
    cidr = A.pick(["10.1.2.77/24", "10.0.0.0/8", "10.1.0.0/30", "8.8.8.0/24"], i)
    more = A.pick(["198.18.0.0/24", "203.0.113.0/24", "240.0.0.0/24", "192.0.2.0/25", "::1/128", "fd00::/120", "2001:4860::/120",
                   "fd00::/119", "100.64.0.0/24", "::ffff:10.0.0.1/124", "64:ff9b:1::/120", "2002::/120", "192.0.0.0/25", "192.0.0.9/32",
                   "2001:1::1/128", "::1/120"], i)
    events = A.table(spark, d, "events")
    rows = events.select("event_id", ip.alias("ip"), cidr.alias("cidr")).unionByName(
        events.select("event_id", F.lit("").alias("ip"), more.alias("cidr")))
    return rows.withColumns({
        "inside": net.ip_in_cidr(F.col("ip"), F.col("cidr")), "scannable": net.is_scannable_network(F.col("cidr"))})


@query("h10_manual_hosts", f"""WITH {_KNOWN}, m AS (SELECT '10.1.'||(p_partkey%90)||'.1' AS ip_address, arg_max('manual-'||p_partkey, p_partkey) AS name,
    max(p_partkey) FILTER (p_partkey%3=0) AS carded FROM part WHERE p_partkey%10<>7 GROUP BY 1)
  SELECT coalesce(k.ip_address, m.ip_address) AS ip_address, coalesce(m.name, k.hostname) AS hostname, CASE WHEN k.k IS NOT NULL THEN 55 ELSE 10 END::BIGINT AS os_confidence,
  CASE WHEN m.name IS NULL THEN 'reachable' ELSE 'unknown' END AS status,
  CASE WHEN carded%90+10<50 THEN 'Maker '||(carded%90+10) WHEN carded IS NOT NULL THEN 'Unknown' END AS vendor FROM known k FULL JOIN m ON m.ip_address=k.ip_address""")
def _(spark, d):
    k = F.col("p_partkey")
    typed = A.table(spark, d, "part").select(
        F.when(k % 10 != 7, F.concat(F.lit("10.1."), k % 90, F.lit(".1"))).otherwise(F.concat(F.lit("10.1.300."), k)).alias("ip_address"),
        F.concat(F.lit("manual-"), k).alias("hostname"),
        F.when(k % 3 == 0, F.concat(k % 90 + 10, F.lit(":00:00:00:00:AA"))).alias("mac_address"),
        F.lit("manual").alias("source"), F.timestamp_micros(k).alias("ts"))
    return H.add_manual_hosts(_known_hosts(spark, d), typed, A.now(), _makers(spark, d))[0].select(
        "ip_address", "hostname", "os_confidence", "status", "vendor")


@query("h11_append_new_hosts", f"""WITH {_KNOWN} SELECT ip_address, 'old' AS kind FROM known UNION ALL
  SELECT '10.1.'||p_partkey||'.0', 'new' FROM part WHERE '10.1.'||p_partkey||'.0' NOT IN (SELECT ip_address FROM known)""")
def _(spark, d):
    current = _known_hosts(spark, d).select("ip_address", F.lit("old").alias("kind"))
    found = A.table(spark, d, "part").select(
        F.concat(F.lit("10.1."), "p_partkey", F.lit(".0")).alias("ip_address"), F.lit("new").alias("kind"))
    return H.append_new_hosts(current, found)


@query("h12_clean_ports", """SELECT event_id, array_to_string(list_slice(list_filter(range(event_id%40-3, event_id%40+37), lambda p: p>=1 AND p<=65535), 1, 32), '|') AS ports FROM events""")
def _(spark, d):
    first = F.col("event_id") % 40 - 3
    return A.table(spark, d, "events").select("event_id", H.clean_ports(F.sequence(first, first + 39)).alias("ports"))


# ---------------------------------------------------------------- agents

def _registry(spark, d):
    """Known agents: every second one reports events, the others are silent."""
    n = F.regexp_extract("agent_id", r"(\d+)$", 1).cast("bigint")
    silent = n % 2 == 1
    return A.sec_agents(spark, d).select(
        F.when(silent, F.concat(F.lit("silent-"), n)).otherwise(F.col("agent_id")).alias("agent_id"),
        F.concat(F.when(silent, "mute-").otherwise("old-"), n).alias("hostname"), F.lit("1.1.1.1").alias("ip_address"),
        F.lit("linux").alias("os_type"), F.lit("endpoint").alias("agent_type"),
        F.timestamp_micros(F.lit(5)).alias("last_seen"))


def _host_reports(spark, d):
    n = F.regexp_extract("agent_id", r"(\d+)$", 1).cast("bigint")
    return A.sec_events(spark, d).select(
        "agent_id", "ts", "event_id", F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("pc-"), n)).alias("hostname"),
        "ip_address", F.lit("linux").alias("os_type"))


_AG = "ag AS (SELECT agent_id, user_id AS n, ip_address, max(ts_us) AS seen FROM sec GROUP BY 1,2,3)"


@query("i01_upsert_agents", with_("sec", more=_AG) + """SELECT agent_id, CASE WHEN n%3<>0 THEN 'pc-'||n WHEN n%2=0 THEN 'old-'||n END AS hostname, ip_address, 'linux' AS os_type,
  CASE WHEN n%2=0 THEN 'endpoint' ELSE 'metrics' END AS agent_type, seen AS last_seen FROM ag
  UNION ALL SELECT 'silent-'||n, 'mute-'||n, '1.1.1.1', 'linux', 'endpoint', CAST(5 AS BIGINT) FROM ag WHERE n%2=1""""")
def _(spark, d):
    return AG.upsert_agents(_registry(spark, d), _host_reports(spark, d))


@query("i01_upsert_agents_conflict", with_("sec", more=_AG) + """SELECT agent_id, 'old-'||n AS hostname, ip_address, 'linux' AS os_type, 'endpoint' AS agent_type, seen AS last_seen FROM ag WHERE n%2=0
  UNION ALL SELECT agent_id, 'same', ip_address, 'linux', 'metrics', seen FROM ag WHERE n%2=1 AND agent_id=(SELECT min(agent_id) FROM ag WHERE n%2=1)
  UNION ALL SELECT 'silent-'||n, 'mute-'||n, '1.1.1.1', 'linux', 'endpoint', CAST(5 AS BIGINT) FROM ag WHERE n%2=1""""")
def _(spark, d):
    return AG.upsert_agents(_registry(spark, d), _host_reports(spark, d).withColumn("hostname", F.lit("same")).withColumn(
        "hostname", F.when(F.regexp_extract("agent_id", r"(\d+)$", 1).cast("bigint") % 2 == 1, "same")))


@query("i02_touch_agents", with_("sec", more=_AG) + """SELECT agent_id, CASE WHEN n%3<>0 THEN 'pc-'||n ELSE 'old-'||n END AS hostname, ip_address, 'linux' AS os_type, 'endpoint' AS agent_type,
  seen AS last_seen FROM ag WHERE n%2=0
  UNION ALL SELECT 'silent-'||n, 'mute-'||n, '1.1.1.1', 'linux', 'endpoint', CAST(5 AS BIGINT) FROM ag WHERE n%2=1""""")
def _(spark, d):
    return AG.touch_agents(_registry(spark, d), _host_reports(spark, d))


@query("i03_register", with_("sec", more=_AG) + """SELECT 'old-'||n AS hostname, 'linux' AS os_type, CASE WHEN n%2=0 THEN agent_id ELSE 'new-'||n END AS agent_id,
  CASE WHEN n%2=0 THEN 're-enrolled' ELSE 'registered' END AS status FROM ag
  UNION ALL SELECT 'fresh-'||(n%9), 'linux', min('twice-'||n) OVER (PARTITION BY n%9),
  CASE WHEN 'twice-'||n=min('twice-'||n) OVER (PARTITION BY n%9) THEN 'registered' ELSE 're-enrolled' END FROM ag""")
def _(spark, d):
    n = F.regexp_extract("agent_id", r"(\d+)$", 1)
    agents, linux = A.sec_agents(spark, d), F.lit("linux").alias("os_type")
    requests = agents.select(F.concat(F.lit("old-"), n).alias("hostname"), linux, F.concat(F.lit("new-"), n).alias("agent_id"))
    again = agents.select(F.concat(F.lit("fresh-"), n.cast("bigint") % 9).alias("hostname"), linux, F.concat(F.lit("twice-"), n).alias("agent_id"))
    return AG.register(_registry(spark, d), requests.unionByName(again))


@query("i04_resolve_parent_names", with_("sec", more="""s AS (SELECT event_id, hostname AS host, event_id//60 AS ts, event_id AS pid, event_id-event_id%4 AS parent_pid, process_name FROM sec)""") +
       """SELECT s.event_id, coalesce(p.process_name,'unknown') AS parent_process_name FROM s LEFT JOIN s p ON p.host=s.host AND p.ts=s.ts AND p.pid=s.parent_pid""")
def _(spark, d):
    i = F.col("event_id")
    snaps = A.sec_events(spark, d).select(
        "event_id", F.col("hostname").alias("host"), F.timestamp_micros(F.floor(i / 60)).alias("ts"), i.alias("pid"),
        (i - i % 4).alias("parent_pid"), "process_name")
    return AG.resolve_parent_names(snaps).select("event_id", "parent_process_name")


@query("i05_top_processes", with_("telemetry") + """SELECT id, CASE WHEN cpu_usage>=ram_usage THEN coalesce(n1,'unknown')||','||coalesce(n2,'unknown')
  ELSE coalesce(n2,'unknown')||','||coalesce(n1,'unknown') END AS names, CASE WHEN cpu_usage>=ram_usage THEN coalesce(n1,'unknown') ELSE coalesce(n2,'unknown') END AS first FROM telemetry""")
def _(spark, d):
    top = lambda n: F.transform(AG.top_processes(F.col("processes"), n), lambda p: p["name"])
    return A.sec_telemetry(spark, d).select("id", F.array_join(top(10), ",").alias("names"), F.array_join(top(1), ",").alias("first"))


@query("i06_established_flows", """SELECT event_id, CAST(least(50, len(list_filter(range(event_id%90), lambda k: k%3<>0 AND k%5<>0))) AS BIGINT) AS kept,
  coalesce('r'||list_filter(range(event_id%90), lambda k: k%3<>0 AND k%5<>0)[1], '') AS first FROM events""")
def _(spark, d):
    size = F.col("event_id") % 90
    flows = F.when(size > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), size - 1), lambda k: F.struct(
        F.when(k % 3 == 0, "LISTEN").otherwise("ESTABLISHED").alias("status"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("r"), k)).alias("raddr"))))
    kept = AG.established_flows(flows)
    return A.table(spark, d, "events").select(
        "event_id", F.greatest(F.size(kept), F.lit(0)).alias("kept"),
        F.coalesce(F.get(kept, F.lit(0))["raddr"], F.lit("")).alias("first"))


@query("i07_derived_metrics", """SELECT event_id, round((16000.0::DOUBLE-event_id%9000)/16000*100, 6) AS ram_usage, event_id*300000//1048576 AS disk_free, event_id*700000//1048576 AS disk_total FROM events""")
def _(spark, d):
    i = F.col("event_id")
    raw = A.table(spark, d, "events").select(
        "event_id", F.lit(16000.0).alias("ram_total"), (i % 9000).alias("ram_available"),
        (i * 300_000).alias("disk_free_bytes"), (i * 700_000).alias("disk_total_bytes"))
    return AG.derived_metrics(raw).select("event_id", "ram_usage", "disk_free", "disk_total")


# ---------------------------------------------------------------- prompts

_BAD = f"((contains(lower(text),'ignore') AND contains(lower(text),'instructions')) OR {O.finds_any('text', sig.PROMPT_PATTERNS, 'i')})"


@query("j01_prompt_suspicious", with_("prompts") + f"SELECT conv_id, turn, {_BAD} AS suspicious FROM prompts")
def _(spark, d):
    return A.sec_prompts(spark, d).select("conv_id", "turn", is_prompt_suspicious(F.col("text")).alias("suspicious"))


def _redacted(column: str) -> str:
    for pattern, mark in sig.REDACTIONS:
        column = f"regexp_replace({column}, {q(pattern)}, {q(mark)}, 'g')"
    return column


@query("j02_redact", f"SELECT doc_id, md5({_redacted('text')}) AS digest FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.md5(redact(F.col("text"))).alias("digest"))


@query("j03_prompt_gate", with_("prompts") + f"SELECT conv_id, turn, CASE WHEN {_BAD} THEN 'rejected' ELSE md5({_redacted('text')}) END AS result FROM prompts")
def _(spark, d):
    passed, rejected = P.prompt_gate(A.sec_prompts(spark, d))
    return passed.select("conv_id", "turn", F.md5("text").alias("result")).union(
        rejected.select("conv_id", "turn", F.lit("rejected")))


@query("j04_thread_title", with_("prompts") + r"""SELECT conv_id, turn, CASE WHEN conv_id%9=0 THEN 'Given'
  ELSE coalesce(nullif(left(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\r\n|\r|\n')[1], 80), ''), 'Security Investigation') END AS title FROM prompts""")
def _(spark, d):
    given = F.when(F.col("conv_id") % 9 == 0, "Given").otherwise("")
    return A.sec_prompts(spark, d).select("conv_id", "turn", thread_title(given, F.col("text")).alias("title"))


def _threads(spark, d):
    c = F.col("conv_id")
    return A.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).select(
        c.alias("id"), (c % 5).alias("user_id"), F.timestamp_micros(c * 1000 + F.col("last")).alias("updated_at"))


def _messages(spark, d):
    return A.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("thread_id"), "role",
        F.timestamp_micros("turn").alias("created_at"))


@query("j05_list_threads", """SELECT conv_id AS id, conv_id*1000+max(turn) AS updated_at FROM conversations WHERE conv_id%5=2 GROUP BY conv_id ORDER BY updated_at DESC, id DESC LIMIT 20""")
def _(spark, d):
    return P.list_threads(_threads(spark, d), 2).select("id", "updated_at")


@query("j06_thread_messages", "SELECT conv_id*1000+turn AS id, conv_id AS thread_id, role FROM conversations WHERE conv_id%5=2")
def _(spark, d):
    return P.thread_messages(_threads(spark, d), _messages(spark, d), 2).select("id", "thread_id", "role")


@query("j07_delete_threads", """SELECT conv_id AS thread_id, conv_id*1000+turn AS id FROM conversations WHERE NOT (conv_id%3=0 AND conv_id%5=2)
  UNION ALL SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) FROM conversations WHERE NOT (conv_id%3=0 AND conv_id%5=2)""")
def _(spark, d):
    threads = _threads(spark, d)
    owner = F.when(F.col("id") % 3 == 0, 2).otherwise(-1).cast("bigint")
    doomed = threads.select("id", owner.alias("user_id"))
    left, messages = P.delete_threads(threads, _messages(spark, d), doomed)
    return messages.select("thread_id", "id").union(left.select("id", F.lit(-1).cast("bigint")))


def _vault(spark, d):
    master = F.lit(b"0123456789abcdef0123456789abcdef")
    keys = _threads(spark, d).select("user_id").distinct()
    users = keys.withColumn("wrapped_key", F.base64(F.aes_encrypt(
        F.unhex(F.sha2(F.col("user_id").cast("string"), 256)), master, F.lit("GCM"))))
    c = F.col("conv_id")
    notes = A.table(spark, d, "conversations").select(
        (c * 1000 + F.col("turn")).alias("id"), (c % 5).alias("user_id"), F.col("text").alias("content"),
        F.timestamp_micros(c * 1000 + F.col("turn")).alias("created_at"))
    return notes, users, master


@query("j08_encrypted_notes", """SELECT conv_id*1000+turn AS id, md5(text) AS digest, strlen(text)+28 AS sealed FROM conversations""")
def _(spark, d):
    notes, users, master = _vault(spark, d)
    sealed = P.encrypt_notes(notes, users, master)
    size = F.length(F.unbase64("content")).cast("bigint")
    opened = P.list_notes(sealed.withColumn("sealed", size), users, master)
    return opened.select("id", F.md5("content").alias("digest"), "sealed")


@query("j09_list_notes", """SELECT conv_id*1000+turn AS id, CASE WHEN turn%2=0 THEN '[decryption_error]' ELSE md5(text) END AS content FROM conversations WHERE conv_id%5=3""")
def _(spark, d):
    notes, users, master = _vault(spark, d)
    sealed = P.encrypt_notes(notes, users, master)
    broken = sealed.withColumn("content", F.when(F.col("id") % 2 == 0, F.reverse("content")).otherwise(F.col("content")))
    opened = P.list_notes(broken, users, master, 3)
    return opened.select("id", F.when(F.col("content") == "[decryption_error]", F.col("content"))
                         .otherwise(F.md5("content")).alias("content"))


@query("j10_tag_tokens", """SELECT p_partkey, array_to_string([trim(lower(t)) for t in string_split(p_name||' , '||p_brand||',  '||p_type, ',')], '|') AS tokens FROM part""")
def _(spark, d):
    tags = F.concat("p_name", F.lit(" , "), "p_brand", F.lit(",  "), "p_type")
    listed = tag_tokens(F.split(tags, ","), is_list=True)
    return A.table(spark, d, "part").select("p_partkey", F.when(
        F.col("p_partkey") % 2 == 0, tag_tokens(tags, is_list=False)).otherwise(listed).alias("tokens"))
