"""Checked queries: enrichment and response planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchframe.functions import signatures as sig
from watchframe.functions.text import alert_context, extract_domains, extract_ips, is_domain
from watchframe.operators import enrichment as E
from watchframe.operators import response as R
from watchframe.plans import adapters as A
from watchframe.plans import controls as K
from watchframe.plans import oracle as O
from watchframe.plans.oracle import q, with_
from watchframe.plans.registry import query

_IPS = rf"list_distinct(regexp_extract_all(text, '{sig.IP_PATTERN}'))"
_DOMAINS = rf"list_distinct(regexp_extract_all(text, '{sig.DOMAIN_PATTERN}'))"
# RE2 and Java agree on \b only next to ASCII letters
_JOINED = "coalesce(array_to_string(list_sort({}), '|'), '')"


@query("e01_extract_ips", f"SELECT doc_id, {_JOINED.format(_IPS)} AS ips FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_sort(extract_ips(F.col("text"))).alias("ips"))


_ASCII = r"regexp_replace({}, '[^\x00-\x7F]', '_', 'g')"


@query("e02_extract_domains", f"SELECT page_id, {_JOINED.format(_DOMAINS)} AS domains FROM (SELECT page_id, "
       f"{_ASCII.format('html')} AS text FROM pages)")
def _(spark, d):
    plain = F.regexp_replace("html", r"[^\x00-\x7F]", "_")
    return A.table(spark, d, "pages").select("page_id", F.array_sort(extract_domains(plain)).alias("domains"))


_CONTEXT = "coalesce(process_name,'None')||' '||description||' '||coalesce(process_path,'')"


@query("e03_alert_context", with_("alerts") + f"SELECT id, {_CONTEXT} AS context FROM alerts")
def _(spark, d):
    return A.sec_alerts(spark, d).select("id", alert_context(
        F.col("process_name"), F.col("description"), F.col("process_path")).alias("context"))


@query("e04_external_ips", with_("alerts") + "SELECT id, '203.0.113.'||(id%256) AS ips FROM alerts")
def _(spark, d):
    return E.alert_indicators(A.sec_alerts(spark, d)).select("id", "ips")


def _reports(spark, d):
    """Intelligence reports: two sources, some expired, several per address."""
    i = F.col("event_id")
    e = A.sec_events(spark, d)
    return e.select(
        i.alias("id"),
        F.when(i % 5 == 0, A.pick(["mal.exe", "chrome.exe", "evil.dll", "invoice.pdf.exe"], i))
        .otherwise(F.concat(F.lit("203.0.113."), i * 7 % 200)).alias("query"),
        F.when(i % 4 == 0, "domain").otherwise("ip").alias("source"),
        F.concat(F.lit('{"n": '), i, F.lit("}")).alias("data"), F.col("ts").alias("created_at"),
        F.timestamp_micros(F.unix_micros("ts") + (i % 3) * 200_000_000).alias("cached_until"))


_REPORTS = f"""reports AS (SELECT event_id AS id, CASE WHEN event_id%5=0 THEN {O.pick(["mal.exe", "chrome.exe", "evil.dll", "invoice.pdf.exe"], 'event_id')}
   ELSE '203.0.113.'||(event_id*7%200) END AS query, CASE WHEN event_id%4=0 THEN 'domain' ELSE 'ip' END AS source,
   '{{"n": '||event_id||'}}' AS data, ts_us AS created_at, ts_us+(event_id%3)*200000000 AS cached_until FROM sec)"""
_NEWEST = f"""newest AS (SELECT query, data FROM reports WHERE source='ip' AND cached_until>={O.NOW}
   QUALIFY row_number() OVER (PARTITION BY query ORDER BY created_at DESC, id DESC)=1)"""


@query("e05_osint_lookup", with_("sec", more=f"{_REPORTS}, {_NEWEST}") + """SELECT event_id, '203.0.113.'||(event_id%256) AS query, data
  FROM sec LEFT JOIN newest ON newest.query='203.0.113.'||(event_id%256)""")
def _(spark, d):
    keys = A.sec_events(spark, d).select("event_id", F.concat(F.lit("203.0.113."), F.col("event_id") % 256).alias("query"))
    return E.osint_lookup(keys, _reports(spark, d), "ip", A.now())


@query("e06_domain_reports", with_("sec", more=f"{_REPORTS}, n AS (SELECT query, arg_min(data, id) AS data FROM reports GROUP BY query)") +
       "SELECT event_id, process_name AS query, data FROM sec LEFT JOIN n ON n.query=process_name")
def _(spark, d):
    keys = A.sec_events(spark, d).select("event_id", F.col("process_name").alias("query"))
    return E.domain_reports(keys, _reports(spark, d))


@query("e07_save_osint", with_("sec", more=_REPORTS) + f"""SELECT id, query, source, data, CAST({O.NOW} AS BIGINT) AS created_at,
  CAST({O.NOW}+86400000000 AS BIGINT) AS cached_until FROM reports""")
def _(spark, d):
    return E.save_osint(_reports(spark, d).select("id", "query", "source", "data"), A.now())


_VOTES = """votes AS (SELECT 'ip-'||(event_id%77) AS ip_address, event_id%9 AS malicious,
  CASE WHEN event_id%6=0 THEN NULL WHEN event_id%7=0 THEN 0 ELSE 20+event_id%30 END AS total, ts_us, event_id,
  (event_id%9)/coalesce(nullif(CASE WHEN event_id%6=0 THEN NULL WHEN event_id%7=0 THEN 0 ELSE 20+event_id%30 END,0),1)::DOUBLE AS ratio FROM sec)"""
_LABEL = "CASE WHEN {0}>0.3 THEN 'malicious' WHEN {0}>0.1 THEN 'suspicious' ELSE 'known' END"


def _votes(spark, d):
    i = F.col("event_id")
    return A.sec_events(spark, d).select(
        F.concat(F.lit("ip-"), i % 77).alias("ip_address"), (i % 9).alias("malicious"),
        F.when(i % 6 == 0, None).when(i % 7 == 0, 0).otherwise(20 + i % 30).alias("total"),
        F.concat(F.lit("d"), i).alias("details"), "ts", "event_id")


@query("e08_ip_verdict", with_("sec", more=_VOTES) + f"""SELECT event_id, {_LABEL.format('ratio')} AS label,
  CAST(trunc(ratio*100) AS BIGINT) AS confidence FROM votes""")
def _(spark, d):
    ratio = E.verdict_ratio(F.col("malicious"), F.col("total"))
    return _votes(spark, d).select("event_id", E.ip_label(ratio).alias("label"), E.ip_confidence(ratio).alias("confidence"))


def _stored(spark, d):
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").select(
        F.concat(F.lit("ip-"), k).alias("ip_address"), A.pick(sig.REPUTATION_LABELS, k).alias("label"),
        (k % 101).cast("int").alias("confidence"), F.lit("seed").alias("source"), F.lit(None).cast("string").alias("details"),
        F.timestamp_micros(k * 1_000_000).alias("updated_at"))


_STORED = f"""stored AS (SELECT 'ip-'||c_custkey AS ip_address, {O.pick(sig.REPUTATION_LABELS, 'c_custkey')} AS label,
  c_custkey%101 AS confidence, 'seed' AS source, CAST(NULL AS VARCHAR) AS details, c_custkey*1000000 AS updated_at FROM customer)"""


@query("e09_merge_reputation_auto", with_("sec", more=f"""{_VOTES}, {_STORED}, n AS (SELECT ip_address, arg_max(ratio, ts_us) AS ratio,
   arg_max('d'||event_id, ts_us) AS details, max(CAST(trunc(ratio*100) AS BIGINT)) AS confidence FROM votes GROUP BY ip_address)""") +
       f"""SELECT ip_address, CASE WHEN n.ratio IS NULL THEN s.label ELSE {_LABEL.format('n.ratio')} END AS label,
  greatest(s.confidence, n.confidence) AS confidence, CASE WHEN n.ratio IS NULL THEN s.source ELSE 'auto_osint' END AS source,
  n.details, CASE WHEN n.ratio IS NULL THEN s.updated_at ELSE {O.NOW} END AS updated_at FROM stored s FULL JOIN n USING (ip_address)""")
def _(spark, d):
    return E.merge_reputation_auto(_stored(spark, d), _votes(spark, d), A.now())


def _entries(spark, d):
    i = F.col("event_id")
    return A.sec_events(spark, d).select(
        F.concat(F.lit("9.9."), i % 7, F.lit("."), i % 300).alias("ip_address"),
        A.pick(["known", "suspicious", "malicious", "unknown", "odd"], i).alias("label"),
        F.when(i % 8 != 0, (i % 110).cast("int")).alias("confidence"), F.lit(None).cast("string").alias("source"),
        F.lit("x").alias("details"), F.timestamp_micros(i).alias("ts"), "event_id")


_ENTRIES = f"""entries AS (SELECT '9.9.'||(event_id%7)||'.'||(event_id%300) AS ip_address,
  {O.pick(["known", "suspicious", "malicious", "unknown", "odd"], 'event_id')} AS label,
  CASE WHEN event_id%8<>0 THEN event_id%110 ELSE 50 END AS confidence, event_id FROM events),
  ok AS (SELECT *, label<>'odd' AND confidence<=100 AND event_id%300<256 AS good FROM entries)"""


@query("e10_merge_reputation_manual", f"""WITH {_ENTRIES}, {_STORED} SELECT ip_address, label, confidence, 'manual' AS source, 'x' AS details,
  CAST({O.NOW} AS BIGINT) AS updated_at FROM ok WHERE good QUALIFY row_number() OVER (PARTITION BY ip_address ORDER BY event_id DESC)=1
  UNION ALL SELECT ip_address, label, confidence, source, details, updated_at FROM stored""")
def _(spark, d):
    table, _ = E.merge_reputation_manual(_stored(spark, d), _entries(spark, d).drop("event_id"), A.now())
    return table


@query("e10_rejected_reputation", f"WITH {_ENTRIES} SELECT event_id, ip_address, label, confidence FROM ok WHERE NOT good")
def _(spark, d):
    _, rejected = E.merge_reputation_manual(_stored(spark, d), _entries(spark, d), A.now())
    return rejected.select("event_id", "ip_address", "label", "confidence")


@query("e10_analyst_confidence", f"WITH {_STORED} SELECT ip_address, CASE label WHEN 'malicious' THEN 90 WHEN 'suspicious' THEN 65 ELSE 40 END::BIGINT AS confidence FROM stored")
def _(spark, d):
    return _stored(spark, d).select("ip_address", E.analyst_confidence(F.col("label")).alias("confidence"))


@query("e11_list_reputation", f"WITH {_STORED} SELECT ip_address, label, updated_at FROM stored WHERE label='malicious' ORDER BY updated_at DESC, ip_address LIMIT 250")
def _(spark, d):
    return E.list_reputation(_stored(spark, d), "malicious").select("ip_address", "label", "updated_at")


def _threats(spark, d):
    """Stored threat reports: one for most alerts, some on deleted ones, some written by hand."""
    i = F.col("event_id")
    return A.sec_events(spark, d).select(
        i.alias("id"), F.when(i % 7 != 0, i).otherwise(-1).alias("alert_id"), F.concat(F.lit("summary "), i).alias("summary"),
        A.pick(["low", "medium", "high"], i).alias("confidence"), (i % 5 != 0).alias("is_auto_generated"),
        F.col("ts").alias("created_at"))


@query("e12_unenriched_alerts", with_("alerts") + """SELECT id, "timestamp" FROM alerts WHERE id%7=0 OR id%5=0
  ORDER BY "timestamp" DESC, id DESC LIMIT 10""")
def _(spark, d):
    return E.unenriched_alerts(A.sec_alerts(spark, d), _threats(spark, d)).select("id", "timestamp")


def _analyses(spark, d):
    i = F.col("id")
    return A.sec_alerts(spark, d).where(F.col("severity") == "LOW").select(
        i.alias("alert_id"), F.concat(F.lit("about "), i).alias("summary"), F.lit("high").alias("confidence"),
        F.array(F.lit("look"), F.lit("act")).alias("recommended_actions"), F.lit("long").alias("detailed_analysis"))


_INTEL = rf"""ioc AS (SELECT id, unnest(list_distinct(regexp_extract_all({_CONTEXT}, '{sig.IP_PATTERN}'))) AS query, 'ip' AS kind FROM alerts
    UNION ALL SELECT id, unnest(list_distinct(regexp_extract_all({_CONTEXT}, '{sig.DOMAIN_PATTERN}'))), 'domain' FROM alerts),
  anyreport AS (SELECT query, arg_min(data, id) AS data FROM reports GROUP BY query),
  found AS (SELECT ioc.id, ioc.query, n.data FROM ioc JOIN newest n USING (query) WHERE kind='ip' AND NOT starts_with(ioc.query,'10.')
    UNION ALL SELECT ioc.id, ioc.query, n.data FROM ioc JOIN anyreport n USING (query) WHERE kind='domain'),
  intel AS (SELECT id, string_agg(query||'='||data, ',' ORDER BY query) AS intel FROM found GROUP BY id)"""


@query("e13_threat_reports", with_("alerts", more=f"{_REPORTS}, {_NEWEST}, {_INTEL}") + """SELECT a.id AS alert_id,
   CASE WHEN a.id%4=0 THEN 'about '||a.id ELSE 'No analysis generated' END AS summary,
   CASE WHEN a.id%4=0 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN a.id%4=0 THEN 'look|act' ELSE '' END AS recommended_actions,
   CASE WHEN a.id%4=0 THEN 'long' END AS ai_analysis, true AS is_auto_generated, intel.intel
   FROM alerts a LEFT JOIN intel USING (id) WHERE a.id%4=0 OR intel.intel IS NOT NULL""")
def _(spark, d):
    made = E.threat_reports(A.sec_alerts(spark, d), _reports(spark, d), A.now(), _analyses(spark, d))
    pairs = F.transform(F.array_sort(F.map_entries("osint_data")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return made.withColumn("intel", F.array_join(pairs, ",")).drop("osint_data", "created_at")


@query("e14_parse_model_report", with_("alerts") + """SELECT id, CASE id%4 WHEN 0 THEN 'S'||id ELSE 'Alert: '||left(description,100) END AS s,
  CASE id%4 WHEN 0 THEN 'low' ELSE 'medium' END AS c, CASE id%4 WHEN 0 THEN 'a|b' ELSE 'Investigate process '||coalesce(process_name,'None')||' on host' END AS r,
  CASE id%4 WHEN 0 THEN 'D' WHEN 1 THEN 'no json here' WHEN 2 THEN 'broken {"summary": } end' END AS a FROM alerts""")
def _(spark, d):
    i = F.col("id")
    good = F.concat(F.lit('Sure!\n{"summary": "S'), i, F.lit('", "confidence": "low",\n"recommended_actions": ["a", "b"], "detailed_analysis": "D"} done'))
    answer = F.when(i % 4 == 0, good).when(i % 4 == 1, "no json here").when(i % 4 == 2, 'broken {"summary": } end').otherwise("")
    parsed = E.parse_model_report(A.sec_alerts(spark, d).withColumn("answer", answer))
    return parsed.select("id", F.col("summary").alias("s"), F.col("confidence").alias("c"),
                         F.col("recommended_actions").alias("r"), F.col("detailed_analysis").alias("a"))


@query("e15_batch_ip_lookup", with_("sec", more=f"""{_REPORTS}, {_NEWEST}, b AS (SELECT event_id AS position,
   '203.0.113.'||(event_id*3%400) AS ip, event_id*3%400<256 AS ok FROM events ORDER BY event_id LIMIT 50)""") +
       """SELECT position, ip, CASE WHEN NOT ok THEN 'error' WHEN data IS NOT NULL THEN 'cached' ELSE 'pending' END AS status,
   CASE WHEN NOT ok THEN 'Invalid IP' END AS error, CASE WHEN ok THEN data END AS data FROM b LEFT JOIN newest ON newest.query=b.ip""")
def _(spark, d):
    ips = A.table(spark, d, "events").select(
        F.col("event_id").alias("position"), F.concat(F.lit("203.0.113."), F.col("event_id") * 3 % 400).alias("ip"))
    return E.batch_ip_lookup(ips, _reports(spark, d), A.now())


@query("e16_domain_syntax", rf"""SELECT page_id, host, regexp_matches(host, '{sig.DOMAIN_SYNTAX}') AS ok FROM (SELECT page_id,
  CASE WHEN page_id%5=0 THEN '-bad.'||regexp_extract(url, '^https?://([^/]+)', 1) ELSE regexp_extract(url, '^https?://([^/]+)', 1) END AS host FROM pages)""")
def _(spark, d):
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    host = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("-bad."), host)).otherwise(host)
    return A.table(spark, d, "pages").select("page_id", host.alias("host")).withColumn("ok", is_domain(F.col("host")))


@query("e17_osint_history", with_("sec", more=_REPORTS) + """SELECT query, source, created_at, cached_until FROM reports
  ORDER BY created_at DESC, id DESC LIMIT 10""")
def _(spark, d):
    return E.osint_history(_reports(spark, d))


@query("e18_provider_payloads", with_("sec") + """SELECT agent_id||'/'||event_id AS target, CASE WHEN event_id%2=0 THEN 'I'||event_id ELSE 'Unknown' END AS isp,
  'Unknown' AS city, event_id%3 AS score, CASE WHEN event_id%3=0 THEN 'N/A' ELSE '2024' END AS reported, event_id%4 AS malicious, CAST(0 AS BIGINT) AS harmless, 'owner' AS owner FROM sec""")
def _(spark, d):
    i = F.col("event_id")
    text = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    landed = A.sec_events(spark, d).select(
        F.concat("agent_id", F.lit("/"), i).alias("target"),
        F.when(i % 2 == 0, text('{"isp": "I', i, '", "city": ""}')).otherwise(F.lit("{}")).alias("host_scan"),
        F.when(i % 3 == 0, F.lit('{"data": {}}')).otherwise(
            text('{"data": {"abuseConfidenceScore": ', i % 3, ', "lastReportedAt": "2024"}}')).alias("abuse"),
        text('{"data": {"attributes": {"last_analysis_stats": {"malicious": ', i % 4, '}, "as_owner": "owner"}}}').alias("votes"))
    s = "sources"
    return E.combine_sources(landed, A.now()).select(
        "target", F.col(f"{s}.host_scan.isp"), F.col(f"{s}.host_scan.city"),
        F.col(f"{s}.abuse.abuseConfidenceScore").alias("score"), F.col(f"{s}.abuse.lastReportedAt").alias("reported"),
        F.col(f"{s}.votes.malicious"), F.col(f"{s}.votes.harmless"), F.col(f"{s}.votes.as_owner").alias("owner"))


# ---------------------------------------------------------------- response

def _values(rows) -> str:
    cell = lambda v: "NULL" if v is None else (str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else q(v))
    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


_BOOKS = f"""books(pid_, name, active, sev, typ, part) AS (VALUES {_values(K.PLAYBOOKS)}),
 m AS (SELECT a.*, b.pid_ AS playbook_id, b.name AS playbook_name FROM alerts a JOIN books b ON active
   AND (coalesce(sev,'')='' OR upper(sev)=upper(a.severity)) AND (coalesce(typ,'')='' OR typ=a.event_type)
   AND (coalesce(part,'')='' OR contains(lower(coalesce(a.process_name,'')), lower(part))))"""
_ACTIONS = f"""acts(action_id, playbook_id, action, target, params, ord) AS (VALUES {_values(K.ACTIONS)}),
 pl AS (SELECT m.id AS alert_id, agent_id, m.playbook_id, action_id, ord, action, target,
   pid IS NOT NULL AS has_pid,
   CASE WHEN action IN ('kill_process','kill_process_tree','quarantine_binary','verify','collect_ioc') AND pid IS NULL THEN 'failed'
     WHEN action='send_fax' THEN 'failed' WHEN action IN ('webhook','script') THEN 'planned' ELSE 'completed' END AS status,
   CASE WHEN action IN ('kill_process','kill_process_tree','quarantine_binary','verify','collect_ioc') AND pid IS NULL THEN 'No PID available'
     WHEN action='send_fax' THEN 'Unknown action type: send_fax' WHEN action='webhook' THEN 'POST '||target WHEN action='script' THEN 'RUN '||target
     WHEN action='eradicate' THEN 'Eradication chain executed' ELSE 'Command queued: '||upper(action) END AS output,
   CASE WHEN action='eradicate' THEN (CASE WHEN pid IS NULL THEN 1 ELSE 5 END)
     WHEN action IN ('kill_process','kill_process_tree','quarantine_binary','verify','collect_ioc') AND pid IS NULL THEN 0
     WHEN action IN ('send_fax','script') THEN 0 ELSE 1 END AS commands FROM m JOIN acts USING (playbook_id))"""


def _matches(spark, d):
    return R.match_playbooks(A.sec_alerts(spark, d), K.playbooks(spark))


def _plan(spark, d):
    return R.plan_actions(_matches(spark, d), K.playbook_actions(spark))


@query("f01_match_playbooks", with_("alerts", more=_BOOKS) + "SELECT id, CAST(playbook_id AS BIGINT) AS playbook_id, playbook_name FROM m")
def _(spark, d):
    return _matches(spark, d).select("id", "playbook_id", "playbook_name")


@query("f02_plan_actions", with_("alerts", more=f"{_BOOKS}, {_ACTIONS}") + """SELECT alert_id, agent_id, CAST(playbook_id AS BIGINT) AS playbook_id,
  CAST(action_id AS BIGINT) AS action_id, CAST(ord AS BIGINT) AS "order", action, target, status, output, CAST(commands AS BIGINT) AS commands FROM pl""")
def _(spark, d):
    return _plan(spark, d).select("alert_id", "agent_id", "playbook_id", "action_id", "order", "action", "target",
                                  "status", "output", F.size("commands").cast("bigint").alias("commands"))


_CHAIN = "['COLLECT_IOC','QUARANTINE_BINARY','KILL_PROCESS_TREE','REMOVE_PERSISTENCE','VERIFY']"


@query("f03_eradication_chain", with_("alerts", more=f"""s AS (SELECT id, unnest(CASE WHEN pid IS NULL THEN ['REMOVE_PERSISTENCE'] ELSE {_CHAIN} END) AS command,
   unnest(range(CASE WHEN pid IS NULL THEN 1 ELSE 5 END)) AS step, pid, process_name FROM alerts)""") +
       """SELECT id, step, command, CASE WHEN command<>'REMOVE_PERSISTENCE' THEN pid END AS pid,
   CASE WHEN command<>'VERIFY' THEN process_name END AS process_name, id AS alert_id FROM s""")
def _(spark, d):
    rows = A.sec_alerts(spark, d).select("id", "pid", "process_name").select(
        "id", F.posexplode(R.eradication_chain()).alias("step", "_c"))
    get = lambda name: F.get_json_object("_c", f"$.{name}")
    return rows.select("id", "step", get("command").alias("command"), get("pid").cast("bigint").alias("pid"),
                       get("process_name").alias("process_name"), get("alert_id").cast("bigint").alias("alert_id"))


@query("f04_remediation_rows", with_("alerts", more=f"{_BOOKS}, {_ACTIONS}") + "SELECT alert_id, agent_id, action, target, status, output AS details FROM pl")
def _(spark, d):
    return R.remediation_rows(_plan(spark, d))


@query("f05_execution_rows", with_("alerts", more=f"{_BOOKS}, {_ACTIONS}") + """SELECT alert_id, CAST(playbook_id AS BIGINT) AS playbook_id, 'completed' AS status,
  string_agg(status||':'||output, ';' ORDER BY ord, action_id) AS actions FROM pl GROUP BY alert_id, playbook_id""")
def _(spark, d):
    rows = R.execution_rows(_matches(spark, d), K.playbook_actions(spark))
    return rows.withColumn("actions", F.array_join(F.transform(
        "actions", lambda a: F.concat(a["status"], F.lit(":"), a["output"])), ";"))


def _books(spark, d):
    """Playbooks made from the part table, with two actions each."""
    k = F.col("p_partkey")
    books = A.table(spark, d, "part").select(
        k.alias("id"), F.concat("p_name", F.lit(" "), k).alias("name"), (k % 2 == 0).alias("is_active"),
        F.lit(None).cast("string").alias("trigger_severity"))
    actions = A.table(spark, d, "part").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), k.alias("k")).select(
        (F.col("k") * 2 + F.col("n")).alias("id"), F.col("k").alias("playbook_id"),
        F.concat(F.lit("type"), F.col("n")).alias("action_type"), F.lit(None).cast("string").alias("target"),
        F.lit(None).cast("string").alias("params"), (1 - F.col("n")).alias("order"))
    return books, actions


@query("f06_list_playbooks", "SELECT p_partkey AS id, p_name||' '||p_partkey AS name, p_partkey%2=0 AS is_active, 'type1,type0' AS actions FROM part")
def _(spark, d):
    listed = R.list_playbooks(*_books(spark, d))
    return listed.select("id", "name", "is_active", F.array_join("actions.action_type", ",").alias("actions"))


@query("f07_create_playbooks", """WITH w AS (SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN p_name||' '||p_partkey WHEN c_custkey%3=1 THEN 'shared '||(c_custkey%11) ELSE c_name END AS name
   FROM customer LEFT JOIN part ON p_partkey=c_custkey),
   n AS (SELECT id, name FROM w QUALIFY id=min(id) OVER (PARTITION BY name)) SELECT 'stored' AS kind, p_partkey AS id, p_name||' '||p_partkey AS name, CAST(NULL AS BIGINT) AS "order" FROM part
   UNION ALL SELECT 'stored', id, name, NULL FROM n WHERE name NOT IN (SELECT p_name||' '||p_partkey FROM part)
   UNION ALL SELECT 'refused', id, name, NULL FROM w WHERE name IN (SELECT p_name||' '||p_partkey FROM part) OR name IS NULL OR (id, name) NOT IN (SELECT (id, name) FROM n)
   UNION ALL SELECT 'action', id, 'a', 5 FROM n WHERE name NOT IN (SELECT p_name||' '||p_partkey FROM part)
   UNION ALL SELECT 'action', id, 'b', 1 FROM n WHERE name NOT IN (SELECT p_name||' '||p_partkey FROM part)""")
def _(spark, d):
    books, actions = _books(spark, d)
    part = A.table(spark, d, "part").select(F.col("p_partkey").alias("c_custkey"), "p_name")
    step = lambda t, o: F.struct(F.lit(t).alias("action_type"), F.lit(None).cast("string").alias("target"),
                                 F.lit(None).cast("string").alias("params"), F.lit(o).cast("int").alias("order"))
    new = A.table(spark, d, "customer").join(part, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat("p_name", F.lit(" "), "c_custkey"))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("shared "), F.col("c_custkey") % 11)).otherwise(F.col("c_name")).alias("name"),
        F.lit(True).alias("is_active"), F.array(step("a", 5), step("b", 0)).alias("actions"))
    table, added, refused = R.create_playbooks(books, actions.limit(0), new)
    none = F.lit(None).cast("int").alias("order")
    return (table.select(F.lit("stored").alias("kind"), "id", "name", none)
            .union(refused.select(F.lit("refused"), "id", "name", none))
            .union(added.select(F.lit("action"), "playbook_id", "action_type", "order")))


@query("f07_update_and_delete_playbook", """SELECT p_partkey AS id, CASE p_partkey WHEN 3 THEN 'renamed' ELSE p_name||' '||p_partkey END AS name,
   p_partkey%2=0 AS is_active, CAST(2 AS BIGINT) AS actions FROM part WHERE p_partkey<>4""")
def _(spark, d):
    books, actions = _books(spark, d)
    changed = R.update_playbook(books, 3, {"name": "renamed", "is_active": None})
    books, actions = R.delete_playbook(changed, actions, 4)
    n = actions.groupBy(F.col("playbook_id").alias("id")).agg(F.count("*").alias("actions"))
    return books.join(n, "id", "left").select("id", "name", "is_active", "actions")


@query("f08_list_executions", with_("alerts") + """SELECT id, agent_id, "timestamp" AS started_at FROM alerts ORDER BY "timestamp" DESC, id DESC LIMIT 50""")
def _(spark, d):
    runs = A.sec_alerts(spark, d).select("id", "agent_id", F.col("timestamp").alias("started_at"))
    return R.list_executions(runs)


@query("f09_temporary_blocks", with_("sec", more="""b AS (SELECT event_id, ts_us AS planned_at, CASE WHEN event_id%3=0 THEN 3600 ELSE event_id%400 END AS duration_seconds FROM sec)""") +
       f"SELECT event_id, duration_seconds, planned_at+duration_seconds*1000000 AS expires_at FROM b WHERE planned_at+duration_seconds*1000000>{O.NOW}")
def _(spark, d):
    i = F.col("event_id")
    params = F.when(i % 3 != 0, F.concat(F.lit('{"duration_seconds": '), i % 400, F.lit("}"))).otherwise("{}")
    blocks = A.sec_events(spark, d).select("event_id", F.col("ts").alias("planned_at"), params.alias("params"))
    return R.temporary_blocks(blocks, A.now()).select("event_id", "duration_seconds", "expires_at")
