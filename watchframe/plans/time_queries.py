"""Checked queries: detections over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchframe.operators import correlation as C
from watchframe.operators import dashboard as G
from watchframe.plans import adapters as A
from watchframe.plans import oracle as O
from watchframe.plans.oracle import with_
from watchframe.plans.registry import query
from watchframe.functions import signatures as sig

_BURST = """f AS (SELECT agent_id, event_id, ts_us, hostname, row_number() OVER (PARTITION BY agent_id ORDER BY ts_us, event_id) AS rn
   FROM sec WHERE event_type='SYSLOG_NETWORK' AND (contains(lower(message),'failed password') OR contains(lower(message),'authentication failure'))),
 r AS (SELECT agent_id, rn, event_id, ts_us, ts_us AS t0, 1 AS c, false AS fired FROM f WHERE rn=1
   UNION ALL
   SELECT agent_id, rn, event_id, ts_us, CASE WHEN fresh THEN ts_us ELSE t0 END, CASE WHEN nc=5 THEN 0 ELSE nc END, nc=5 FROM (
     SELECT *, CASE WHEN fresh THEN 1 ELSE c+1 END AS nc FROM (
       SELECT f.agent_id, f.rn, f.event_id, f.ts_us, r.t0, r.c, (r.c=0 OR f.ts_us-r.t0>=60000000) AS fresh
       FROM r JOIN f ON f.agent_id=r.agent_id AND f.rn=r.rn+1)))"""


@query("d01_brute_force_alerts", with_("sec", more=_BURST, recursive=True) + """SELECT r.agent_id, r.event_id, r.ts_us AS "timestamp",
  'CRITICAL' AS severity, 'syslog_auth' AS process_name, 'correlation_bruteforce' AS event_type, CAST(5 AS BIGINT) AS attempts,
  'Multiple failed login attempts (5) detected within 60 seconds on '||hostname||'.' AS description
  FROM r JOIN f USING (agent_id, event_id) WHERE fired""")
def _(spark, d):
    return C.brute_force_alerts(A.sec_events(spark, d))


_DOC = f"{O.has_any('lower(parent_process_name)', sig.DOCUMENT_PARENTS)} AND {O.has_any('lower(process_name)', sig.DOCUMENT_CHILDREN)}"


@query("d02_document_exploit_alerts", with_("sec") + f"""SELECT event_id, agent_id, ts_us AS "timestamp", 'CRITICAL' AS severity,
  coalesce(process_name,'unknown') AS process_name, 'correlation_lineage' AS event_type,
  'Suspicious child process '''||process_name||''' spawned by '''||parent_process_name||''' — possible macro/document exploit.' AS description
  FROM sec WHERE event_type='PROCESS_CREATED' AND {_DOC}""")
def _(spark, d):
    return C.document_exploit_alerts(A.sec_events(spark, d))


def _lineage_sql(ttl: int) -> str:
    return with_("sec", more=f"""s AS (SELECT *, {_DOC} AS mark FROM sec WHERE event_type='PROCESS_CREATED' AND parent_process_name<>''),
      l AS (SELECT *, max(CASE WHEN mark THEN ts_us END) OVER (PARTITION BY agent_id, parent_pid ORDER BY ts_us, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s)""") + f"""
      SELECT event_id, agent_id, ts_us AS "timestamp", 'HIGH' AS severity, coalesce(process_name,'unknown') AS process_name,
      'correlation_lineage' AS event_type, 'Child process '''||coalesce(process_name,'None')||''' (PID '||pid||') spawned by previously flagged parent '''
      ||parent_process_name||''' (PID '||parent_pid||'). Possible ongoing compromise.' AS description FROM l WHERE ts_us-last<{ttl}*1000000"""


@query("d03_lineage_escalation_alerts", _lineage_sql(300))
def _(spark, d):
    return C.lineage_escalation_alerts(A.sec_events(spark, d))


@query("d03_lineage_escalation_short", _lineage_sql(30))
def _(spark, d):
    return C.lineage_escalation_alerts(A.sec_events(spark, d), 30)


_BEACON = """f AS (SELECT agent_id, ts_us, min(event_id) AS event_id FROM sec GROUP BY agent_id, ts_us),
 g AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts_us, event_id) AS rn FROM f),
 r AS (SELECT agent_id, rn, event_id, [ts_us] AS l, [ts_us] AS keep, CAST(NULL AS DOUBLE) AS var, CAST(NULL AS DOUBLE) AS mean, false AS fired FROM g WHERE rn=1
   UNION ALL
   SELECT agent_id, rn, event_id, CASE WHEN hit THEN [] ELSE nl END, nl, var, mean, hit FROM (
     SELECT *, coalesce(len(nl)>=5 AND var<5.0 AND mean>0, false) AS hit FROM (
       SELECT *, list_aggregate(gaps, 'var_pop') AS var, list_aggregate(gaps, 'avg') AS mean FROM (
         SELECT *, [(nl[i+1]-nl[i])/1000000.0::DOUBLE for i in range(1, len(nl))] AS gaps FROM (
           SELECT g.agent_id, g.rn, g.event_id,
             list_append(CASE WHEN len(r.l)>0 AND g.ts_us-r.l[-1]>=3600000000 THEN [] ELSE r.l[-19:] END, g.ts_us) AS nl
           FROM r JOIN g ON g.agent_id=r.agent_id AND g.rn=r.rn+1)))))"""


def _span(df):
    """Time between first and last contact: an integer, where the mean may sit on a rounding edge."""
    span = F.round(F.col("mean_interval") * (F.col("samples") - 1) * 1_000_000).cast("bigint")
    return df.withColumn("span_us", span).drop("mean_interval")


@query("d04_beacon_alerts", with_("sec", more=_BEACON, recursive=True) + """SELECT r.agent_id, 'unknown' AS pid_key, '185.234.72.18' AS host, r.event_id,
  r.keep[-1] AS "timestamp", 'HIGH' AS severity, coalesce(process_name,'unknown') AS process_name, 'correlation_beacon' AS event_type,
  keep[-1]-keep[1] AS span_us, round(var,6) AS variance, CAST(len(keep) AS BIGINT) AS samples, '443' AS ports,
  'Potential C2 beacon detected: process '||chr(39)||coalesce(process_name,'None')||chr(39)||' (PID unknown) connecting to 185.234.72.18:443 every '||
  (tenths//10)||'.'||(tenths%10)||'s (variance='||printf('%.2f', var)||', '||len(keep)||' samples).' AS description
  FROM (SELECT *, ((keep[-1]-keep[1])*20+(len(keep)-1)*1000000)//(2*(len(keep)-1)*1000000) AS tenths FROM r WHERE fired) r JOIN sec USING (event_id)""")
def _(spark, d):
    return _span(C.beacon_alerts(A.sec_conns(spark, d)))


_BEACON_TWICE = """g AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts_us, event_id, k) AS rn FROM (SELECT agent_id, ts_us, event_id, unnest([1, 2]) AS k FROM sec)),
 r AS (SELECT agent_id, rn, event_id, [ts_us] AS l, [ts_us] AS keep, CAST(NULL AS DOUBLE) AS var, CAST(NULL AS DOUBLE) AS mean, false AS fired FROM g WHERE rn=1
   UNION ALL
   SELECT agent_id, rn, event_id, CASE WHEN hit THEN [] ELSE nl END, nl, var, mean, hit FROM (
     SELECT *, coalesce(len(nl)>=5 AND var<5.0 AND mean>0, false) AS hit FROM (
       SELECT *, list_aggregate(gaps, 'var_pop') AS var, list_aggregate(gaps, 'avg') AS mean FROM (
         SELECT *, [(nl[i+1]-nl[i])/1000000.0::DOUBLE for i in range(1, len(nl))] AS gaps FROM (
           SELECT g.agent_id, g.rn, g.event_id,
             CASE WHEN len(r.l)>0 AND g.ts_us-r.l[-1]>=3600000000 THEN [g.ts_us] WHEN list_contains(r.l, g.ts_us) THEN r.l ELSE list_append(r.l[-19:], g.ts_us) END AS nl
           FROM r JOIN g ON g.agent_id=r.agent_id AND g.rn=r.rn+1)))))"""


@query("d04_beacon_alerts_repeats", with_("sec", more=_BEACON_TWICE, recursive=True) + """SELECT r.agent_id, r.event_id, r.keep[-1] AS "timestamp",
  keep[-1]-keep[1] AS span_us, round(var,6) AS variance, CAST(len(keep) AS BIGINT) AS samples FROM r WHERE fired""")
def _(spark, d):
    twice = A.sec_conns(spark, d).withColumn("network_connections", F.concat("network_connections", "network_connections"))
    return _span(C.beacon_alerts(twice)).select("agent_id", "event_id", "timestamp", "span_us", "variance", "samples")


@query("d05_beacon_candidates", with_("sec", more="""f AS (SELECT agent_id, ts_us, min(event_id) AS event_id FROM sec GROUP BY agent_id, ts_us),
 g AS (SELECT *, (ts_us-lag(ts_us) OVER (PARTITION BY agent_id ORDER BY ts_us, event_id))/1000000.0::DOUBLE AS gap FROM f),
 s AS (SELECT *, sum(CAST(round(gap*1000000) AS BIGINT)) OVER w AS span, var_pop(gap) OVER w AS var, count(gap) OVER w + 1 AS samples FROM g
   WINDOW w AS (PARTITION BY agent_id ORDER BY ts_us, event_id ROWS BETWEEN 18 PRECEDING AND CURRENT ROW))""") + """
 SELECT agent_id, 'unknown' AS pid_key, '185.234.72.18' AS host, event_id, ts_us AS "timestamp", '443' AS port,
 CAST(span AS BIGINT) AS span_us, round(var,6) AS variance, samples FROM s WHERE samples>=5""")
def _(spark, d):
    return _span(C.beacon_candidates(A.sec_conns(spark, d)))


_METRICS = """m AS (SELECT agent_id, ts_us, event_id, 'cpu_usage' AS metric, cpu_usage AS v FROM sec
   UNION ALL SELECT agent_id, ts_us, event_id, 'ram_usage', ram_usage FROM sec),
 s AS (SELECT *, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS std, count(v) OVER w AS n FROM m
   WINDOW w AS (PARTITION BY agent_id, metric ORDER BY ts_us, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 z AS (SELECT *, abs(v-mean)/std AS z FROM s WHERE n>=60 AND std>0 AND abs(v-mean)/std>4.0)"""


def _anomalies(spark, d):
    return C.zscore_anomalies(C.unpivot_metrics(A.sec_events(spark, d)))


@query("d06_zscore_anomalies", with_("sec", more=_METRICS) + """SELECT agent_id, metric, event_id, ts_us AS "timestamp", round(v,6) AS value,
  round(mean,6) AS mean, round(std,6) AS std, round(z,2) AS z_score, CASE WHEN z>6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM z""")
def _(spark, d):
    return _anomalies(spark, d)


@query("d07_unpivot_metrics", with_("sec") + """SELECT agent_id, ts_us AS ts, event_id, 'cpu_usage' AS metric, round(cpu_usage,6) AS value FROM sec
  WHERE event_id%4<>0 UNION ALL SELECT agent_id, ts_us, event_id, 'ram_usage', round(ram_usage,6) FROM sec""")
def _(spark, d):
    e = A.sec_events(spark, d)
    return C.unpivot_metrics(e.withColumn("cpu_usage", F.when(F.col("event_id") % 4 != 0, F.col("cpu_usage"))))


def _top(spark, d):
    t = A.sec_telemetry(spark, d)
    fields = t.schema["processes"].dataType.elementType.names
    empty = F.array().cast(t.schema["processes"].dataType)
    listed = F.when(F.col("id") % 10 == 0, empty).otherwise(F.col("processes"))
    return t.select("id", *[C.top_process(listed, fields, F.lit(m)).alias(n)
                            for m, n in (("cpu_usage", "by_cpu"), ("ram_usage", "by_ram"))])


@query("d08_top_process", with_("telemetry") + """SELECT id, CASE WHEN id%10=0 THEN 'unknown' WHEN cpu_usage>0 THEN coalesce(n1,'unknown')
   ELSE coalesce(n1,'unknown') END AS by_cpu,
  CASE WHEN id%10=0 THEN 'unknown' WHEN 100-cpu_usage>0 AND 100-cpu_usage>=ram_usage THEN coalesce(n1,'unknown')
   WHEN ram_usage>0 THEN coalesce(n2,'unknown') ELSE coalesce(n1,'unknown') END AS by_ram FROM telemetry""")
def _(spark, d):
    return _top(spark, d)


@query("d08_process_strings", with_("sec") + """SELECT event_id, CASE WHEN event_id%4=0 OR process_name IS NULL THEN 'unknown'
  ELSE trim(process_name) END AS top FROM sec""")
def _(spark, d):
    text = F.when(F.col("event_id") % 4 != 0, F.concat("process_name", F.lit("("), "pid", F.lit(")"))).otherwise("plain")
    parsed = C.parse_process_strings(F.array(F.coalesce(text, F.lit("none"))))
    return A.sec_events(spark, d).select(
        "event_id", C.top_process(parsed, ["name", "pid", "cpu_percent"], F.lit("cpu_usage")).alias("top"))


@query("d09_anomaly_alerts", with_("sec", more=_METRICS) + """SELECT agent_id, event_id, ts_us AS "timestamp",
  CASE WHEN z>6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'System' AS process_name, 'statistical_anomaly' AS event_type,
  'Anomaly in '||metric||': '||v||' (z='||round(CAST(round(z,2) AS DECIMAL(18,2)),1)||')' AS description FROM z""")
def _(spark, d):
    return C.anomaly_alerts(_anomalies(spark, d), route="queue")


@query("d09_direct_anomaly_alerts", with_("telemetry", more=_METRICS) + """SELECT agent_id, event_id, ts_us AS "timestamp",
  CASE WHEN z>6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, process_name, 'statistical_anomaly' AS event_type,
  'Suspicious '||CASE metric WHEN 'cpu_usage' THEN 'Cpu Usage' ELSE 'Ram Usage' END||' spike (z-score='||round(CAST(round(z,2) AS DECIMAL(18,2)),1)||
  ', threshold=4.0) on process '||chr(39)||process_name||chr(39)||': current='||round(CAST(v AS DECIMAL(30,15)),1)||'% — significantly above normal baseline. ' AS description
  FROM (SELECT s.agent_id, event_id, ts_us, metric, v, z, CASE WHEN metric='cpu_usage' THEN coalesce(n1,'unknown') WHEN 100-t.cpu_usage>0 AND 100-t.cpu_usage>=t.ram_usage THEN coalesce(n1,'unknown')
   WHEN t.ram_usage>0 THEN coalesce(n2,'unknown') ELSE coalesce(n1,'unknown') END AS process_name FROM z s JOIN telemetry t ON t.id=s.event_id)""")
def _(spark, d):
    t = A.sec_telemetry(spark, d)
    fields = t.schema["processes"].dataType.elementType.names
    found = _anomalies(spark, d).join(t.select(F.col("id").alias("event_id"), "processes"), "event_id").withColumn(
        "top_process", C.top_process(F.col("processes"), fields, F.col("metric")))
    return C.anomaly_alerts(found, route="direct")


_QUOTA = """f AS (SELECT event_id, user_id, ts_us AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS rn FROM sec),
 r AS (SELECT user_id, rn, event_id, us AS t0, 1 AS c FROM f WHERE rn=1
   UNION ALL SELECT f.user_id, f.rn, f.event_id, CASE WHEN f.us-r.t0>=60000000 THEN f.us ELSE r.t0 END,
     CASE WHEN f.us-r.t0>=60000000 THEN 1 ELSE r.c+1 END FROM r JOIN f ON f.user_id=r.user_id AND f.rn=r.rn+1)"""


@query("d10_request_quota", with_("sec", more=_QUOTA, recursive=True) + """SELECT user_id, event_id, CAST(c AS BIGINT) AS request_number,
  c<=10 AS allowed, t0 AS window_start FROM r""")
def _(spark, d):
    log = A.sec_events(spark, d).withColumn("user_id", F.regexp_extract("agent_id", r"(\d+)$", 1).cast("bigint"))
    return C.request_quota(log, limit=10).select("user_id", "event_id", "request_number", "allowed", "window_start")


_SNAP = """p AS (SELECT DISTINCT hostname AS host, ts_us//20000000 AS ts, event_id%50 AS pid FROM sec),
 s AS (SELECT host, ts, lag(ts) OVER (PARTITION BY host ORDER BY ts) AS prev FROM (SELECT DISTINCT host, ts FROM p))"""


@query("d11_new_processes", with_("sec", more=_SNAP) + """SELECT p.host, p.ts*20000000 AS ts, p.pid FROM p JOIN s USING (host, ts)
  WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p o WHERE o.host=p.host AND o.ts=s.prev AND o.pid=p.pid)""")
def _(spark, d):
    slot = F.timestamp_micros(F.call_function("div", F.unix_micros("ts"), F.lit(20_000_000)) * 20_000_000)
    snaps = A.sec_events(spark, d).select(
        F.col("hostname").alias("host"), slot.alias("ts"), (F.col("event_id") % 50).alias("pid")).distinct()
    return C.new_processes(snaps)


@query("d12_bounded_queue", with_("sec") + """SELECT agent_id, event_id AS sequence,
  row_number() OVER (PARTITION BY agent_id ORDER BY event_id DESC) AS place FROM sec QUALIFY place<=40""")
def _(spark, d):
    return C.bounded_queue(A.sec_events(spark, d).select("agent_id", F.col("event_id").alias("sequence")), 40)


@query("d13_agent_last_seen", with_("sec") + "SELECT agent_id, max(ts_us) AS last_seen FROM sec GROUP BY agent_id")
def _(spark, d):
    return C.agent_last_seen(A.sec_events(spark, d))


@query("d14_live_overview", with_("alerts", "agents") + f"""SELECT * FROM (SELECT count(*) AS total_alerts,
  count(*) FILTER (WHERE is_resolved IS NOT true) AS unresolved_alerts,
  count(*) FILTER (WHERE is_resolved IS NOT true AND upper(severity)='CRITICAL') AS current_critical_alerts,
  count(*) FILTER (WHERE is_resolved IS NOT true AND upper(severity)='HIGH') AS current_high_alerts,
  count(*) FILTER (WHERE is_resolved IS NOT true AND upper(severity)='MEDIUM') AS current_medium_alerts FROM alerts),
  (SELECT count(*) FILTER (WHERE last_seen>={O.NOW}-900000000 AND NOT is_demo) AS active_agents,
  count(*) FILTER (WHERE last_seen>={O.NOW}-900000000 AND is_demo) AS demo_agents FROM agents)""")
def _(spark, d):
    return G.stats(A.sec_alerts(spark, d), A.sec_agents(spark, d), A.now()).drop("current_low_alerts")
