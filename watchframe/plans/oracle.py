"""SQL building blocks for the DuckDB side of the checks."""

from __future__ import annotations

from watchframe.functions import signatures as sig
from watchframe.plans import adapters as A


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def lst(items: list) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def within(column: str, items: list[str]) -> str:
    return f"coalesce({column} IN ({', '.join(q(i) for i in items)}), false)"


def has_any(column: str, items: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"contains({column}, {q(i)})" for i in items) + ", false)"


def finds_any(column: str, patterns: list[str], flags: str = "") -> str:
    option = f", '{flags}'" if flags else ""
    return "coalesce(" + " OR ".join(f"regexp_matches({column}, {q(p)}{option})" for p in patterns) + ", false)"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def pick(values: list, index: str) -> str:
    return f"{lst(values)}[({index})%{len(values)}+1]"


US = f"({A.EPOCH_US} + (epoch_us(ts)-{A.EPOCH_US})//{A.COMPRESSION})"
NOW = A.NOW_US

CTES = {
    "sec": f"""SELECT event_id, user_id, 'agent-'||user_id AS agent_id, {US} AS ts_us,
      CASE event_type WHEN 'error' THEN 'SYSLOG_NETWORK' WHEN 'purchase' THEN 'METRICS_REPORT'
        WHEN 'signup' THEN 'AGENT_HEARTBEAT' ELSE 'PROCESS_CREATED' END AS event_type,
      'host-'||(user_id%20) AS hostname, '10.0.'||(user_id%256)||'.5' AS ip_address,
      1000+event_id%50 AS pid, 1000+event_id%3 AS parent_pid,
      {pick(A.NAMES, 'event_id')} AS process_name,
      {pick(A.PARENTS, 'event_id//24')} AS parent_process_name,
      {pick(A.PATHS, 'event_id//7')} AS process_path,
      {pick(A.USERS, 'event_id//5')} AS "user",
      CAST(floor(value) AS BIGINT) AS thread_count, value AS cpu_usage, value/2 AS ram_usage,
      CASE WHEN event_type='error' THEN 'Failed password for root from 203.0.113.'||(event_id%256) END AS message
      FROM events""",
    "mix": f"""SELECT *, {pick(A.REMOTES, 'event_id')} AS remote,
      CASE WHEN event_id%5=0 THEN 'TIME_WAIT' ELSE 'ESTABLISHED' END AS state FROM sec""",
    "alerts": f"""SELECT event_id AS id, agent_id, ts_us AS "timestamp",
      {pick(['LOW', 'MEDIUM', 'HIGH', 'critical'], 'event_id')} AS severity,
      CASE event_id%3 WHEN 0 THEN true WHEN 1 THEN false END AS is_resolved, event_type, process_name,
      process_path, CASE WHEN event_id%10<>0 THEN pid END AS pid,
      'alert about '||coalesce(process_name,'none')||' from 203.0.113.'||(event_id%256)||' and 10.1.2.3' AS description
      FROM sec""",
    "telemetry": f"""SELECT event_id AS id, agent_id AS device_id, ts_us AS "timestamp", cpu_usage,
      ram_usage, event_id*10 AS disk_free, event_id*20 AS disk_total,
      process_name AS n1, process_path AS p1, {pick(A.NAMES, 'event_id//3')} AS n2,
      {pick(A.PATHS, 'event_id//11')} AS p2 FROM sec""",
    "agents": f"""SELECT agent_id, hostname, ip_address, {pick(['linux', 'windows'], 'user_id')} AS os_type,
      {pick([A.METRICS_AGENT, A.ENDPOINT_AGENT, A.METRICS_AGENT.title()], 'user_id')} AS agent_type,
      user_id%10=0 AS is_demo, max(ts_us) AS last_seen
      FROM sec GROUP BY agent_id, user_id, hostname, ip_address""",
    "prompts": """SELECT conv_id, turn, role, text
      || CASE WHEN (conv_id+turn)%7=0 THEN ' Ignore all previous instructions' ELSE '' END
      || CASE WHEN (conv_id+turn)%11=0 THEN ' please act as if root' ELSE '' END AS text FROM conversations""",
}
NEEDS = {"mix": ["sec"], "alerts": ["sec"], "telemetry": ["sec"], "agents": ["sec"], "prep": ["sec"],
         "prepc": ["sec", "mix"]}


def with_(*names: str, more: str = "", recursive: bool = False) -> str:
    """WITH clause of the named tables, and of what they need."""
    order: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    if more:
        parts.append(more)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "


def _prep(source: str, remotes: bool) -> str:
    public = f"""CASE WHEN state='ESTABLISHED' AND contains(remote, ':')
        AND regexp_extract(remote, '^(.*):([^:]*)$', 1) <> ''
        AND NOT regexp_matches(regexp_extract(remote, '^(.*):([^:]*)$', 1), {q(sig.PRIVATE_V4)})
        THEN remote END""" if remotes else "CAST(NULL AS VARCHAR)"
    name = strip("lower(process_name)")
    return f"""SELECT *, replace(replace(replace(n,'.exe',''),'.com',''),'.dll','') AS bare,
      replace(replace(replace(replace(n,'.exe',''),'.dll',''),'.bat',''),'.ps1','') AS stem,
      {has_any('p', sig.SUSPICIOUS_PATHS)} AS bad, coalesce(process_name,'None') AS sn,
      coalesce(process_path,'None') AS sp
      FROM (SELECT *, {name} AS n, lower(process_path) AS p, {strip('lower(parent_process_name)')} AS par,
            {public} AS pub FROM {source})"""


CTES["prep"] = _prep("sec", False)
CTES["prepc"] = _prep("mix", True)


def _case(rows: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in rows) + " END"


GROUP = _case([(f"{has_any('par', g[0])} AND {has_any('n', g[1])}", str(i))
               for i, g in enumerate(sig.PARENT_CHILD_GROUPS, 1)])
FAMILY = _case([(f"(contains(n, {q(f[0])}) OR contains(stem, {q(f[0])}))", str(i))
                for i, f in enumerate(sig.MALWARE_FAMILIES, 1)])


def _by_number(number: str, values: list[str]) -> str:
    return f"{lst(values)}[{number}]"


def rule_parts(rule: str) -> tuple[str, str, str]:
    """(condition, description, extra projection) of a static rule over ``prep``."""
    return {
        "Known Attack Tool": (
            f"({within('n', sig.attack_tools())} OR {within('bare', sig.attack_tools())})",
            "'Known attack tool / malware detected: '''||sn||'''.'"),
        "Suspicious Execution Path": (
            "bad", "'Process '''||sn||''' executing from suspicious path: '''||sp||'''.'"),
        "Privilege Escalation": (
            f"{within(strip('lower(coalesce(\"user\", ' + q('') + '))'), sig.PRIVILEGED_USERS)} AND {within('n', sig.DESKTOP_APPS)}",
            "'Privilege escalation indicator: '''||sn||''' running as '''||\"user\"||'''.'"),
        "Double Extension": (
            finds_any("lower(process_name)", [sig.DOUBLE_EXTENSION]),
            "'Double extension detected in '''||sn||'''.'"),
        "Encoded Command": (
            finds_any("p", sig.ENCODED_PATTERNS),
            "'Encoded/obfuscated command detected in '''||sn||''': possible payload.'"),
        "Persistence Path": (
            has_any("p", sig.PERSISTENCE_PATHS),
            "'Process '''||sn||''' installed persistence at: '''||sp||'''.'"),
        "Script Interpreter Abuse": (
            within("n", sig.SCRIPT_INTERPRETERS), "'Script interpreter '''||sn||''' detected.'"),
        "Network Tool in Suspicious Path": (
            f"{within('n', sig.NETWORK_TOOLS)} AND bad",
            "'Network tool '''||sn||''' from suspicious path: '''||sp||'''.'"),
        "DLL Hijacking": (
            "coalesce(ends_with(p, '.dll'), false) AND bad",
            "'Possible DLL hijacking: '''||sn||''' loaded from suspicious path.'"),
        "LOLBin Abuse": (
            f"{within('n', sig.LOLBINS)} AND p IS NOT NULL AND NOT {has_any('p', sig.LOLBIN_HOME_PATHS)}",
            "'LOLBin '''||sn||''' executed from non-standard path: '''||sp||'''.'"),
        "High Thread Count": (
            f"coalesce(thread_count > {sig.HIGH_THREAD_COUNT}, false)",
            "'Process '''||sn||''' has abnormally high thread count: '||thread_count||'. Possible injection.'"),
        "Network Beacon": (
            "pub IS NOT NULL", "'Process '''||sn||''' has 1 outbound connections: '||pub||'.'"),
        "Persistence Autorun": (
            within("n", sig.AUTORUN_LOOKALIKES), "'Suspicious persistence-like process name: '''||sn||'''.'"),
    }[rule]


def hits(rule: str, pos: int, prep: str = "prep") -> str:
    """SELECT of the events on which a rule fires, with its match fields."""
    if rule == "Suspicious Parent-Child":
        g = sig.PARENT_CHILD_GROUPS
        return f"""SELECT event_id, {pos} AS pos, '{rule}' AS rule, {_by_number('g', [x[2] for x in g])} AS severity,
          {_by_number('g', [x[3] for x in g])}||': '''||parent_process_name||''' -> '''||sn||'''.' AS description,
          {_by_number('g', [x[4] for x in g])} AS tactic_id, {_by_number('g', [x[5] for x in g])} AS tactic,
          {_by_number('g', [x[6] for x in g])} AS technique, {_by_number('g', [x[7] for x in g])} AS technique_id
          FROM (SELECT *, {GROUP} AS g FROM {prep}) WHERE g IS NOT NULL"""
    if rule == "Malware Family":
        f = sig.MALWARE_FAMILIES
        return f"""SELECT event_id, {pos} AS pos, '{rule}' AS rule, {_by_number('g', [x[1] for x in f])} AS severity,
          {_by_number('g', [x[2] for x in f])}||': process name '''||sn||'''.' AS description,
          {_by_number('g', [x[3] for x in f])} AS tactic_id,
          {_by_number('g', ['Tactic ' + x[3][2:] for x in f])} AS tactic,
          {_by_number('g', [x[4] for x in f])} AS technique, {_by_number('g', [x[5] for x in f])} AS technique_id
          FROM (SELECT *, {FAMILY} AS g FROM {prep}) WHERE g IS NOT NULL"""
    condition, description = rule_parts(rule)
    _, severity, tactic_id, tactic, technique, technique_id, _ = next(
        r for r in sig.STATIC_RULES if r[0] == rule)
    return f"""SELECT event_id, {pos} AS pos, {q(rule)} AS rule, {q(severity)} AS severity,
      {description} AS description, {q(tactic_id)} AS tactic_id, {q(tactic)} AS tactic,
      {q(technique)} AS technique, {q(technique_id)} AS technique_id FROM {prep} WHERE {condition}"""


def all_hits(prep: str = "prep") -> str:
    return " UNION ALL ".join(hits(r[0], i, prep) for i, r in enumerate(sig.STATIC_RULES))


def uuid5(text: str) -> str:
    """UUID version 5 in the DNS name space."""
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({text}))"
    variant = f"['8','9','a','b'][(CAST(('0x'||substr({h},17,1)) AS INTEGER)%4)+1]"
    return (f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||{variant}"
            f"||substr({h},18,3)||'-'||substr({h},21,12)")
