"""Alert management and the questions of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchframe.functions import signatures as sig
from watchframe.functions.text import ilike_any_part
from watchframe.operators.joins import lookup, skewed_lookup

KILLABLE = ["PROCESS_CREATED", "custom_rule"]


def unresolved() -> Column:
    """A missing flag counts as unresolved."""
    return ~F.coalesce("is_resolved", F.lit(False))


def newest(df: DataFrame, ts: str, limit: int, skip: int = 0, key: str = "id") -> DataFrame:
    """Top rows by time, ties by key, both descending."""
    ordered = df.orderBy(F.desc(ts), F.desc(key))
    return (ordered.offset(skip) if skip else ordered).limit(limit)


def minutes_before(now: Column, minutes: int) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - minutes * 60_000_000)


def list_alerts(alerts: DataFrame, severity: str | None = None, is_resolved: bool | None = False,
                skip: int = 0, limit: int = 200) -> DataFrame:
    """Newest alerts; ``is_resolved`` None means both."""
    rows = alerts if not severity else alerts.where(F.col("severity") == severity)
    if is_resolved is not None:
        rows = rows.where(F.col("is_resolved") if is_resolved else unresolved())
    return newest(rows, "timestamp", limit, skip)


def list_alerts_after(alerts: DataFrame, cursor: tuple | None, severity: str | None = None,
                      is_resolved: bool | None = False, limit: int = 200) -> DataFrame:
    """The page of newest alerts after ``cursor``, the (timestamp, id) of the last row seen; None is the first page.

    The bound on the time reaches the scan, so a table written by time is read only from the
    cursor on, and nothing of earlier pages is sorted again as an offset would.
    """
    rows = alerts
    if cursor is not None:
        at, last = (F.lit(x) for x in cursor)
        rows = rows.where((F.col("timestamp") <= at) & ((F.col("timestamp") < at) | (F.col("id") < last)))
    return list_alerts(rows, severity, is_resolved, limit=limit)


def newest_alerts_of(alerts: DataFrame, reports: DataFrame, size: int = 5) -> DataFrame:
    """The newest ``size`` alerts of each agent that reports, for playbooks and enrichment after a batch.

    Ties by id.  Reporting agents are made distinct before the join, and each task keeps its
    newest rows of an agent before the shuffle, so a busy agent is no hot key.
    """
    reporting = reports.select("agent_id").where(F.col("agent_id").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("timestamp"), F.desc("id")))
    newest_rows = alerts.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")
    return newest_rows.join(reporting, "agent_id", "left_semi").select(*alerts.columns)


def alert_overview(alerts: DataFrame, agents: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Alerts with the host name and the latest telemetry of their agent."""
    sample = [c for c in ("cpu_usage", "ram_usage", "processes", "users", "network_flows")
              if c in telemetry.columns]
    last = telemetry.groupBy(F.col("device_id").alias("agent_id")).agg(
        F.max_by(F.struct(*sample), F.struct("timestamp", "id")).alias("telemetry"))
    named = lookup(alerts, agents.select("agent_id", F.col("hostname").alias("agent_hostname")), "agent_id")
    return skewed_lookup(named, last, "agent_id")


def alert_sections(alerts: DataFrame, reports: DataFrame, remediations: DataFrame) -> DataFrame:
    """Reports and remediations of alerts, one row each: (id, section, at, entry_id, body).

    The long form suits any number of entries per alert.
    """
    def rows(df: DataFrame, ts: str, section: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("alert_id", ts, "id")]
        return df.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi").select(
            F.col("alert_id").alias("id"), F.lit(section).alias("section"), F.col(ts).alias("at"),
            F.col("id").alias("entry_id"), F.to_json(F.struct(*rest)).alias("body"))

    return rows(reports, "created_at", "threat_report").unionByName(
        rows(remediations, "executed_at", "remediation"))


def alert_detail(alerts: DataFrame, agents: DataFrame, telemetry: DataFrame, reports: DataFrame,
                 remediations: DataFrame, alert_id: int) -> tuple[DataFrame, DataFrame]:
    """(overview row, report and remediation rows newest first) of one alert."""
    one = alerts.where(F.col("id") == alert_id)
    sections = alert_sections(one, reports.where(F.col("alert_id") == alert_id),
                              remediations.where(F.col("alert_id") == alert_id))
    return (alert_overview(one, agents, telemetry),
            sections.orderBy("section", F.desc("at"), F.desc("entry_id")))


def resolve_all(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with everything resolved, one row with the number changed)."""
    count = alerts.agg(F.count_if(unresolved()).alias("resolved"))
    return alerts.withColumn("is_resolved", F.lit(True)), count


def delete_all(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return alerts.limit(0), alerts.agg(F.count("*").alias("deleted"))


def resolve_alerts(alerts: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new table, kill commands) for ``changes`` of (id, resolved).

    A kill is queued for newly resolved process alerts that know their pid.  An
    alert named several times is resolved if any of its changes resolves it.
    """
    once = changes.groupBy("id").agg(F.max("resolved").alias("_to"))
    joined = alerts.join(once, "id", "left")
    kill = (unresolved() & F.coalesce("_to", F.lit(False)) & F.col("event_type").isin(KILLABLE)
            & F.coalesce(F.col("pid") != 0, F.lit(False)))
    commands = joined.where(kill).select(
        "agent_id", F.lit("KILL_PROCESS").alias("command"), "pid", "process_name",
        F.col("id").alias("alert_id"))
    table = joined.withColumn("is_resolved", F.coalesce("_to", "is_resolved")).drop("_to")
    return table, commands


def list_agents(agents: DataFrame, now: Column, active_only: bool = False,
                include_demo: bool = False, limit: int = 100, minutes: int = 15) -> DataFrame:
    rows = agents
    if active_only:
        rows = rows.where(F.col("last_seen") >= minutes_before(now, minutes))
    if not include_demo:
        rows = rows.where(~F.col("is_demo"))
    return newest(rows, "last_seen", limit, key="agent_id")


def _with_agent(rows: DataFrame, key: str, agents: DataFrame, *columns: str) -> DataFrame:
    side = agents.select(F.col("agent_id").alias(key), *columns)
    return lookup(rows, side, key, "inner")


def recent_telemetry(telemetry: DataFrame, agents: DataFrame, kinds: list[str],
                     agent_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest reports of agents whose type is in ``kinds``."""
    rows = telemetry if agent_id is None else telemetry.where(F.col("device_id") == agent_id)
    owners = agents.where(F.col("agent_type").isin(kinds))
    return newest(_with_agent(rows, "device_id", owners, "hostname", "agent_type"), "timestamp", limit)


def activity(telemetry: DataFrame, alerts: DataFrame, agents: DataFrame, limit: int = 30) -> DataFrame:
    """Newest reports and alerts of known agents, merged."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    reports = newest(_with_agent(telemetry, "device_id", agents, "hostname"), "timestamp", limit)
    found = newest(_with_agent(alerts, "agent_id", agents, "hostname"), "timestamp", limit)
    rows = reports.select(
        F.lit("telemetry").alias("type"), "id", "timestamp", F.col("device_id").alias("agent_id"),
        "hostname", F.format_string("Telemetry OK: CPU %.1f%% / RAM %.1f%%", zero("cpu_usage"),
                                    zero("ram_usage")).alias("summary"))
    merged = rows.unionByName(found.select(
        F.lit("alert").alias("type"), "id", "timestamp", "agent_id", "hostname", "severity",
        F.col("description").alias("summary")), allowMissingColumns=True)
    return merged.orderBy(F.desc("timestamp"), F.desc("type"), F.desc("id")).limit(limit)


def stats(alerts: DataFrame, agents: DataFrame, now: Column, include_demo: bool = False,
          minutes: int = 15) -> DataFrame:
    """One row of counters; alerts and agents go through a single aggregation."""
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("bigint")
    open_ = unresolved()
    level = F.upper("severity")
    from_alerts = {"total_alerts": F.lit(1).cast("bigint"), "unresolved_alerts": flag(open_)}
    for name in ("CRITICAL", "HIGH", "MEDIUM", "LOW"):
        from_alerts[f"current_{name.lower()}_alerts"] = flag(open_ & (level == name))
    active = F.col("last_seen") >= minutes_before(now, minutes)
    from_agents = {
        "active_agents": flag(active if include_demo else active & ~F.col("is_demo")),
        "demo_agents": flag(active & F.col("is_demo"))}
    rows = alerts.select(*[c.alias(n) for n, c in from_alerts.items()]).unionByName(
        agents.select(*[c.alias(n) for n, c in from_agents.items()]), allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in [*from_alerts, *from_agents]])


def history(telemetry: DataFrame, agent_id: str, limit: int = 50) -> DataFrame:
    return newest(telemetry.where(F.col("device_id") == agent_id), "timestamp", limit)


def list_remediations(remediations: DataFrame, limit: int = 20) -> DataFrame:
    return newest(remediations, "executed_at", limit)


def list_threat_reports(reports: DataFrame, limit: int = 50) -> DataFrame:
    return newest(reports, "created_at", limit)


def threat_level(stats_row: DataFrame) -> DataFrame:
    """Counters with ``level``: CRITICAL, WARNING, ELEVATED, LOW or NORMAL."""
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    high, medium = n("current_high_alerts"), n("current_medium_alerts")
    total = n("unresolved_alerts")
    level = (F.when(n("current_critical_alerts") > 0, "CRITICAL")
             .when((high > 2) | (total > 20), "WARNING")
             .when((high > 0) | (medium > 5) | (total > 5), "ELEVATED")
             .when(total > 0, "LOW").otherwise("NORMAL"))
    return stats_row.withColumn("level", level)


def chart_series(recent: DataFrame, kind: str) -> DataFrame:
    """Points of the load chart: agents of one type (any case) with both metrics."""
    keep = ((F.lower("agent_type") == kind.lower()) & F.col("cpu_usage").isNotNull()
            & F.col("ram_usage").isNotNull())
    return recent.where(keep).select(
        F.unix_millis("timestamp").alias("time"), F.col("cpu_usage").alias("cpu"),
        F.col("ram_usage").alias("ram"), F.coalesce("hostname", "device_id").alias("name")
    ).orderBy("time", "name")


def search_agents(agents: DataFrame, term: str, metrics_kind: str, endpoint_kind: str,
                  show_demo: bool = True) -> DataFrame:
    """Agents whose host name, address or id holds the term, with their group."""
    hit = F.lit(False)
    for c in ("hostname", "ip_address", "agent_id"):
        hit |= F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    rows = agents.where(hit) if show_demo else agents.where(hit & ~F.coalesce("is_demo", F.lit(False)))
    kind = F.col("agent_type")
    return rows.withColumn("agent_group", F.when(kind == metrics_kind, "metrics")
                           .when(kind == endpoint_kind, "endpoint").otherwise("other"))


def last_seen_bucket(ts: Column, now: Column) -> Column:
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000)
    ago = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))
    return (F.when(ts.isNull(), "Never").when(seconds < 60, "Just now")
            .when(seconds < 3600, ago(60, "m")).when(seconds < 86_400, ago(3600, "h"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd")))


def query_syslog(syslog: DataFrame, hostname: str | None = None, severity: int | None = None,
                 skip: int = 0, limit: int = 200) -> DataFrame:
    rows = syslog
    if hostname:
        rows = rows.where(ilike_any_part(F.col("hostname"), hostname))
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    return newest(rows, "timestamp", limit, skip)


def syslog_label(severity: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in sig.SYSLOG_LABELS]), severity)


def audit_rows(changes: DataFrame, action: str, resource: str, details: Column, now: Column,
               resource_id: Column | None = None, username: str | None = None,
               user_id: int | None = None, ip_address: str | None = None) -> DataFrame:
    """One audit entry per row of ``changes``, to be appended to the audit table."""
    rid = F.lit(None).cast("string") if resource_id is None else \
        F.nullif(resource_id.cast("string"), F.lit("0"))
    return changes.select(
        F.lit(user_id).cast("bigint").alias("user_id"), F.lit(username).cast("string").alias("username"),
        F.lit(action).alias("action"), F.lit(resource).alias("resource"), rid.alias("resource_id"),
        F.to_json(details).alias("details"), F.lit(ip_address).cast("string").alias("ip_address"),
        now.alias("created_at"))


def query_audit(audit: DataFrame, action: str | None = None, resource: str | None = None,
                username: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    rows = audit if not action else audit.where(F.col("action") == action)
    for column, part in (("resource", resource), ("username", username)):
        if part:
            rows = rows.where(ilike_any_part(F.col(column), part))
    return newest(rows, "created_at", limit, skip)


def merge_live(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Stored counters with the live ones written over them, per ``key``."""
    fresh = live.select(key, *[F.col(c).alias(f"_{c}") for c in live.columns if c != key])
    joined = stored.join(fresh, key, "left")
    return joined.select(key, *[
        (F.coalesce(f"_{c}", c) if c in live.columns else F.col(c)).alias(c)
        for c in stored.columns if c != key])

