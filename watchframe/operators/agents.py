"""Agent registry and host snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions.text import blank_to_null


def _reported(reports: DataFrame) -> DataFrame:
    fields = {c: blank_to_null(F.col(c)) for c in ("hostname", "ip_address", "os_type", "agent_type")
              if c in reports.columns}
    rows = reports.withColumns(fields)
    # per field the newest filled value, combined before the shuffle
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id")))
    return rows.groupBy("agent_id").agg(*[last(c).alias(f"_{c}") for c in fields],
                                        F.max("ts").alias("_seen"))


def upsert_agents(agents: DataFrame, reports: DataFrame, default_type: str = "metrics") -> DataFrame:
    """Agent table after host reports (agent_id, ts, event_id, hostname, ip_address, os_type).

    Unknown agents are inserted.  When the new (hostname, os) already belongs
    to another agent, only last_seen and address of the known agent change, and
    an unknown agent is not inserted.
    """
    new = _reported(reports)
    if "_agent_type" not in new.columns:
        new = new.withColumn("_agent_type", F.lit(None).cast("string"))
    joined = agents.join(new, "agent_id", "full_outer").withColumns({
        "_known": F.col("last_seen").isNotNull() | F.col("agent_type").isNotNull(),
        "_host": F.coalesce("_hostname", "hostname"), "_os": F.coalesce("_os_type", "os_type")})
    changed = (~F.col("_known") | ~F.col("_host").eqNullSafe(F.col("hostname"))
               | ~F.col("_os").eqNullSafe(F.col("os_type")))
    joined = joined.withColumn("_claims", changed & F.col("_host").isNotNull() & F.col("_os").isNotNull())
    # a name is taken by its present owner, else by the smallest claiming agent
    claims = joined.where("_claims").groupBy("_host", "_os").agg(F.min("agent_id").alias("_winner"))
    owners = (agents.where(F.col("hostname").isNotNull() & F.col("os_type").isNotNull())
              .select(F.col("hostname").alias("_host"), F.col("os_type").alias("_os"),
                      F.lit(True).alias("_owned")).distinct())
    rows = joined.join(claims, ["_host", "_os"], "left").join(owners, ["_host", "_os"], "left")
    conflict = F.col("_claims") & (F.coalesce("_owned", F.lit(False))
                                   | (F.col("_winner") != F.col("agent_id")))
    conflict = F.coalesce(conflict, F.lit(False))
    return rows.where(F.col("_known") | ~conflict).select(
        "agent_id", F.when(conflict, F.col("hostname")).otherwise(F.col("_host")).alias("hostname"),
        F.coalesce("_ip_address", "ip_address").alias("ip_address"),
        F.when(conflict, F.col("os_type")).otherwise(F.col("_os")).alias("os_type"),
        F.coalesce("agent_type", "_agent_type", F.lit(default_type)).alias("agent_type"),
        F.coalesce("_seen", "last_seen").alias("last_seen"))


def touch_agents(agents: DataFrame, events: DataFrame) -> DataFrame:
    """Queue route: known agents get last_seen, host name and address; none are added."""
    new = _reported(events.select("agent_id", "ts", "event_id", "hostname", "ip_address"))
    return agents.join(new, "agent_id", "left").withColumns({
        "hostname": F.coalesce("_hostname", "hostname"),
        "ip_address": F.coalesce("_ip_address", "ip_address"),
        "last_seen": F.coalesce("_seen", "last_seen")}).drop("_hostname", "_ip_address", "_seen")


def register(agents: DataFrame, requests: DataFrame, new_status: str = "registered") -> DataFrame:
    """Enrolment requests (hostname, os_type, agent_id) with their status.

    A (hostname, os) that is in the registry keeps its agent id: re-enrolled.
    Of several requests of a new one the smallest agent id registers, the others
    are re-enrolled under it.
    """
    known = agents.groupBy("hostname", "os_type").agg(F.min("agent_id").alias("_old"))
    first = requests.groupBy("hostname", "os_type").agg(F.min("agent_id").alias("_first"))
    told = requests.join(first.join(known, ["hostname", "os_type"], "left"), ["hostname", "os_type"], "left")
    fresh = F.col("_old").isNull() & F.coalesce(F.col("agent_id") == F.col("_first"), F.lit(True))
    return told.select(
        "hostname", "os_type", F.coalesce("_old", "_first", "agent_id").alias("agent_id"),
        F.when(fresh, new_status).otherwise("re-enrolled").alias("status"))


def resolve_parent_names(snapshots: DataFrame) -> DataFrame:
    """Processes with the name of their parent inside the same (host, ts) snapshot."""
    parents = snapshots.groupBy("host", "ts", F.col("pid").alias("parent_pid")).agg(
        F.max("process_name").alias("_parent"))
    return snapshots.join(parents, ["host", "ts", "parent_pid"], "left").withColumn(
        "parent_process_name", F.coalesce("_parent", F.lit("unknown"))).drop("_parent")


def top_processes(processes: Column, size: int = 10) -> Column:
    """The busiest processes by cpu, values rounded to one digit, missing ones 0."""
    cpu = lambda p: F.coalesce(p["cpu_percent"], F.lit(0.0))
    ranked = F.transform(processes, lambda p, i: F.struct((-cpu(p)).alias("_k"), i.alias("_i"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(ranked), 1, size), lambda r: F.struct(
        F.coalesce(blank_to_null(r["p"]["name"]), F.lit("unknown")).alias("name"),
        r["p"]["pid"].alias("pid"), F.round(cpu(r["p"]), 1).alias("cpu_percent"),
        F.round(F.coalesce(r["p"]["memory_percent"], F.lit(0.0)), 1).alias("memory_percent")))


def established_flows(flows: Column, size: int = 50) -> Column:
    """Established flows that have a remote end, the first 50."""
    keep = lambda f: F.coalesce((f["status"] == "ESTABLISHED") & (f["raddr"] != ""), F.lit(False))
    return F.slice(F.filter(flows, keep), 1, size)


def derived_metrics(raw: DataFrame) -> DataFrame:
    """Ram usage in percent from total and available; disk bytes to MiB."""
    mib = lambda c: F.floor(F.col(c) / (1024 * 1024))
    total = F.col("ram_total")
    return raw.withColumns({
        "ram_usage": (total - F.col("ram_available")) / total * 100,
        "disk_free": mib("disk_free_bytes"), "disk_total": mib("disk_total_bytes")})

