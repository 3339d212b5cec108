"""Asset inventory from landed scan results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions.net import ip_in_cidr, is_ip
from watchframe.functions.text import blank_to_null
from watchframe.operators.joins import latest

MAX_SCAN_PORTS = 32


def guess_os(ports: Column, agent_label: str = "agent") -> Column:
    """Operating system hint from open ports; the first group that is open wins."""
    has = lambda *p: F.coalesce(F.arrays_overlap(ports, F.array(*[F.lit(x) for x in p])), F.lit(False))
    return (F.when(has(3389, 445, 135), "windows").when(has(22), "linux")
            .when(has(80, 443, 8080), "network-service").when(has(8000), agent_label)
            .otherwise("unknown"))


def clean_ports(ports: Column) -> Column:
    """Valid port numbers, the first 32."""
    return F.slice(F.filter(ports, lambda p: (p >= 1) & (p <= 65535)), 1, MAX_SCAN_PORTS)


def mac_prefix(mac: Column) -> Column:
    return F.substring(F.upper(F.regexp_replace(mac, "[:-]", "")), 1, 6)


def mac_vendor(hosts: DataFrame, oui: DataFrame) -> DataFrame:
    """Hosts with ``vendor`` from the prefix table; null without a MAC, else Unknown."""
    found = hosts.withColumn("prefix", mac_prefix(F.col("mac_address"))).join(
        oui.select("prefix", F.col("vendor").alias("_v")), "prefix", "left")
    has_mac = blank_to_null(F.col("mac_address")).isNotNull()
    return found.withColumn(
        "vendor", F.when(has_mac, F.coalesce("_v", F.lit("Unknown")))).drop("_v", "prefix")


def upsert_hosts(hosts: DataFrame, scan: DataFrame, now: Column, agent_label: str = "agent") -> DataFrame:
    """Host table after a scan (ip_address, open_ports, hostname, mac_address, vendor, source, ts).

    Rows of one address count in time order (ties by their content): the newest
    host name, MAC with its vendor and guess from open ports stay, ports, status
    and source are those of the last row.  Confidence and first_seen are set on
    insert only, by the first row.
    """
    at = F.struct("ts", F.to_json(F.struct(*sorted(c for c in scan.columns if c != "ts"))))
    has_ports = F.coalesce(F.size("open_ports") > 0, F.lit(False))
    filled = lambda c, test: F.max_by(c, F.when(test, at))
    has_mac = blank_to_null(F.col("mac_address")).isNotNull()
    seen = scan.groupBy("ip_address").agg(
        filled(blank_to_null(F.col("hostname")), blank_to_null(F.col("hostname")).isNotNull()).alias("hostname"),
        filled(blank_to_null(F.col("mac_address")), has_mac).alias("mac_address"),
        filled(F.col("vendor"), has_mac).alias("vendor"),
        filled(guess_os(F.col("open_ports"), agent_label), has_ports).alias("os_guess"),
        F.min_by(has_ports, at).alias("first_open"), F.max_by(has_ports, at).alias("open_now"),
        F.max_by("open_ports", at).alias("open_ports"), F.max_by("source", at).alias("source"))
    seen = seen.select("ip_address", F.struct(*[c for c in seen.columns if c != "ip_address"]).alias("n"))
    joined = hosts.join(seen, "ip_address", "full_outer")
    hit, is_new = F.col("n").isNotNull(), F.col("last_seen").isNull()
    mac = F.col("n.mac_address")
    when = lambda new_value, old: F.when(hit, new_value).otherwise(old)
    return joined.select(
        "ip_address",
        F.coalesce("n.hostname", "hostname").alias("hostname"),
        F.coalesce(mac, "mac_address").alias("mac_address"),
        F.when(mac.isNotNull(), F.col("n.vendor")).otherwise(F.col("vendor")).alias("vendor"),
        when(F.coalesce("n.os_guess", "os_guess", F.lit("unknown")), F.col("os_guess")).alias("os_guess"),
        F.when(hit & is_new, F.when(F.col("n.first_open"), 90).otherwise(10)).otherwise(F.col("os_confidence")
                                                                                     ).alias("os_confidence"),
        when(F.when(F.col("n.open_now"), "reachable").otherwise("unknown"), F.col("status")).alias("status"),
        when(F.coalesce("n.open_ports", F.array().cast("array<int>")), F.col("open_ports")).alias("open_ports"),
        when(F.col("n.source"), F.col("source")).alias("source"),
        F.coalesce("endpoint_status", F.lit("not_deployed")).alias("endpoint_status"),
        F.coalesce("metrics_status", F.lit("not_deployed")).alias("metrics_status"),
        F.coalesce("first_seen", now).alias("first_seen"),
        when(now, F.col("last_seen")).alias("last_seen"))


def sync_agent_status(hosts: DataFrame, agents: DataFrame, now: Column, endpoint_kinds: list[str],
                      metrics_kinds: list[str], active_seconds: int = 600) -> DataFrame:
    """Agent status per host address and agent type, from the newest agent of the type.

    Active within ``active_seconds`` (strictly), deployed when ever seen; hosts
    without such an agent keep their status.
    """
    kind = (F.when(F.col("agent_type").isin(endpoint_kinds), "endpoint")
            .when(F.col("agent_type").isin(metrics_kinds), "metrics"))
    # an agent that was never seen counts, but below every agent that was
    seen = F.coalesce(F.unix_micros("last_seen"), F.lit(-1))
    newest = lambda name: F.max(F.when(F.col("_kind") == name, F.col("_seen")))
    per_ip = (agents.where(F.col("ip_address").isNotNull())
              .withColumns({"_kind": kind, "_seen": seen}).groupBy("ip_address")
              .agg(newest("endpoint").alias("_endpoint"), newest("metrics").alias("_metrics")))
    since = F.unix_micros(now) - active_seconds * 1_000_000

    def status(found: str, old: str) -> Column:
        c = F.col(found)
        return (F.when(c > since, "active").when(c >= 0, "deployed").when(c == -1, "not_deployed")
                .otherwise(F.col(old)))

    return hosts.join(per_ip, "ip_address", "left").withColumns({
        "endpoint_status": status("_endpoint", "endpoint_status"),
        "metrics_status": status("_metrics", "metrics_status")}).drop("_endpoint", "_metrics")


def host_summary_status(endpoint: Column, metrics: Column, endpoint_name: str = "Endpoint",
                        metrics_name: str = "Metrics") -> Column:
    """``active (A + B)`` for the active agents, else deployed / not_deployed."""
    names = F.concat_ws(" + ", F.when(endpoint == "active", endpoint_name),
                        F.when(metrics == "active", metrics_name))
    return (F.when(names != "", F.concat(F.lit("active ("), names, F.lit(")")))
            .when((endpoint == "deployed") | (metrics == "deployed"), "deployed")
            .otherwise("not_deployed"))


def list_hosts(hosts: DataFrame, limit: int = 250) -> DataFrame:
    return hosts.orderBy(F.desc("last_seen"), "ip_address").limit(limit)


def refreshed(hosts: DataFrame, scanned: DataFrame, agents: DataFrame, now: Column,
              endpoint_kinds: list[str], metrics_kinds: list[str]) -> DataFrame:
    """Host table with the agent status of the scanned addresses brought up to date."""
    touched = agents.join(scanned.select("ip_address").distinct(), "ip_address", "left_semi")
    return sync_agent_status(hosts, touched, now, endpoint_kinds, metrics_kinds)


def ingest_scan(hosts: DataFrame, results: DataFrame, now: Column, oui: DataFrame,
                agent_label: str = "agent") -> DataFrame:
    """Scan results of agents: (agent_id, ts, scan_hosts array of structs) into the host table.

    A reported host name or operating system overrides (confidence 80); the
    vendor of a MAC comes from the prefix table ``oui``.
    """
    item = results.select("agent_id", "ts", F.explode("scan_hosts").alias("h")).select(
        F.col("h.ip_address").alias("ip_address"), "h.hostname", "h.mac_address", "h.open_ports",
        F.col("h.os_guess").alias("reported_os"),
        F.concat(F.lit("agent-scan:"), "agent_id").alias("source"), "ts")
    item = mac_vendor(item, oui)
    table = upsert_hosts(hosts, item.drop("reported_os"), now, agent_label)
    reported = item.where(blank_to_null(F.col("reported_os")).isNotNull())
    last = latest(reported.select("ip_address", "reported_os", "ts"), ["ip_address"], ["ts", "reported_os"]).drop("ts")
    return table.join(last, "ip_address", "left").withColumns({
        "os_guess": F.coalesce("reported_os", "os_guess"),
        "os_confidence": F.when(F.col("reported_os").isNotNull(), 80).otherwise(F.col("os_confidence")),
    }).drop("reported_os")


def add_manual_hosts(hosts: DataFrame, entries: DataFrame, now: Column, oui: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosts with those typed in by hand, entries refused for their address).

    ``entries``: ip_address, hostname, mac_address, source, ts; the vendor comes
    from the prefix table ``oui``.
    """
    valid = is_ip(F.col("ip_address"))
    typed = mac_vendor(entries.where(valid), oui).withColumn("open_ports", F.array().cast("array<int>"))
    return upsert_hosts(hosts, typed, now), entries.where(~valid)


def live_hosts(arp: DataFrame, known: DataFrame, responders: DataFrame, cidr: str) -> DataFrame:
    """Addresses taken as live: ARP entries, known ones of the subnet, responders."""
    inside = known.where(ip_in_cidr(F.col("ip_address"), F.lit(cidr)))
    return arp.select("ip_address").union(inside.select("ip_address")).union(
        responders.select("ip_address")).distinct()


def unreachable_hosts(subnet: DataFrame, live: DataFrame) -> DataFrame:
    return subnet.join(live, "ip_address", "left_anti")


def append_new_hosts(current: DataFrame, found: DataFrame) -> DataFrame:
    """Only hosts with a new address are added."""
    return current.unionByName(found.join(current.select("ip_address"), "ip_address", "left_anti"),
                               allowMissingColumns=True)
