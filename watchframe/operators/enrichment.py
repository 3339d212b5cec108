"""Threat intelligence: indicators, look-ups, reputation, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions import signatures as sig
from watchframe.functions.net import is_internal, is_ipv4
from watchframe.functions.text import (alert_context, blank_to_null, extract_domains, extract_ips,
                                       or_none)
from watchframe.operators.joins import latest, skewed_lookup

CACHE_SECONDS = 86_400
BATCH_LOOKUP_SIZE = 50


def external_ips(text: Column) -> Column:
    """Addresses of a text without the internal ones."""
    return F.filter(extract_ips(text), lambda ip: ~is_internal(ip))


def is_ip(c: Column) -> Column:
    """IPv4, or IPv6 in full or shortened form."""
    groups = F.filter(F.split(c, ":"), lambda g: g != "")
    tail_v4 = is_ipv4(F.element_at(F.split(c, ":"), -1))
    width = F.size(groups) + tail_v4.cast("int")
    hex_groups = F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$") | is_ipv4(g))
    shortened = F.contains(c, F.lit("::"))
    v6 = (F.contains(c, F.lit(":")) & ~F.contains(c, F.lit(":::")) & hex_groups
          & ((shortened & (width < 8)) | (~shortened & (width == 8)))
          & (F.size(F.split(c, "::")) <= 2) & ~c.rlike("^:[^:]|[^:]:$")
          & ~c.rlike(r"\..*:"))
    return F.coalesce(is_ipv4(c) | v6, F.lit(False))


def alert_indicators(alerts: DataFrame) -> DataFrame:
    """Alerts with ``ips`` (external only) and ``domains`` of their texts."""
    text = alert_context(F.col("process_name"), F.col("description"), F.col("process_path"))
    return alerts.withColumn("_text", text).withColumns(
        {"ips": external_ips(F.col("_text")), "domains": extract_domains(F.col("_text"))}).drop("_text")


def osint_lookup(keys: DataFrame, reports: DataFrame, source: str, now: Column) -> DataFrame:
    """``keys`` (column ``query``) with ``data`` of the newest unexpired report, or null."""
    valid = reports.where((F.col("source") == source) & (F.col("cached_until") >= now))
    newest = latest(valid.select("query", "created_at", "id", "data"), ["query"], ["created_at", "id"])
    return skewed_lookup(keys, newest.select("query", "data"), "query")


def domain_reports(keys: DataFrame, reports: DataFrame) -> DataFrame:
    """``keys`` with ``data`` of any report on the domain; the lowest id is taken."""
    first = reports.groupBy("query").agg(F.min_by("data", "id").alias("data"))
    return skewed_lookup(keys, first, "query")


def save_osint(data: DataFrame, now: Column, ttl_seconds: int | None = None) -> DataFrame:
    """Rows to append to the report table, valid for ``ttl_seconds`` from ``now``."""
    ttl = ttl_seconds or CACHE_SECONDS
    return data.withColumns({
        "created_at": now,
        "cached_until": F.timestamp_micros(F.unix_micros(now) + ttl * 1_000_000)})


def verdict_ratio(malicious: Column, total: Column) -> Column:
    """Share of malicious votes; a missing or zero total counts as one."""
    votes = F.coalesce(F.nullif(total, F.lit(0)), F.lit(1))
    return F.coalesce(malicious, F.lit(0)).cast("double") / votes


def ip_label(ratio: Column) -> Column:
    return F.when(ratio > 0.3, "malicious").when(ratio > 0.1, "suspicious").otherwise("known")


def ip_confidence(ratio: Column) -> Column:
    return (ratio * 100).cast("int")


def merge_reputation_auto(stored: DataFrame, votes: DataFrame, now: Column, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Reputation table after provider votes (ip_address, malicious, total, details, ts).

    Label and details are those of the newest vote by ``order`` (of equal ones the worst ratio, then
    the greatest details), the confidence never falls.
    """
    ratio = verdict_ratio(F.col("malicious"), F.col("total"))
    newest = F.max_by(F.struct("_ratio", "details"), F.struct(*order, "_ratio", "details"))
    new = votes.withColumn("_ratio", ratio).groupBy("ip_address").agg(
        newest.alias("_new"), F.max(ip_confidence(F.col("_ratio"))).alias("_confidence")).select(
        "ip_address", ip_label(F.col("_new._ratio")).alias("_label"), "_confidence", F.col("_new.details").alias("_details"))
    return stored.join(new, "ip_address", "full_outer").select(
        "ip_address", F.coalesce("_label", "label").alias("label"),
        F.greatest("confidence", "_confidence").alias("confidence"),
        F.when(F.col("_label").isNotNull(), "auto_osint").otherwise(F.col("source")).alias("source"),
        F.when(F.col("_label").isNotNull(), F.col("_details")).otherwise(F.col("details")).alias("details"),
        F.when(F.col("_label").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"))


def valid_reputation(entries: DataFrame) -> Column:
    return F.coalesce(F.col("label").isin(sig.REPUTATION_LABELS) & F.col("confidence").between(0, 100)
                      & is_ip(F.col("ip_address")), F.lit(False))


def analyst_confidence(label: Column) -> Column:
    return F.when(label == "malicious", 90).when(label == "suspicious", 65).otherwise(40)


def merge_reputation_manual(stored: DataFrame, entries: DataFrame, now: Column, order: tuple[str, ...] = ("ts",)
                            ) -> tuple[DataFrame, DataFrame]:
    """(table with entries written over it, rejected entries).

    Entries hold ip_address, label, confidence (default 50), source (default
    manual), details and ``ts``; the last per address by ``order`` wins, of equal ones the one with
    the greatest confidence, then label, source and details.
    """
    filled = entries.withColumns({"confidence": F.coalesce("confidence", F.lit(50)),
                                  "source": F.coalesce("source", F.lit("manual"))})
    last = latest(filled.where(valid_reputation(filled)), ["ip_address"],
                  [*order, "confidence", "label", "source", "details"])
    new = last.select("ip_address", F.struct("label", "confidence", "source", "details").alias("_n"))
    old = stored.select("ip_address", F.struct("label", "confidence", "source", "details").alias("_o"),
                        "updated_at")
    merged = old.join(new, "ip_address", "full_outer").select(
        "ip_address", F.coalesce("_n", "_o").alias("_r"),
        F.when(F.col("_n").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"))
    return merged.select("ip_address", "_r.*", "updated_at"), filled.where(~valid_reputation(filled))


def list_reputation(stored: DataFrame, label: str | None = None, limit: int = 250) -> DataFrame:
    rows = stored if label is None else stored.where(F.col("label") == label)
    return rows.orderBy(F.desc("updated_at"), "ip_address").limit(limit)


def unenriched_alerts(alerts: DataFrame, reports: DataFrame, limit: int = 10) -> DataFrame:
    """Newest alerts without an auto-generated report."""
    done = reports.where(F.col("is_auto_generated")).select(F.col("alert_id").alias("id"))
    return (alerts.join(done, "id", "left_anti")
            .orderBy(F.desc("timestamp"), F.desc("id")).limit(limit))


def threat_reports(alerts: DataFrame, reports: DataFrame, now: Column,
                   analyses: DataFrame | None = None) -> DataFrame:
    """One report per alert that has intelligence or an analysis.

    ``analyses`` holds alert_id, summary, confidence, recommended_actions and
    detailed_analysis; without one the default texts are used.
    """
    iocs = alert_indicators(alerts).select(F.col("id").alias("alert_id"), "ips", "domains")
    ip_rows = osint_lookup(iocs.select("alert_id", F.explode("ips").alias("query")), reports, "ip", now)
    name_rows = domain_reports(iocs.select("alert_id", F.explode("domains").alias("query")), reports)
    found = ip_rows.unionByName(name_rows).where(F.col("data").isNotNull())
    intel = found.groupBy("alert_id").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("query", "data")))).alias("osint_data"))
    if analyses is None:
        rows = intel.withColumns({"summary": F.lit(None).cast("string"),
                                  "confidence": F.lit(None).cast("string"),
                                  "recommended_actions": F.lit(None).cast("array<string>"),
                                  "detailed_analysis": F.lit(None).cast("string")})
    else:
        rows = intel.join(analyses, "alert_id", "full_outer")
    return rows.select(
        "alert_id", F.coalesce("summary", F.lit("No analysis generated")).alias("summary"),
        F.coalesce("confidence", F.lit("medium")).alias("confidence"),
        F.coalesce("recommended_actions", F.array().cast("array<string>")).alias("recommended_actions"),
        "osint_data", F.col("detailed_analysis").alias("ai_analysis"),
        F.lit(True).alias("is_auto_generated"), now.alias("created_at"))


REPORT_SCHEMA = ("summary string, confidence string, recommended_actions array<string>, "
                 "detailed_analysis string")


def parse_model_report(alerts: DataFrame, text: str = "answer") -> DataFrame:
    """Analysis columns from a model's free text: the JSON between first { and last }.

    Without valid JSON a fallback from the alert itself is used.
    """
    body = blank_to_null(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    fallback = F.struct(
        F.concat(F.lit("Alert: "), F.substring(or_none(F.col("description")), 1, 100)).alias("summary"),
        F.lit("medium").alias("confidence"),
        F.array(F.concat(F.lit("Investigate process "), or_none(F.col("process_name")),
                         F.lit(" on host"))).alias("recommended_actions"),
        blank_to_null(F.substring(text, 1, 500)).alias("detailed_analysis"))
    parsed = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, REPORT_SCHEMA))
    return (alerts.withColumn("_r", F.coalesce(parsed, fallback))
            .select("*", "_r.*").drop("_r"))


def batch_ip_lookup(ips: DataFrame, reports: DataFrame, now: Column,
                    size: int = BATCH_LOOKUP_SIZE) -> DataFrame:
    """The first ``size`` addresses (by ``position``): error, cached data or pending."""
    batch = ips.orderBy("position").limit(size).select("position", F.col("ip").alias("query"))
    found = osint_lookup(batch, reports, "ip", now)
    ok = is_ip(F.col("query"))
    return found.select(
        "position", F.col("query").alias("ip"),
        F.when(~ok, "error").when(F.col("data").isNotNull(), "cached").otherwise("pending").alias("status"),
        F.when(~ok, "Invalid IP").alias("error"), F.when(ok, F.col("data")).alias("data"))


def osint_history(reports: DataFrame, limit: int = 10) -> DataFrame:
    return (reports.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
            .select("query", "source", "created_at", "cached_until"))


def _unknown(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("Unknown"))


def project_host_scan(payload: Column) -> Column:
    """Host-scan provider JSON -> isp, org, country, city."""
    p = F.from_json(payload, "isp string, org string, country_name string, city string")
    return F.struct(_unknown(p["isp"]).alias("isp"), _unknown(p["org"]).alias("org"),
                    _unknown(p["country_name"]).alias("country"), _unknown(p["city"]).alias("city"))


def project_abuse(payload: Column) -> Column:
    """Abuse-report provider JSON -> score, number of reports, last report."""
    p = F.from_json(payload, "data struct<abuseConfidenceScore:int,totalReports:int,lastReportedAt:string>")
    d = p["data"]
    return F.struct(F.coalesce(d["abuseConfidenceScore"], F.lit(0)).alias("abuseConfidenceScore"),
                    F.coalesce(d["totalReports"], F.lit(0)).alias("totalReports"),
                    F.coalesce(d["lastReportedAt"], F.lit("N/A")).alias("lastReportedAt"))


def project_votes(payload: Column) -> Column:
    """Vote provider JSON -> the four counts, reputation, country and owner."""
    counts = "malicious:int,suspicious:int,harmless:int,undetected:int"
    p = F.from_json(payload, f"data struct<attributes:struct<last_analysis_stats:struct<{counts}>,"
                             "reputation:int,country:string,as_owner:string>>")
    a = p["data"]["attributes"]
    votes = [F.coalesce(a["last_analysis_stats"][c], F.lit(0)).alias(c)
             for c in ("malicious", "suspicious", "harmless", "undetected")]
    return F.struct(*votes, F.coalesce(a["reputation"], F.lit(0)).alias("reputation"),
                    F.coalesce(a["country"], F.lit("")).alias("country"),
                    F.coalesce(a["as_owner"], F.lit("")).alias("as_owner"))


def combine_sources(payloads: DataFrame, fetched_at: Column) -> DataFrame:
    """One record per target from its landed payload columns."""
    return payloads.select(
        "target", fetched_at.alias("fetched_at"),
        F.struct(project_host_scan(F.col("host_scan")).alias("host_scan"),
                 project_abuse(F.col("abuse")).alias("abuse"),
                 project_votes(F.col("votes")).alias("votes")).alias("sources"))
