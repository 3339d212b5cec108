"""Reading, checking and normalising events; append sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe import schemas as S
from watchframe.functions.ids import agent_uuid
from watchframe.functions.text import blank_to_null, strip


def wide_schema() -> str:
    """Every event field in snake and camel case, plus the raw text of bad records."""
    fields = {}
    for name, (kind, _) in S.EVENT_FIELDS.items():
        fields[name] = kind
        fields[S.camel(name)] = kind
    return ", ".join(f"`{n}` {k}" for n, k in fields.items()) + ", _corrupt_record string"


def canonical(raw: DataFrame) -> DataFrame:
    """One column per field: the snake-case key, else the camel-case one."""
    return raw.select(
        *[(F.coalesce(name, S.camel(name)) if S.camel(name) != name else F.col(name)).alias(name)
          for name in S.EVENT_FIELDS], "_corrupt_record")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with snake-case or camelCase keys."""
    return canonical(spark.read.schema(wide_schema()).json(path))


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream over arriving files."""
    return canonical(spark.readStream.schema(wide_schema())
                     .option("maxFilesPerTrigger", files_per_trigger).json(path))


def rejection_reasons(columns: list[str]) -> Column:
    """Array of reasons why an event is not accepted; empty for a good one."""
    tests = []
    if "_corrupt_record" in columns:
        tests.append((F.col("_corrupt_record").isNotNull(), "not valid JSON"))
    for name in S.REQUIRED:
        if name in columns:
            value = F.col(name)
            missing = value.isNull() if S.EVENT_FIELDS[name][0] != "string" else \
                F.coalesce(strip(value), F.lit("")) == ""
            tests.append((missing, f"{name} is missing"))
    for name, (kind, longest) in S.EVENT_FIELDS.items():
        if longest and name in columns:
            size = F.size(name) if kind.startswith("array") else F.length(name)
            tests.append((size > longest, f"{name} is longer than {longest}"))
    return F.array_compact(F.array(*[F.when(t, F.lit(reason)) for t, reason in tests]))


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected events with ``reasons``)."""
    checked = events.withColumn("reasons", rejection_reasons(events.columns))
    return (checked.where(F.size("reasons") == 0).drop("reasons", "_corrupt_record"),
            checked.where(F.size("reasons") > 0))


def match_sender(events: DataFrame) -> DataFrame:
    return events.where(F.col("sender_id") == F.col("agent_id"))


def route(event_type: Column) -> Column:
    """Branch of an event; correlation sees all events."""
    return (F.when(event_type == "PROCESS_CREATED", "security")
            .when(event_type.isin("METRICS_REPORT", "AGENT_HEARTBEAT"), "telemetry"))


def route_events(events: DataFrame) -> dict[str, DataFrame]:
    kind = route(F.col("event_type"))
    return {"security": events.where(kind == "security"),
            "telemetry": events.where(kind == "telemetry"), "correlation": events}


def normalise_syslog(lines: DataFrame) -> DataFrame:
    """(host, text, ts) lines as events of a network device."""
    host = F.coalesce("host", F.lit("unknown"))
    return lines.select(
        F.concat(F.lit("network-device-"), host).alias("agent_id"), "ts",
        F.lit("SYSLOG_NETWORK").alias("event_type"), host.alias("hostname"),
        F.lit("Network/Appliance").alias("os"), F.lit("syslog").alias("process_name"),
        F.lit("udp").alias("process_path"), F.col("text").alias("message"))


def syslog_rows(lines: DataFrame) -> DataFrame:
    """Rows for the syslog table; facility and severity come from a ``<n>`` prefix."""
    number = F.regexp_extract("text", r"^<(\d{1,3})>", 1).try_cast("int")
    return lines.select(
        F.col("ts").alias("timestamp"), F.floor(number / 8).cast("int").alias("facility"),
        (number % 8).cast("int").alias("severity"),
        F.coalesce("host", F.lit("unknown")).alias("hostname"),
        blank_to_null(F.regexp_extract("text", r"([A-Za-z0-9_./-]+)(\[\d+\])?: ", 1)).alias("app_name"),
        F.col("text").alias("message"))


def normalise_metrics(snapshots: DataFrame) -> DataFrame:
    """Host snapshot as a METRICS_REPORT event."""
    keep = [c for c in ("cpu_usage", "ram_usage", "disk_free", "disk_total", "network_sent",
                        "network_received", "processes", "users", "network_flows", "ip_public",
                        "geo_country", "geo_city") if c in snapshots.columns]
    return snapshots.select(
        F.col("device_id").alias("agent_id"), "ts", F.lit("METRICS_REPORT").alias("event_type"),
        F.col("ip_local").alias("ip_address"), "ip_local", *keep)


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Telemetry rows of metric events that carry cpu or ram usage."""
    rows = events.where((route(F.col("event_type")) == "telemetry")
                        & (F.col("cpu_usage").isNotNull() | F.col("ram_usage").isNotNull()))
    keep = [c for c in ("cpu_usage", "ram_usage", "disk_free", "disk_total", "network_sent",
                        "network_received") if c in events.columns]
    nested = [F.when(F.size("processes") > 0, F.struct(F.col("processes").alias("list"))
                     ).alias("processes")] if "processes" in events.columns else []
    return rows.select(agent_uuid(F.col("agent_id")).alias("device_id"),
                       F.col("ts").alias("timestamp"), *keep, *nested)


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alerts with stored defaults: unresolved, UUID agent, date partition."""
    resolved = F.coalesce("is_resolved", F.lit(False)) if "is_resolved" in alerts.columns else F.lit(False)
    return alerts.withColumns({"agent_id": agent_uuid(F.col("agent_id")), "is_resolved": resolved,
                               "dt": F.to_date("timestamp")})


def append_alerts(alerts: DataFrame, path: str) -> None:
    append_by_date(alert_rows(alerts), path)


def replace_alerts(alerts: DataFrame, path: str) -> None:
    """The alert table at a path of its own, replaced when it is written again."""
    append_by_date(alert_rows(alerts), path, mode="overwrite")


def append_by_date(rows: DataFrame, path: str, writers_per_day: int = 16, mode: str = "append") -> None:
    """Append to Parquet partitioned by ``dt``.

    Rows of a date are spread over several writers, so a busy day is not one file.
    """
    plain = [name for name, kind in rows.dtypes if not kind.startswith(("map", "array", "struct"))]
    spread = rows.withColumn("_spread", F.pmod(F.xxhash64(*plain), F.lit(writers_per_day)))
    (spread.repartition("dt", "_spread").drop("_spread")
     .write.mode(mode).partitionBy("dt").parquet(path))
