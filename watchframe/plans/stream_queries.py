"""Checked queries that run as streams over whole tables.

Each drains the table with an available-now trigger, keeps its progress and
results in the shared checkpoint folder, and returns the results as a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.operators.correlation import agent_last_seen
from watchframe.plans import adapters as A
from watchframe.plans.oracle import with_
from watchframe.plans import time_queries  # noqa: F401  (its SQL is used below)
from watchframe.plans.registry import ORACLES, query
from watchframe.session import checkpoint_folder
from watchframe.sources.events import read_events, route, stream_events
from watchframe.streaming import stateful
from watchframe.streaming.jobs import live_counters, run


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = A.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def _drain(spark: SparkSession, running: DataFrame, name: str) -> DataFrame:
    """All updates of a running aggregate, in the order of ``_batch``."""
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/out")

    job = (running.writeStream.outputMode("update").foreachBatch(keep)
           .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("a10_stream_intake", with_("sec") + """SELECT event_type, CASE WHEN event_type='PROCESS_CREATED' THEN 'security'
  WHEN event_type IN ('METRICS_REPORT','AGENT_HEARTBEAT') THEN 'telemetry' END AS branch, count(*) AS events FROM sec GROUP BY ALL""")
def _(spark, d):
    events = A.from_events(_stream(spark, d, "events"))
    counts = events.groupBy("event_type", route(F.col("event_type")).alias("branch")).agg(F.count("*").alias("n"))
    updates = _drain(spark, counts, "intake")
    return updates.groupBy("event_type", "branch").agg(F.max_by("n", "_batch").alias("events"))


@query("d13_agent_last_seen_stream", with_("sec") + "SELECT agent_id, max(ts_us) AS last_seen FROM sec GROUP BY agent_id")
def _(spark, d):
    updates = _drain(spark, agent_last_seen(A.from_events(_stream(spark, d, "events"))), "last-seen")
    return updates.groupBy("agent_id").agg(F.max_by("last_seen", "_batch").alias("last_seen"))


@query("d14_live_counters_stream", with_("alerts") + """SELECT count(*) AS total_alerts,
  count(*) FILTER (WHERE is_resolved IS NOT true) AS unresolved_alerts,
  count(*) FILTER (WHERE is_resolved IS NOT true AND upper(severity)='CRITICAL') AS current_critical_alerts,
  count(*) FILTER (WHERE is_resolved IS NOT true AND upper(severity)='HIGH') AS current_high_alerts,
  count(*) FILTER (WHERE is_resolved IS NOT true AND upper(severity)='MEDIUM') AS current_medium_alerts FROM alerts""")
def _(spark, d):
    alerts = A.alerts_from(A.from_events(_stream(spark, d, "events")))
    updates = _drain(spark, live_counters(alerts), "live")
    names = [c for c in updates.columns if c != "_batch"]
    return updates.agg(*[F.max_by(c, "_batch").alias(c) for c in names])


# ---------------------------------------------------------------- ordered detections

def _landed(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """All events as files of a new folder, and one last row of each kind that moves the watermark."""
    rows = A.sec_conns(spark, sf_dir)
    last = rows.limit(1).withColumns({
        "ts": F.timestamp_micros(F.lit(A.EPOCH_US + 10**11)), "agent_id": F.lit("end"),
        "event_type": F.explode(F.array(F.lit("PROCESS_CREATED"), F.lit("SYSLOG_NETWORK"))),
        "event_id": F.lit(-1).cast("bigint"), "parent_process_name": F.lit("x"), "message": F.lit("failed password")})
    rows.repartition(3, "event_id").write.parquet(f"{folder}/in")
    last.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in"


def _drained(job, path: str) -> str:
    job.awaitTermination()
    return path


def _found(spark: SparkSession, sf_dir: str, name: str, detect) -> DataFrame:
    """Results of a streaming detection over the landed events."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"
    landed = _landed(spark, sf_dir, folder)
    events = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    return spark.read.parquet(_drained(run(detect(events), f"{folder}/out", f"{folder}/progress"), f"{folder}/out"))


def _same_as(batch: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({ORACLES[batch]})"


@query("d01_brute_force_stream", _same_as("d01_brute_force_alerts", "agent_id, event_id, attempts"))
def _(spark, d):
    found = _found(spark, d, "d01", lambda e: stateful.brute_force_stream(e, "10 minutes"))
    return found.where("agent_id != 'end'").select("agent_id", "event_id", "attempts")


@query("d03_lineage_stream", _same_as("d03_lineage_escalation_short", "agent_id, event_id"))
def _(spark, d):
    found = _found(spark, d, "d03", lambda e: stateful.lineage_stream(e, "10 minutes", 30))
    return found.where("agent_id != 'end'").select("agent_id", "event_id")


@query("d04_beacon_stream", _same_as("d04_beacon_alerts", "agent_id, event_id, samples, ports"))
def _(spark, d):
    found = _found(spark, d, "d04", lambda e: stateful.beacon_stream(e.withColumn("pid", F.lit(None).cast("bigint")), "10 minutes"))
    return found.where("agent_id != 'end'").select("agent_id", "event_id", "samples", "ports")


@query("d10_request_quota_stream", _same_as("d10_request_quota", "user_id, event_id, request_number, allowed"))
def _(spark, d):
    number = F.coalesce(F.regexp_extract("agent_id", r"(\d+)$", 1).try_cast("bigint"), F.lit(-1))
    found = _found(spark, d, "d10", lambda e: stateful.quota_stream(e.withColumn("user_id", number), delay="10 minutes", limit=10))
    return (found.withColumn("user_id", F.col("user_id").cast("bigint")).where("user_id >= 0")
            .select("user_id", "event_id", "request_number", "allowed"))


_SHORT = (time_queries._METRICS.replace("BETWEEN 60 PRECEDING", "BETWEEN 20 PRECEDING")
          .replace("n>=60", "n>=20").replace(">4.0", ">3.0"))


@query("d06_zscore_stream", with_("sec", more=_SHORT) + """SELECT agent_id, metric, event_id,
  CASE WHEN z>4.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM z""")
def _(spark, d):
    found = _found(spark, d, "d06", lambda e: stateful.zscore_stream(e, "10 minutes", 20, 3.0, 20))
    return found.where("agent_id != 'end'").select("agent_id", "metric", "event_id", "severity")


@query("d11_new_processes_stream", ORACLES["d11_new_processes"])
def _(spark, d):
    slot = F.timestamp_micros(F.call_function("div", F.unix_micros("ts"), F.lit(20_000_000)) * 20_000_000)
    found = _found(spark, d, "d11", lambda e: stateful.new_processes_stream(e.select(
        F.col("hostname").alias("host"), slot.alias("ts"), (F.col("event_id") % 50).alias("pid")), "10 minutes"))
    return found.where(F.col("ts") < F.timestamp_micros(F.lit(A.EPOCH_US + 10**10))).distinct()


# ---------------------------------------------------------------- JSON intake

def _json(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines in both key styles, and one line that is no JSON."""
    folder = f"{checkpoint_folder(spark)}/json-{uuid.uuid4()}"
    e = A.sec_events(spark, sf_dir).withColumn("timestamp", F.col("ts"))
    snake = e.where("event_id % 2 = 0").select("agent_id", "timestamp", "event_type", "hostname", "pid", "process_name", "event_id")
    camel = e.where("event_id % 2 = 1").select(
        F.col("agent_id").alias("agentId"), "timestamp", F.col("event_type").alias("eventType"), "hostname", "pid",
        F.col("process_name").alias("processName"), F.col("event_id").alias("eventId"))
    snake.write.json(f"{folder}/in")
    camel.write.mode("append").json(f"{folder}/in")
    spark.createDataFrame([('{"agent_id": "x", broken',)], "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
    return folder


_INTAKE = with_("sec") + """SELECT agent_id, ts_us//1000*1000 AS "timestamp", event_type, hostname, pid, process_name, event_id, true AS ok FROM sec
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, false"""


def _taken_in(rows: DataFrame) -> DataFrame:
    """JSON keeps times to the millisecond."""
    return rows.select("agent_id", F.date_trunc("millisecond", "timestamp").alias("timestamp"), "event_type", "hostname", "pid", "process_name", "event_id",
                       F.col("_corrupt_record").isNull().alias("ok"))


@query("a01_read_events", _INTAKE)
def _(spark, d):
    return _taken_in(read_events(spark, _json(spark, d) + "/in"))


@query("a10_stream_events", _INTAKE)
def _(spark, d):
    folder = _json(spark, d)
    events = stream_events(spark, f"{folder}/in", files_per_trigger=2)
    return _taken_in(spark.read.parquet(_drained(run(events, f"{folder}/out", f"{folder}/progress"), f"{folder}/out")))
