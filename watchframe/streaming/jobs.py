"""Streaming jobs: alert pipeline per micro-batch, running counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchframe.operators.dashboard import minutes_before, unresolved
from watchframe.operators.detection import worst_match_alerts
from watchframe.sources.events import replace_alerts, validate_events


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
        trigger: dict | None = None) -> StreamingQuery:
    """Write a stream to Parquet; by default process what is there and stop."""
    return (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def alert_job(events: DataFrame, rules: Callable[[], DataFrame], alerts_path: str,
              quarantine_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Valid events to alerts, rejected ones to quarantine; rules are re-read per micro-batch.

    Each micro-batch owns a folder ``batch=<id>`` of either table and replaces
    it, so one that is run again adds no rows.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read once for both tables
        try:
            valid, rejected = validate_events(batch)
            rejected.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
            alerts = worst_match_alerts(valid.withColumnRenamed("timestamp", "ts"), rules())
            replace_alerts(alerts, f"{alerts_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def live_counters(alerts: DataFrame) -> DataFrame:
    """Running alert counters of an alert stream (complete mode)."""
    open_, level = unresolved(), F.upper("severity")
    return alerts.groupBy().agg(
        F.count("*").alias("total_alerts"), F.count_if(open_).alias("unresolved_alerts"),
        *[F.count_if(open_ & (level == name)).alias(f"current_{name.lower()}_alerts")
          for name in ("CRITICAL", "HIGH", "MEDIUM")])


def agent_counts(agents: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """One row: active agents that are real, and demo ones."""
    active = F.col("last_seen") >= minutes_before(now, minutes)
    return agents.agg(F.count_if(active & ~F.col("is_demo")).alias("active_agents"),
                      F.count_if(active & F.col("is_demo")).alias("demo_agents"))


def overview_job(alerts: DataFrame, agents: Callable[[], DataFrame], now: Callable[[], Column],
                 sink: Callable[[DataFrame], None], checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """The overview after every micro-batch of an alert stream.

    The alert counters are running ones, kept as streaming state; only the agent
    table is read at each trigger.
    """
    def each(batch: DataFrame, _batch_id: int) -> None:
        active, demo = agent_counts(agents(), now()).first()
        sink(batch.withColumns({"active_agents": F.lit(active), "demo_agents": F.lit(demo)}))

    return (live_counters(alerts).writeStream.outputMode("complete").foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "500 milliseconds"})).start())
