"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "watchframe", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; below the warehouse where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_progress"
    return folder
