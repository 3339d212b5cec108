"""Host-side text files: vendor prefixes, socket tables, ARP tables, file hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.functions.text import strip
from watchframe.operators.joins import latest


def parse_oui(lines: DataFrame) -> DataFrame:
    """(line_no, value) lines of a tab-separated prefix file; the last entry wins."""
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (strip(F.col("value")) != "")
                       & (F.size(parts) >= 2)).select(
        F.substring(F.upper(F.replace(strip(parts.getItem(0)), F.lit(":"), F.lit(""))), 1, 6).alias("prefix"),
        strip(parts.getItem(1)).alias("vendor"), "line_no")
    return latest(rows, ["prefix"], ["line_no"]).drop("line_no")


def read_oui(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return parse_oui(lines)


SOCKET_FORMATS = ("linux", "windows", "macos")


def _connection(proto, local, remote, state, pid) -> Column:
    return F.struct(pid.alias("pid"), F.struct(
        proto.alias("proto"), local.alias("local"), remote.alias("remote"),
        state.alias("state")).alias("conn"))


def socket_line(line: Column, os: Column) -> Column:
    """One line of a socket listing as struct(pid, conn), null for other lines."""
    parts = F.split(strip(line), r"\s+")
    at = lambda i: F.get(parts, F.lit(i))
    last = F.element_at(parts, -1)
    number = lambda c: F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
    linux_pid = F.regexp_extract(last, r"pid=(\d+)", 1).try_cast("bigint")
    linux = F.when(
        (F.size(parts) >= 5) & ~strip(line).rlike("^(State|Netid)") & linux_pid.isNotNull(),
        _connection(at(0), at(3), at(4), at(1), linux_pid))
    windows = F.when((F.size(parts) >= 5) & (number(last) > 0),
                     _connection(at(0), at(1), at(2), at(3), number(last)))
    # the listing gives one address field only, used for both ends
    macos = F.when(
        (F.size(parts) >= 9) & (at(0) != "COMMAND") & (number(at(1)) > 0),
        _connection(F.element_at(parts, -4), at(8),
                    F.when(F.size(parts) >= 10, at(8)).otherwise(""), at(9), number(at(1))))
    return F.when(os == "linux", linux).when(os == "windows", windows).when(os == "macos", macos)


def socket_rows(lines: DataFrame) -> DataFrame:
    """Lines of socket listings (os, line, ...) with ``pid`` and ``conn``; other lines drop out."""
    found = F.explode(F.array_compact(F.array(socket_line(F.col("line"), F.lower("os")))))
    return lines.withColumn("_s", found).select(
        *[c for c in lines.columns if c not in ("os", "line")], "_s.pid", "_s.conn")


def parse_socket_table(lines: DataFrame) -> DataFrame:
    """Listings of (host, ts) with their line_no to one row per process with its connections.

    One listing bounds the array; use :func:`socket_rows` for the flat form.
    """
    listed = F.sort_array(F.collect_list(F.struct("line_no", "conn")))
    return socket_rows(lines).groupBy("host", "ts", "pid").agg(
        F.transform(listed, lambda x: x["conn"]).alias("network_connections"))


def parse_arp_table(lines: DataFrame) -> DataFrame:
    """(host, os, line) rows of an ARP listing to (host, ip_address, mac_address)."""
    parts = F.split(strip(F.col("line")), r"\s+")
    mac = F.when(F.lower("os") == "windows",
                 F.regexp_replace(F.get(parts, F.lit(1)), "-", ":")).otherwise(F.get(parts, F.lit(2)))
    return (lines.select("host", parts.getItem(0).alias("ip_address"), mac.alias("mac_address"))
            .where(F.col("ip_address").rlike(r"^\d+\.\d+\.\d+\.\d+")
                   & (F.size(F.split("mac_address", ":")) == 6)
                   & (F.col("mac_address") != "00:00:00:00:00:00"))
            .withColumn("mac_address", F.upper("mac_address")))


def content_hash(content: Column) -> Column:
    """SHA-256 in hex; empty for missing content."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file below a path; empty for a file that cannot be read.

    Files are listed without their content, then read in parts by the tasks, so
    a file may have any size.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
              .select("path", "length"))

    def read(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                total = hashlib.sha256()
                try:
                    store, inner = fs.FileSystem.from_uri(name if "://" in name else re.sub("^file:/+", "file:///", name))
                    with store.open_input_stream(inner) as f:
                        while part := f.read(1 << 22):
                            total.update(part)
                    found.append(total.hexdigest())
                except OSError:
                    found.append("")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["path", "length", "sha256"])

    return listed.mapInArrow(read, "path string, length bigint, sha256 string")


def with_file_hashes(events: DataFrame, hashes: DataFrame) -> DataFrame:
    """Events with the hash of their process path; '' where there is none."""
    found = hashes.select(F.col("path").alias("process_path"), F.col("sha256").alias("_h"))
    return events.join(found, "process_path", "left").withColumn(
        "file_hash", F.coalesce("_h", F.lit(""))).drop("_h")
