"""Operator 8, URL filters [native]: host-suffix and path-prefix expressions against rule hashes.

Each distinct URL is expanded into the suffixes of its host at dots times the prefixes of its
path of the lengths that rules have.  The expressions are joined with the rules on four bytes
of their SHA-256, the whole digests are compared, and of the rules left the longest wins (as
text; ties: the longer host, then block).  Functions of Spark only.

A null URL, or one without ``://``, has an empty host and path.  A URL without a rule gets the
default verdict.  Rows that repeat keep their number; no rules or no pages are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.llm.common import unused, written

#: Rules up to this number are broadcast; beyond it the join shuffles on the hash prefix.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the rules see them."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), path


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with host, path, rule and verdict; ``rules``: host, path, verdict.

    Columns of the pages with these names are replaced.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = written(rules.withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256))
                    .withColumn("short", _short(F.col("r_digest"))), "url-rules")
    number = rules.count()
    # distinct lengths of rule paths: as many integers as the longest path has letters at most
    lengths = [r[0] for r in rules.select(F.length("r_path")).where("r_path IS NOT NULL").distinct().collect()]
    host, path = url_parts(F.col(f"`{url}`"))
    urls = pages.select(F.col(f"`{url}`").alias("_url")).where("_url IS NOT NULL").distinct()
    host_, path_ = url_parts(F.col("_url"))
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_path"))
    prefixes = F.transform(fits, lambda n: F.substring(F.col("_path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    parts = (urls.select("_url", host_.alias("_host"), path_.alias("_path"))
             .select("_url", F.explode(expressions).alias("e"))
             .select("_url", F.sha2("e", 256).alias("digest")).withColumn("short", _short(F.col("digest"))))
    found = parts.join(F.broadcast(rules) if number <= BROADCAST_RULES else rules, "short").where("digest = r_digest")
    rule = F.concat("r_host", "r_path")
    order = F.struct(F.length(rule), F.length("r_host"), F.col("r_verdict") == "block", rule)
    best = found.groupBy("_url").agg(F.max_by(F.struct(rule.alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("_best"))
    key, won = unused(pages, "_url"), unused(pages, "_best")
    best = written(best.toDF(key, won), "url-verdicts")
    joined = pages.join(best, F.col(f"`{url}`") == F.col(key), "left")
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return joined.select(*keep, host.alias("host"), path.alias("path"), F.col(f"{won}.rule").alias("rule"),
                         F.coalesce(f"{won}.verdict", F.lit(default)).alias("verdict"))
