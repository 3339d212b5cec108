"""User-written rules compiled to Column expressions.

The rule table is small and written by people, like program text: it is read
once per batch and becomes part of the plan, so that every pattern is a
constant that Spark compiles once per task.  There is no join with the events
and no limit on the number of rules.
"""

from __future__ import annotations

import json
import logging
from functools import reduce
from operator import and_, or_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.functions.patterns import PatternError, java_pattern
from watchframe.functions.text import or_none

log = logging.getLogger(__name__)

TEXT_FIELDS = ["agent_id", "event_type", "hostname", "ip_address", "os", "parent_process_name",
               "process_name", "process_path", "user", "file_hash", "message"]


def pattern_fault(spark: SparkSession, pattern: str | None) -> str | None:
    """Why a pattern is passed over; None if it can be used."""
    if not isinstance(pattern, str):
        return "it is no text"
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except PatternError as error:
        return str(error)
    except Py4JJavaError as error:  # what only Java finds, as a look behind without a bound
        return f"it cannot be expressed: {error.java_exception.getMessage()}"
    return None


def is_valid_pattern(spark: SparkSession, pattern: str | None) -> bool:
    """Whether a pattern can be used; rules with another one are passed over, see :func:`refused_rules`."""
    fault = pattern_fault(spark, pattern)
    if fault:
        log.warning("rule pattern %r skipped: %s", pattern, fault)
    return fault is None


def _parsed(value):
    """A JSON column; None when it cannot be read, as when it is missing."""
    try:
        return json.loads(value) if isinstance(value, str) and value.strip() else value
    except ValueError:
        log.warning("rule column skipped, it is no JSON: %r", value)
        return None


def load_rules(rules: DataFrame) -> list[dict]:
    """Active rules in id order, with JSON columns parsed and patterns checked.

    A rule whose own pattern is bad gets ``pattern_ok = False``; conditions with
    a bad pattern are marked the same way and evaluate to false.
    """
    spark = rules.sparkSession
    out = []
    for row in rules.where(F.col("is_active")).orderBy("id").collect():
        rule = row.asDict(recursive=True)
        for name in ("conditions", "whitelist"):
            rule[name] = _parsed(rule.get(name))
        rule["pattern_ok"] = is_valid_pattern(spark, rule.get("pattern"))
        if isinstance(rule["conditions"], dict):
            for cond in rule["conditions"].get("conditions", []):
                if cond.get("operator", "regex") == "regex":
                    cond["pattern_ok"] = is_valid_pattern(spark, cond.get("pattern", ""))
        out.append(rule)
    return out


def refused_rules(rules: DataFrame) -> DataFrame:
    """Patterns of active rules that are passed over: rule_id, part (pattern or condition number), pattern, reason.

    The other rules, and the other conditions of the same rule, still run.
    """
    spark, out = rules.sparkSession, []
    for row in rules.where(F.col("is_active")).orderBy("id").collect():
        rule = row.asDict(recursive=True)
        tree = _parsed(rule.get("conditions"))
        if tree and isinstance(tree, dict):
            parts = [(f"condition {i}", c.get("pattern", "")) for i, c in enumerate(tree.get("conditions", []), 1)
                     if c.get("operator", "regex") == "regex"]
        else:
            parts = [("pattern", rule.get("pattern"))]
        faults = [(part, pattern, pattern_fault(spark, pattern)) for part, pattern in parts]
        out += [(rule["id"], part, None if pattern is None else str(pattern), fault) for part, pattern, fault in faults if fault]
    return spark.createDataFrame(out, "rule_id bigint, part string, pattern string, reason string")


def _field(name: str, columns: list[str]) -> Column | None:
    for candidate in (name, name.lower()):
        if candidate in TEXT_FIELDS and candidate in columns:
            return F.col(candidate)
    return None


def eval_condition(cond: dict, columns: list[str]) -> Column:
    """One condition; a missing or non-text field is false, also for not_equals."""
    value = _field(cond.get("target_field", ""), columns)
    pattern = cond.get("pattern", "")
    operator = cond.get("operator", "regex")
    if value is None or (operator == "regex" and not cond.get("pattern_ok", True)):
        return F.lit(False)
    if not isinstance(pattern, str):
        return F.lit(False)
    low = F.lit(pattern.lower())
    tests = {
        "regex": lambda: value.rlike(java_pattern(pattern)),
        "equals": lambda: F.lower(value) == low,
        "contains": lambda: F.contains(F.lower(value), low),
        "not_equals": lambda: F.lower(value) != low,
    }
    return F.coalesce(tests[operator](), F.lit(False)) if operator in tests else F.lit(False)


def single_field_match(rule: dict, columns: list[str]) -> Column:
    """Regex on the rule's own target field; an empty value never matches."""
    field = rule.get("target_field") or ""
    if field not in TEXT_FIELDS or field not in columns or not rule["pattern_ok"]:
        return F.lit(False)
    value = F.col(field)
    return F.coalesce((value != "") & value.rlike(java_pattern(rule["pattern"])), F.lit(False))


def passes_whitelist(rule: dict, columns: list[str]) -> Column:
    """False for events of a listed host name or address; no usable list passes all."""
    listed = rule.get("whitelist")
    if not isinstance(listed, dict):
        return F.lit(True)
    tests = [F.coalesce(F.col(field).isin(listed[key]), F.lit(False))
             for field, key in (("hostname", "hostnames"), ("ip_address", "ips"))
             if listed.get(key) and field in columns]
    return ~reduce(or_, tests) if tests else F.lit(True)


def eval_rule(rule: dict, columns: list[str]) -> Column:
    """AND / OR over the condition list, else the single-field match.

    An empty list matches everything under AND and nothing under OR.
    """
    tree = rule.get("conditions")
    if not tree or not isinstance(tree, dict):
        return single_field_match(rule, columns)
    parts = [eval_condition(c, columns) for c in tree.get("conditions", [])]
    if tree.get("logic", "and") == "or":
        return reduce(or_, parts, F.lit(False))
    return reduce(and_, parts, F.lit(True))


def custom_test(rule: dict, columns: list[str]) -> Column:
    return passes_whitelist(rule, columns) & eval_rule(rule, columns)


def custom_text(rule: dict, columns: list[str]) -> Column:
    """Alert text of a custom rule, with the value of its target field."""
    field = rule.get("target_field") or ""
    shown = or_none(F.col(field)) if field in columns else F.lit("")
    return F.concat(F.lit(f"[CUSTOM RULE: {rule['name']}] Match on {field}='"), shown, F.lit("'"))
