"""Rule evaluation: events in, alerts out. Every step is a projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.functions import signatures as sig
from watchframe.functions.conditions import (custom_test, custom_text, load_rules,
                                             single_field_match)
from watchframe.functions.patterns import java_pattern
from watchframe.functions.rules import (MATCH_FIELDS, RULE_NAMES, drop_rule_columns, fired,
                                        fired_weight, is_allowed_updater, match_fields,
                                        severity_weight, with_rule_flags)
from watchframe.functions.text import blank_to_null

SEVERITIES = list(sig.SEVERITY_WEIGHT)


def rule_catalog(spark: SparkSession) -> DataFrame:
    """The static rules as a table, in evaluation order."""
    rows = [(i, *rule) for i, rule in enumerate(sig.STATIC_RULES, 1)]
    return spark.createDataFrame(
        rows, "position int, name string, severity string, tactic_id string, tactic string, "
              "technique string, technique_id string, description string")


def _matches(*candidates: Column) -> Column:
    return F.filter(F.array(*candidates), lambda m: m.isNotNull())


def _positions(tests: list[Column]) -> Column:
    """Array of the positions whose test holds."""
    return F.array_remove(F.array(*[F.when(t, F.lit(i)).otherwise(F.lit(-1))
                                    for i, t in enumerate(tests)]), F.lit(-1))


def rule_hits(events: DataFrame, rule: str) -> DataFrame:
    """Events on which one static rule fires, with its match fields."""
    at = RULE_NAMES.index(rule)
    df = with_rule_flags(events, [rule])
    once = F.when(fired(at), F.array(F.lit(at)))
    df = df.withColumn("_pos", F.explode(once))
    return drop_rule_columns(
        df.select("*", *match_fields(F.col("_pos"), events.columns, [rule])).drop("_pos"))


def match_all_rules(events: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per event and triggered rule.

    Custom rules take part by their single field only, as in a rule try-out.
    """
    columns = events.columns
    custom = load_rules(rules) if rules is not None else []
    tests = [fired(i) for i in range(len(RULE_NAMES))] + [single_field_match(r, columns) for r in custom]
    texts = [F.lit(f"[CUSTOM: {r['name']}] Match on {r['target_field']}") for r in custom]
    df = with_rule_flags(events).withColumn("rule_position", F.explode(_positions(tests)))
    return drop_rule_columns(df.select(
        "*", *match_fields(F.col("rule_position"), columns, custom=custom, custom_text=texts)))


def _alert_columns(df: DataFrame, fields: list[Column]) -> DataFrame:
    f = dict(zip(MATCH_FIELDS, fields))
    return df.select(
        "agent_id", F.col("ts").alias("timestamp"), "event_id", f["severity"].alias("severity"),
        "pid", "parent_pid", "parent_process_name",
        F.coalesce(blank_to_null(F.col("process_name")), F.lit("unknown")).alias("process_name"),
        "process_path", "event_type", f["rule"].alias("rule"),
        f["description"].alias("description"),
        f["tactic_id"].alias("mitre_tactic_id"), f["tactic"].alias("mitre_tactic_name"),
        f["technique_id"].alias("mitre_technique_id"), f["technique"].alias("mitre_technique_name"),
        *[c for c in ("rule_count", "auto_remediation", "remediation_target") if c in df.columns])


def _explode_known(position: Column) -> Column:
    """One row for a position, none for null.

    Unlike a filter this is not pushed below the projection, where it would
    repeat every rule test.
    """
    return F.explode(F.when(position.isNotNull(), F.array(position)))


def first_match_alerts(events: DataFrame) -> DataFrame:
    """Direct route: process starts, first static rule that fires."""
    starts = events.where(F.col("event_type") == "PROCESS_CREATED")
    first = F.coalesce(*[F.when(fired(i), F.lit(i)) for i in range(len(RULE_NAMES))])
    df = with_rule_flags(starts).withColumn("_pos", _explode_known(first))
    alerts = _alert_columns(df, match_fields(F.col("_pos"), events.columns))
    return alerts.withColumn(
        "mitre_tactic_id", coalesce_names(F.col("mitre_tactic_id"), F.col("mitre_tactic_name")))


def coalesce_names(first: Column, second: Column) -> Column:
    """The id when there is one, else the name."""
    return F.coalesce(blank_to_null(first), second)


def worst_match_alerts(events: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Queue route: process starts, allow-list, all rules, worst severity.

    Equal severities go to the earliest rule; static rules come before custom
    ones. ``auto_remediation`` is the action of the last matching custom rule
    that has one.
    """
    columns = events.columns
    starts = events.where((F.col("event_type") == "PROCESS_CREATED")
                          & ~is_allowed_updater(F.col("process_name")))
    custom = load_rules(rules) if rules is not None else []
    static = len(RULE_NAMES)
    df = with_rule_flags(starts).withColumns(
        {f"_c{i}": custom_test(r, columns) for i, r in enumerate(custom)})
    tests = [fired(i) for i in range(static)] + [F.col(f"_c{i}") for i in range(len(custom))]
    weights = [fired_weight(i) for i in range(static)] + [
        F.lit(severity_weight(r["severity"])) for r in custom]
    # one number per rule: severity first, then the earlier position
    span = len(tests)
    ranks = [F.when(t, w * span + (span - 1 - i)) for i, (t, w) in enumerate(zip(tests, weights))]
    actions = [F.when(F.col(f"_c{i}"), F.lit(r["auto_remediation"]))
               for i, r in enumerate(custom) if r.get("auto_remediation")]
    df = df.withColumn("_rank", _explode_known(F.greatest(*ranks))).withColumns({
        "_pos": span - 1 - F.col("_rank") % span,
        "rule_count": sum((t.cast("int") for t in tests[1:]), tests[0].cast("int")),
        "auto_remediation": F.coalesce(*actions[::-1], F.lit(None).cast("string")),
        "remediation_target": F.coalesce(
            blank_to_null(F.col("process_name")),
            blank_to_null(F.col("ip_address")) if "ip_address" in columns else F.lit(None),
            F.lit("unknown")),
    })
    fields = match_fields(F.col("_pos"), columns, custom=custom,
                          custom_text=[custom_text(r, columns) for r in custom])
    return _alert_columns(df, fields).drop("mitre_tactic_id")


def process_list_rule_alerts(telemetry: DataFrame, rules: DataFrame,
                             keys: tuple[str, ...] = ("agent_id", "ts", "report_id")) -> DataFrame:
    """Custom rules on the process list of a report: first hit per report and rule.

    Needs ``processes`` as an array of structs with any of name, process_name,
    path, process_path. Only the single-field pattern of a rule is used.
    """
    fields = {f.name for f in telemetry.schema["processes"].dataType.elementType.fields}

    def pick(p: Column, *names: str) -> Column:
        return F.coalesce(*[blank_to_null(p[n]) for n in names if n in fields], F.lit(""))

    lit = lambda v: F.lit(v).cast("string")

    def describe(rule: dict):
        sources = ("name", "process_name") if rule["target_field"] == "process_name" \
            else ("path", "process_path")

        def test(p: Column) -> Column:
            value = pick(p, *sources)
            return (value != "") & value.rlike(java_pattern(rule["pattern"]))

        def on(p: Column) -> Column:
            value = pick(p, *sources)
            name = F.coalesce(blank_to_null(pick(p, "name", "process_name")), F.lit("Unknown"))
            return F.struct(
                F.lit(rule["id"]).cast("bigint").alias("rule_id"),
                lit((rule["severity"] or "").upper()).alias("severity"),
                name.alias("process_name"),
                F.concat(lit(f"Rule '{rule['name']}' matched: {rule['target_field']}='"), value,
                         lit(f"' matched pattern /{rule['pattern']}/")).alias("description"),
                lit(rule.get("mitre_tactic_id") or rule.get("mitre_tactic")).alias("mitre_tactic_id"),
                lit(rule.get("mitre_technique_id") or rule.get("mitre_technique")).alias("mitre_technique_id"),
                lit(rule.get("mitre_tactic")).alias("mitre_tactic_name"),
                lit(rule.get("mitre_technique")).alias("mitre_technique_name"))
        # the first process that passes, and one alert of it
        return F.get(F.transform(F.slice(F.filter("processes", test), 1, 1), on), F.lit(0))

    usable = [r for r in load_rules(rules)
              if r["pattern_ok"] and r["target_field"] in ("process_name", "process_path")]
    hits = [describe(r) for r in usable]
    if not hits:  # no rule finds nothing, with the same columns
        nothing = {"id": 0, "severity": "", "name": "", "target_field": "process_name", "pattern": ""}
        telemetry = telemetry.limit(0)
        hits = [describe(nothing)]
    found = telemetry.withColumn("_m", F.explode(_matches(*hits)))
    return found.select(*keys, "_m.*", F.lit("custom_rule").alias("event_type"))


def custom_rule_matches(events: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per event and matching custom rule: rule_id, event id and time."""
    columns = events.columns
    custom = load_rules(rules)
    if not custom:
        return events.limit(0).select("*", F.lit(0).cast("bigint").alias("rule_id"),
                                      F.lit("").alias("auto_remediation"))
    pick = lambda key, kind: F.get(F.array(*[F.lit(r.get(key)).cast(kind) for r in custom]), F.col("_pos"))
    return (events.withColumn("_pos", F.explode(_positions([custom_test(r, columns) for r in custom])))
            .select("*", pick("id", "bigint").alias("rule_id"),
                    pick("auto_remediation", "string").alias("auto_remediation")).drop("_pos"))


def rule_hit_counters(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """Rule table with trigger_count raised by its hits and last_triggered moved on.

    Rules are tried on process starts outside the allow-list only, so other
    matches are no hits.
    """
    start = F.coalesce(F.col("event_type") == "PROCESS_CREATED", F.lit(False))
    matches = matches.where(start & ~is_allowed_updater(F.col("process_name")))
    hits = matches.groupBy("rule_id").agg(F.count("*").alias("_hits"), F.max("ts").alias("_last"))
    return (rules.join(hits, rules["id"] == hits["rule_id"], "left")
            .withColumns({
                "trigger_count": F.coalesce("trigger_count", F.lit(0)) + F.coalesce("_hits", F.lit(0)),
                "last_triggered": F.coalesce("_last", "last_triggered")})
            .drop("rule_id", "_hits", "_last"))


def auto_remediation_plan(alerts: DataFrame) -> DataFrame:
    """Planned action per alert of :func:`worst_match_alerts` that carries one."""
    return alerts.where(blank_to_null(F.col("auto_remediation")).isNotNull()).select(
        "event_id", "agent_id", F.col("auto_remediation").alias("action"),
        F.col("remediation_target").alias("target"), "pid", F.lit("planned").alias("status"))


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("created_at"), F.desc("id"))


def create_rule(rules: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with the valid new ones, rejected ones with another severity label)."""
    ok = F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False))
    return rules.unionByName(new.where(ok), allowMissingColumns=True), new.where(~ok)


def update_rule(rules: DataFrame, rule_id: int, updates: dict) -> DataFrame:
    """Patch known columns of one rule; unknown names are ignored."""
    types = dict(rules.dtypes)
    return rules.withColumns({
        name: F.when(F.col("id") == rule_id, F.lit(value).cast(types[name])).otherwise(F.col(name))
        for name, value in updates.items() if name in types})


def delete_rule(rules: DataFrame, rule_id: int) -> DataFrame:
    return rules.where(F.col("id") != rule_id)

