"""Playbooks: which alerts trigger them and what would be done. Nothing is executed.

Playbooks and their actions are small tables written by people; like custom
rules they are read once and become part of the plan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# fixed values: action type -> command sent to the agent
COMMANDS = {
    "block_ip": "BLOCK_IP", "kill_process": "KILL_PROCESS",
    "kill_process_tree": "KILL_PROCESS_TREE", "block_ip_temporal": "BLOCK_IP_TEMPORAL",
    "isolate_host": "ISOLATE_HOST", "quarantine_binary": "QUARANTINE_BINARY",
    "remove_persistence": "REMOVE_PERSISTENCE", "verify": "VERIFY",
    "dns_sinkhole": "DNS_SINKHOLE", "collect_ioc": "COLLECT_IOC",
}
NEEDS_PID = ["kill_process", "kill_process_tree", "quarantine_binary", "verify", "collect_ioc"]
NAMES_PROCESS = ["kill_process", "kill_process_tree", "quarantine_binary", "remove_persistence",
                 "collect_ioc"]
ERADICATION = ["COLLECT_IOC", "QUARANTINE_BINARY", "KILL_PROCESS_TREE", "REMOVE_PERSISTENCE", "VERIFY"]
DEFAULT_BLOCK_SECONDS = 3600


def _triggers(playbook: dict) -> Column:
    test = F.lit(True)
    if playbook.get("trigger_severity"):
        test &= F.upper("severity") == playbook["trigger_severity"].upper()
    if playbook.get("trigger_event_type"):
        test &= F.col("event_type") == playbook["trigger_event_type"]
    if playbook.get("trigger_process_name"):
        name = F.lower(F.coalesce("process_name", F.lit("")))
        test &= F.contains(name, F.lit(playbook["trigger_process_name"].lower()))
    return F.coalesce(test, F.lit(False))


def match_playbooks(alerts: DataFrame, playbooks: DataFrame) -> DataFrame:
    """One row per alert and active playbook it triggers; an empty trigger means any."""
    books = [r.asDict() for r in playbooks.where("is_active").orderBy("id").collect()]
    hits = [F.when(_triggers(b), F.struct(F.lit(b["id"]).cast("bigint").alias("playbook_id"),
                                          F.lit(b["name"]).alias("playbook_name"))) for b in books]
    found = F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else \
        F.array().cast("array<struct<playbook_id:bigint,playbook_name:string>>")
    return alerts.withColumn("_p", F.explode(found)).select("*", "_p.*").drop("_p")


def _has_pid() -> Column:
    return F.coalesce(F.col("pid") != 0, F.lit(False))


def _seconds(params: dict) -> int | None:
    """Duration of a temporary block; None when it is not a number."""
    try:
        return int(params.get("duration_seconds", DEFAULT_BLOCK_SECONDS))
    except (TypeError, ValueError):
        return None


def _command(command: str, action: dict, with_pid: bool, with_name: bool) -> Column:
    """JSON command; null parts are left out."""
    params = action["params"]
    parts = [F.lit(command).alias("command")]
    if command in ("BLOCK_IP", "BLOCK_IP_TEMPORAL"):
        parts.append(F.lit(action["target"]).alias("ip"))
    if command == "BLOCK_IP_TEMPORAL":
        parts.append(F.lit(_seconds(params)).alias("duration_seconds"))
    if command == "DNS_SINKHOLE":
        parts.append(F.lit(action["target"]).alias("domain"))
    if with_pid:
        parts.append(F.col("pid").alias("pid"))
    if with_name:
        parts.append(F.col("process_name").alias("process_name"))
    return F.to_json(F.struct(*parts, F.col("id").alias("alert_id")))


def eradication_chain(action: dict | None = None) -> Column:
    """The five commands of an eradication; without a pid only the pid-free one."""
    action = action or {"target": None, "params": {}}
    steps = []
    for command in ERADICATION:
        needs = command != "REMOVE_PERSISTENCE"
        step = _command(command, action, with_pid=needs, with_name=command != "VERIFY")
        steps.append(F.when(_has_pid(), step) if needs else step)
    return F.array_compact(F.array(*steps))


def _plan(action: dict) -> Column:
    """struct(status, output, commands) of one action for the current alert row."""
    kind = action["action_type"]

    def result(status, output, commands):
        return F.struct(F.lit(status).alias("status"), F.lit(output).alias("output"),
                        commands.alias("commands"))

    none = F.array().cast("array<string>")
    if action["params"] is None:
        return result("failed", "Unreadable parameters", none)
    if kind == "block_ip_temporal" and _seconds(action["params"]) is None:
        return result("failed", "Unreadable duration", none)
    if kind == "eradicate":
        return result("completed", "Eradication chain executed", eradication_chain(action))
    if kind == "webhook":
        fields = {"alert_id": F.col("id"), "severity": F.col("severity"),
                  "process_name": F.col("process_name"), "description": F.col("description")}
        for key, value in action["params"].items():
            fields[key] = F.lit(json.dumps(value) if isinstance(value, (dict, list)) else value)
        body = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
        return result("planned", f"POST {action['target']}", F.array(body))
    if kind == "script":
        return result("planned", f"RUN {action['target']}", none)
    if kind not in COMMANDS:
        return result("failed", f"Unknown action type: {kind}", none)
    command = COMMANDS[kind]
    queued = result("completed", f"Command queued: {command}", F.array(
        _command(command, action, with_pid=kind in NEEDS_PID, with_name=kind in NAMES_PROCESS)))
    if kind in NEEDS_PID:
        return F.when(_has_pid(), queued).otherwise(result("failed", "No PID available", none))
    return queued


def _action_fields(action: dict) -> list[Column]:
    return [F.lit(action["id"]).cast("bigint").alias("action_id"), F.lit(action["order"]).cast("int").alias("order"),
            F.lit(action["action_type"]).alias("action"), F.lit(action["target"]).cast("string").alias("target")]


def _params(text: str | None) -> dict | None:
    """Parameters of an action; None when they cannot be read."""
    try:
        found = json.loads(text) if text else {}
        return found if isinstance(found, dict) else None
    except ValueError:
        return None


def load_actions(actions: DataFrame) -> list[dict]:
    out = []
    for row in actions.orderBy("playbook_id", "order", "id").collect():
        action = row.asDict()
        action["params"] = _params(action.get("params"))
        out.append(action)
    return out


def plan_actions(matches: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per match and action of its playbook, in action order."""
    planned = [F.when(F.col("playbook_id") == a["playbook_id"], F.struct(*_action_fields(a), _plan(a).alias("r")))
               for a in load_actions(actions)]
    if not planned:  # playbooks without actions plan nothing
        nothing = {"id": 0, "playbook_id": 0, "order": 0, "action_type": "", "target": None, "params": {}}
        return plan_rows(matches.limit(0), [F.struct(*_action_fields(nothing), _plan(nothing).alias("r"))])
    return plan_rows(matches, planned)


def plan_rows(matches: DataFrame, planned: list[Column]) -> DataFrame:
    rows = matches.withColumn("_a", F.explode(F.filter(F.array(*planned), lambda a: a.isNotNull())))
    return rows.select(
        F.col("id").alias("alert_id"), "agent_id", "playbook_id", "playbook_name", "pid",
        "process_name", "_a.action_id", "_a.order", "_a.action", "_a.target", "_a.r.status",
        "_a.r.output", "_a.r.commands")


def commands_of(plan: DataFrame) -> DataFrame:
    """One row per command an agent would fetch."""
    return plan.select("alert_id", "agent_id", "playbook_id", "action_id",
                       F.posexplode("commands").alias("step", "command"))


def remediation_rows(plan: DataFrame) -> DataFrame:
    return plan.select("alert_id", "agent_id", "action", "target", "status",
                       F.col("output").alias("details"))


def execution_rows(matches: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per alert and playbook with its ordered action results.

    ``plan`` is the action table, whose results are constants per playbook and
    pid: they are listed in the projection, without a shuffle.
    """
    kind = "array<struct<status:string,output:string>>"
    by_book: dict[int, list[Column]] = {}
    for a in load_actions(plan):
        made = _plan(a)
        by_book.setdefault(a["playbook_id"], []).append(F.struct(made["status"].alias("status"), made["output"].alias("output")))
    listed = F.lit(None).cast(kind)
    for book, results in by_book.items():
        listed = F.when(F.col("playbook_id") == book, F.array(*results)).otherwise(listed)
    return matches.select(F.col("id").alias("alert_id"), "playbook_id",
                          F.coalesce(listed, F.array().cast(kind)).alias("actions"), F.lit("completed").alias("status"))


def list_playbooks(playbooks: DataFrame, actions: DataFrame) -> DataFrame:
    nested = actions.groupBy("playbook_id").agg(F.sort_array(F.collect_list(
        F.struct("order", "id", "action_type", "target", "params"))).alias("actions"))
    return (playbooks.join(nested, playbooks["id"] == nested["playbook_id"], "left")
            .drop("playbook_id").orderBy("name", "id"))


def create_playbooks(playbooks: DataFrame, actions: DataFrame, new: DataFrame
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(playbooks, actions, refused): a name in use is refused.

    Of several new playbooks of one name the smallest id is stored.

    ``new`` holds the playbook columns and ``actions``, an array of structs
    (action_type, target, params, order); an order of 0 or null becomes the
    list position.
    """
    first = new.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_id"))
    taken = playbooks.select(F.col("name").alias("_taken")).distinct()
    told = new.join(first, F.col("name").eqNullSafe(F.col("_name")), "left").join(
        taken, F.col("name") == F.col("_taken"), "left")
    stored = F.col("_taken").isNull() & (F.col("id") == F.col("_id"))
    refused, fresh = told.where(~stored).select(new.columns), told.where(stored).select(new.columns)
    order = F.coalesce(F.nullif(F.col("_a.order"), F.lit(0)), F.col("_i"))
    rows = (fresh.select(F.col("id").alias("playbook_id"), F.posexplode("actions").alias("_i", "_a"))
            .select("playbook_id", "_a.action_type", "_a.target", "_a.params", order.alias("order")))
    return (playbooks.unionByName(fresh.drop("actions"), allowMissingColumns=True),
            actions.unionByName(rows, allowMissingColumns=True), refused)


def update_playbook(playbooks: DataFrame, playbook_id: int, changes: dict) -> DataFrame:
    """Changed columns of one playbook; None leaves a column as it is."""
    types = dict(playbooks.dtypes)
    return playbooks.withColumns({
        c: F.when(F.col("id") == playbook_id, F.lit(v).cast(types[c])).otherwise(F.col(c))
        for c, v in changes.items() if v is not None and c in types and c != "id"})


def delete_playbook(playbooks: DataFrame, actions: DataFrame, playbook_id: int
                    ) -> tuple[DataFrame, DataFrame]:
    """Both tables without the playbook and its actions."""
    return (playbooks.where(F.col("id") != playbook_id),
            actions.where(F.col("playbook_id") != playbook_id))


def list_executions(executions: DataFrame, limit: int = 50) -> DataFrame:
    return executions.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def temporary_blocks(blocks: DataFrame, now: Column) -> DataFrame:
    """Temporary address blocks still in force: duration from ``params``, else one hour."""
    seconds = F.coalesce(F.get_json_object("params", "$.duration_seconds").try_cast("int"),
                         F.lit(DEFAULT_BLOCK_SECONDS))
    expires = F.timestamp_micros(F.unix_micros("planned_at") + seconds.cast("bigint") * 1_000_000)
    return (blocks.withColumns({"duration_seconds": seconds, "expires_at": expires})
            .where(F.col("expires_at") > now))
