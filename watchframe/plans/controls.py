"""Small control tables used by the checked queries, as a user would write them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from watchframe import schemas as S

RULES = [
    dict(id=1, name="transfer tools", target_field="process_name", pattern="curl|wget", severity="HIGH",
         auto_remediation="kill_process", mitre_tactic="Exfiltration", mitre_technique="Transfer",
         mitre_technique_id="T1048"),
    dict(id=2, name="shell off host one", target_field="process_name", pattern="x", severity="CRITICAL",
         conditions={"logic": "and", "conditions": [
             {"target_field": "process_name", "operator": "contains", "pattern": "POWER"},
             {"target_field": "hostname", "operator": "not_equals", "pattern": "HOST-1"}]}),
    dict(id=3, name="root or tmp", target_field="user", pattern="x", severity="MEDIUM",
         auto_remediation="isolate_host", whitelist={"hostnames": ["host-3"]},
         conditions={"logic": "or", "conditions": [
             {"target_field": "user", "operator": "equals", "pattern": "ROOT"},
             {"target_field": "process_path", "operator": "regex", "pattern": "^/TMP"}]}),
    dict(id=4, name="missing field", target_field="nothing", pattern="x", severity="CRITICAL",
         conditions={"conditions": [
             {"target_field": "nothing", "operator": "not_equals", "pattern": "x"}]}),
    dict(id=5, name="match all", target_field="os", pattern="x", severity="LOW",
         conditions={"logic": "and", "conditions": []}),
    dict(id=6, name="bad pattern", target_field="process_name", pattern="(", severity="CRITICAL"),
    dict(id=7, name="switched off", target_field="process_name", pattern=".", severity="CRITICAL",
         is_active=False),
    dict(id=8, name="empty or", target_field="process_name", pattern=".", severity="CRITICAL",
         conditions={"logic": "or", "conditions": []}),
    dict(id=9, name="java by path", target_field="process_path", pattern=r"\\temp\\", severity="low",
         whitelist={"ips": ["10.0.4.5"]}, mitre_tactic="Execution", mitre_technique="Scripting"),
]
_RULE_COLUMNS = [c.strip().split(" ")[0] for c in S.CUSTOM_RULES.split(",")]


def custom_rules(spark: SparkSession) -> DataFrame:
    rows = []
    for rule in RULES:
        r = {"is_active": True, "trigger_count": rule["id"], **rule}
        for name in ("conditions", "whitelist"):
            r[name] = json.dumps(r[name]) if name in r else None
        rows.append(tuple(r.get(c) for c in _RULE_COLUMNS))
    return spark.createDataFrame(rows, S.CUSTOM_RULES)


# id, name, active, severity, event type, process part
PLAYBOOKS = [
    (1, "critical host", True, "CRITICAL", None, None),
    (2, "process start", True, None, "PROCESS_CREATED", None),
    (3, "shell use", True, "high", None, "POWER"),
    (4, "anything", True, "", "", ""),
    (5, "switched off", False, None, None, None),
]
# id, playbook, type, target, params, order
ACTIONS = [
    (1, 1, "isolate_host", None, None, 1),
    (2, 1, "block_ip", "203.0.113.9", None, 0),
    (3, 1, "webhook", "https://example.org/hook", '{"channel": "soc"}', 2),
    (4, 2, "kill_process", None, None, 0),
    (5, 2, "collect_ioc", None, None, 1),
    (6, 2, "verify", None, None, 2),
    (7, 2, "quarantine_binary", None, None, 3),
    (8, 2, "remove_persistence", None, None, 4),
    (9, 3, "eradicate", None, None, 0),
    (10, 3, "kill_process_tree", None, None, 1),
    (11, 3, "block_ip_temporal", "203.0.113.10", '{"duration_seconds": "120"}', 2),
    (12, 3, "dns_sinkhole", "bad.example", None, 3),
    (13, 3, "script", "/opt/clean.sh", None, 4),
    (14, 4, "send_fax", "x", None, 0),
]


def playbooks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLAYBOOKS, S.PLAYBOOKS)


def playbook_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTIONS, S.PLAYBOOK_ACTIONS)
