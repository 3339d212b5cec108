"""Static and custom rules on single events."""

import json

import pytest
from watchframe import schemas as S
from watchframe.functions import signatures as sig
from watchframe.functions.conditions import is_valid_pattern, load_rules
from watchframe.operators import detection as D

SCHEMA = ("event_id bigint, agent_id string, ts timestamp, event_type string, hostname string, ip_address string, "
          "pid bigint, parent_pid bigint, parent_process_name string, process_name string, process_path string, "
          "user string, thread_count int, message string, "
          f"network_connections array<{S.CONNECTION}>")


def events(spark, rows):
    """Events from dicts; common values filled in."""
    base = dict(agent_id="test-agent", event_type="PROCESS_CREATED", user="test-user", hostname="h", ip_address="1.1.1.1")
    names = [f.strip().split(" ")[0] for f in SCHEMA.split(", ")]
    data = [tuple({**base, "event_id": i, **r}.get(n) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def conn(remote, state="ESTABLISHED"):
    return [("tcp", "10.0.0.9:5000", remote, state)]


P = lambda **k: k
CASES = {
    "Known Attack Tool": (
        [P(process_name=n) for n in ("mimikatz.exe", "lockbit.exe", "conti.exe", "lazagne.exe", "redline.exe",
                                     "cobalt_strike", "sliver-server.exe", "  NMAP.EXE ", "nmap.com")],
        [P(process_name=n) for n in ("chrome.exe", "keRanger", "", None)]),
    "Suspicious Execution Path": (
        [P(process_path=p) for p in (r"C:\Users\test\AppData\Local\Temp\mal.exe", r"C:\Users\test\Desktop\mal.exe",
                                     "/home/*/.cache/x")],
        [P(process_path=p) for p in (r"C:\Program Files\Google\Chrome\chrome.exe", "/home/bob/.cache/x", "", None)]),
    "Script Interpreter Abuse": ([P(process_name=n) for n in ("powershell.exe", "python3", "bash")],
                                 [P(process_name="chrome.exe")]),
    "Privilege Escalation": ([P(process_name="chrome.exe", user="SYSTEM"), P(process_name="notepad.exe", user=" root ")],
                             [P(process_name="chrome.exe"), P(process_name="chrome.exe", user=None)]),
    "Double Extension": ([P(process_name="invoice.pdf.exe"), P(process_name="document.doc.ps1")],
                         [P(process_name="chrome.exe")]),
    "Encoded Command": ([P(process_path="powershell -enc SQBFAFgAIABOAEUAVwAtAE8AQgBKAEUAQwBUAA==")],
                        [P(process_path="powershell -NoProfile -Command Get-Process")]),
    "Network Tool in Suspicious Path": ([P(process_name="nmap.exe", process_path=r"C:\temp\nmap.exe")],
                                        [P(process_name="nmap.exe", process_path=r"C:\Program Files\Nmap\nmap.exe")]),
    "Suspicious Parent-Child": (
        [P(parent_process_name=p, process_name=c) for p, c in (
            ("WINWORD.EXE", "powershell.exe"), ("acrord32.exe", "powershell.exe"), ("outlook.exe", "wscript.exe"),
            ("chrome.exe", "cmd.exe"), ("explorer.exe", "rundll32.exe"), ("winword.exe", "flashtool"))],
        [P(parent_process_name=p, process_name=c) for p, c in (
            ("System", "svchost.exe"), ("explorer.exe", "chrome.exe"), (None, "cmd.exe"), ("", "cmd.exe"))]),
    "Malware Family": ([P(process_name=n) for n in ("lockbit", "trojan", "ransomware", "keylogger", "miner",
                                                    "tro.exejan")],
                       [P(process_name="chrome.exe")]),
    "Persistence Path": ([P(process_path=r"C:\ProgramData\Microsoft\Windows\Start Menu\Programs\Startup\mal.exe"),
                          P(process_path="/etc/cron.d/mal")],
                         [P(process_path=r"C:\Program Files\chrome.exe"), P(process_path="/Library/LaunchAgents/x")]),
    "DLL Hijacking": ([P(process_path=r"C:\Temp\evil.dll")],
                      [P(process_path=r"C:\temp\evil.exe"), P(process_path=r"C:\Windows\System32\win32u.dll")]),
    "LOLBin Abuse": ([P(process_name="rundll32.exe", process_path=r"C:\temp\rundll32.exe"),
                      P(process_name="powershell.exe", process_path=r"C:\temp\powershell.exe")],
                     [P(process_name="rundll32.exe", process_path=r"C:\Windows\System32\rundll32.exe"),
                      P(process_name="rundll32.exe")]),
    "High Thread Count": ([P(thread_count=300)], [P(thread_count=45), P(thread_count=200), P()]),
    "Network Beacon": ([P(network_connections=conn("185.234.72.18:443")), P(network_connections=conn("[::1]:443"))],
                       [P(network_connections=conn("10.0.0.1:443")), P(network_connections=conn("noport")),
                        P(network_connections=conn("8.8.8.8:53", "TIME_WAIT")), P(network_connections=conn(":443")), P()]),
    "Persistence Autorun": ([P(process_name="svch0st.exe"), P(process_name="winupdate.exe")],
                            [P(process_name="chrome.exe")]),
}


@pytest.mark.parametrize("rule", CASES)
def test_static_rule(spark, rule):
    good, bad = CASES[rule]
    hit = {r.event_id for r in D.rule_hits(events(spark, good + bad), rule).collect()}
    assert hit == set(range(len(good)))


def test_signature_sizes():
    assert len(sig.attack_tools()) == 293
    assert len(sig.STATIC_RULES) == 15 and len(sig.PARENT_CHILD_GROUPS) >= 7
    assert len(sig.MALWARE_FAMILIES) == 18 and len(sig.SUSPICIOUS_PATHS) == 27
    assert len(set(sig.SCRIPT_INTERPRETERS)) == 41 and len(sig.LOLBINS) == 45
    assert len(sig.NETWORK_TOOLS) == 49 and len(sig.DESKTOP_APPS) == 23


def test_rule_catalog(spark):
    rows = D.rule_catalog(spark).orderBy("position").collect()
    assert [r.name for r in rows] == [r[0] for r in sig.STATIC_RULES]


def test_worst_match(spark):
    rows = [P(process_name="mimikatz.exe"), P(process_name="powershell.exe", parent_process_name="WINWORD.EXE"),
            P(process_name="rundll32.exe", process_path=r"C:\temp\rundll32.exe"),
            P(process_name="chrome.exe", thread_count=300),
            P(process_name="chrome.exe", parent_process_name="explorer.exe", thread_count=45),
            P(process_name="Update.exe ", process_path=r"C:\temp\update.exe", thread_count=900),
            P(process_name="mimikatz.exe", event_type="METRICS_REPORT")]
    found = {r.event_id: r for r in D.worst_match_alerts(events(spark, rows)).collect()}
    assert {k: v.severity for k, v in found.items()} == {0: "CRITICAL", 1: "CRITICAL", 2: "HIGH", 3: "MEDIUM"}
    # equal severities: the earliest rule wins
    assert found[2].rule == "Suspicious Execution Path" and found[2].rule_count == 3


def test_tactic_texts(spark):
    row = D.rule_hits(events(spark, [P(process_name="lockbit")]), "Malware Family").first()
    assert (row.tactic, row.technique, row.technique_id) == ("Tactic 0040", "Impact", "T1486")
    row = D.rule_hits(events(spark, [P(process_path=r"C:\temp\x")]), "Suspicious Execution Path").first()
    assert row.description == r"Process 'None' executing from suspicious path: 'C:\temp\x'."


def rules(spark, *defs):
    names = [c.strip().split(" ")[0] for c in S.CUSTOM_RULES.split(",")]
    rows = []
    for i, d in enumerate(defs, 1):
        r = dict(id=i, name=f"r{i}", target_field="process_name", pattern="x", severity="HIGH", is_active=True)
        r.update(d)
        for k in ("conditions", "whitelist"):
            r[k] = json.dumps(r[k]) if k in r else None
        rows.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(rows, S.CUSTOM_RULES)


def test_empty_condition_lists_and_missing_fields(spark):
    table = rules(spark, {"conditions": {"logic": "and", "conditions": []}},
                  {"conditions": {"logic": "or", "conditions": []}},
                  {"conditions": {"conditions": [{"target_field": "nope", "operator": "not_equals", "pattern": "x"}]}},
                  {"conditions": {"conditions": [{"target_field": "PROCESS_NAME", "operator": "equals", "pattern": "A"}]}},
                  {"pattern": "("}, {"conditions": {"conditions": [{"target_field": "process_name", "pattern": "["}]}})
    hits = {r.rule_id for r in D.custom_rule_matches(events(spark, [P(process_name="a")]), table).collect()}
    assert hits == {1, 4}


def test_patterns(spark):
    assert is_valid_pattern(spark, r"(?P<n>a)+") and is_valid_pattern(spark, "a|b")
    assert not is_valid_pattern(spark, "(") and not is_valid_pattern(spark, None)
    assert [r["pattern_ok"] for r in load_rules(rules(spark, {"pattern": "*"}, {"pattern": "ok"}))] == [False, True]


def test_whitelist(spark):
    table = rules(spark, {"pattern": ".", "whitelist": {"hostnames": ["h"]}}, {"pattern": ".", "whitelist": {"ips": ["9.9.9.9"]}},
                  {"pattern": ".", "whitelist": ["h"]})
    hits = {r.rule_id for r in D.custom_rule_matches(events(spark, [P(process_name="a")]), table).collect()}
    assert hits == {2, 3}


def test_process_list_first_hit(spark):
    schema = f"report_id bigint, agent_id string, ts timestamp, processes array<{S.PROCESS}>"
    proc = lambda **k: tuple(k.get(n) for n in ("name", "process_name", "path", "process_path", "pid") + (None,) * 9)
    rows = [(1, "a", None, [proc(name="zero"), proc(process_name="Alpha"), proc(name="alpine")]), (2, "a", None, []),
            (3, "a", None, None), (4, "a", None, [proc(path="/opt/alpha")])]
    t = spark.createDataFrame(rows, schema)
    table = rules(spark, {"pattern": "^alp", "severity": "medium"}, {"pattern": "opt", "target_field": "process_path"},
                  {"pattern": ".", "target_field": "user"})
    got = {(r.report_id, r.rule_id): (r.process_name, r.severity) for r in D.process_list_rule_alerts(t, table).collect()}
    assert got == {(1, 1): ("Alpha", "MEDIUM"), (4, 2): ("Unknown", "HIGH")}


def test_no_cartesian_product_for_rules(spark, sf):
    from watchframe.plans import adapters as A
    from watchframe.plans import controls as K
    plan = D.match_all_rules(A.sec_events(spark, sf), K.custom_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_rule_table_changes(spark):
    table = rules(spark, {}, {})
    bad = rules(spark, {"severity": "SEVERE"})
    stored, refused = D.create_rule(table, bad)
    assert stored.count() == 2 and refused.count() == 1
    changed = D.update_rule(table, 1, {"severity": "LOW", "unknown": 1}).where("id = 1").first()
    assert changed.severity == "LOW"
    assert [r.id for r in D.delete_rule(table, 1).collect()] == [2]
