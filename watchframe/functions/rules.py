"""The fifteen static rules as Column expressions.

Evaluation goes through narrow columns so that generated code stays small:

1. :func:`with_rule_inputs` lower-cases names and paths once per row;
2. :func:`with_rule_flags` turns each rule into one boolean, and the two rules
   with variants into the number of the variant that matched;
3. callers pick rule positions (plain integers) and explode them, which keeps
   later filters from repeating the tests;
4. :func:`match_fields` looks up severity, text and technique of a position.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.functions import signatures as sig
from watchframe.functions.net import established_public
from watchframe.functions.text import contains_any, equals_any_part, matches_any, or_none, strip

MATCH_FIELDS = ["rule", "severity", "description", "tactic_id", "tactic", "technique",
                "technique_id"]
RULE_NAMES = [r[0] for r in sig.STATIC_RULES]
LINEAGE, FAMILY = RULE_NAMES.index("Suspicious Parent-Child"), RULE_NAMES.index("Malware Family")

_INPUTS = ["_name", "_bare", "_stem", "_lower_name", "_path", "_bad_path", "_parent", "_public"]
_FLAGS = [f"_r{i}" for i in range(len(RULE_NAMES))]


def _without(c: Column, *parts: str) -> Column:
    return reduce(lambda acc, part: F.replace(acc, F.lit(part), F.lit("")), parts, c)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def with_rule_inputs(events: DataFrame) -> DataFrame:
    """Add the lower-cased columns the rules share; null marks a missing field."""
    have = set(events.columns)
    col = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    if "network_connections" in have:
        public = F.transform(established_public(F.col("network_connections")), lambda c: c["remote"])
    else:
        public = F.lit(None).cast("array<string>")
    df = events.withColumns({
        "_name": F.when(col("process_name") != "", strip(F.lower(col("process_name")))),
        "_lower_name": F.lower(col("process_name")),
        "_path": F.when(col("process_path") != "", F.lower(col("process_path"))),
        "_parent": F.when(col("parent_process_name") != "",
                          strip(F.lower(col("parent_process_name")))),
        "_public": public,
    })
    return df.withColumns({
        "_bare": _without(F.col("_name"), ".exe", ".com", ".dll"),
        "_stem": _without(F.col("_name"), ".exe", ".dll", ".bat", ".ps1"),
        "_bad_path": contains_any(F.col("_path"), sig.SUSPICIOUS_PATHS),
    })


def _variant(tests: list[Column]) -> Column:
    """1-based number of the first test that holds, else 0."""
    return F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests, 1)], F.lit(0))


def _lineage_variant() -> Column:
    return _variant([equals_any_part(F.col("_parent"), g[0]) & equals_any_part(F.col("_name"), g[1])
                     for g in sig.PARENT_CHILD_GROUPS])


def _family_variant() -> Column:
    words = [re.escape(f[0]) for f in sig.MALWARE_FAMILIES]
    one_of = "|".join(words)
    # most names hold no keyword at all, so the ordered search is rarely needed
    any_word = F.col("_name").rlike(one_of) | F.col("_stem").rlike(one_of)
    ordered = _variant([F.contains("_name", F.lit(f[0])) | F.contains("_stem", F.lit(f[0]))
                        for f in sig.MALWARE_FAMILIES])
    return F.when(_yes(any_word), ordered).otherwise(0)


def with_rule_flags(events: DataFrame, keep_names: list[str] | None = None) -> DataFrame:
    """Events with inputs and one flag column per rule (``_r0`` ...)."""
    df = with_rule_inputs(events)
    have = set(events.columns)
    name, path, bad_path = F.col("_name"), F.col("_path"), F.col("_bad_path")
    tools = sig.attack_tools()
    user = F.col("user") if "user" in have else F.lit(None).cast("string")
    threads = F.col("thread_count") if "thread_count" in have else F.lit(None).cast("int")
    tests = {
        "Known Attack Tool": lambda: name.isin(tools) | F.col("_bare").isin(tools),
        "Suspicious Parent-Child": _lineage_variant,
        "Malware Family": _family_variant,
        "Suspicious Execution Path": lambda: bad_path,
        "Privilege Escalation": lambda: (strip(F.lower(user)).isin(sig.PRIVILEGED_USERS)
                                         & name.isin(sig.DESKTOP_APPS)),
        "Double Extension": lambda: F.col("_lower_name").rlike(sig.DOUBLE_EXTENSION),
        "Encoded Command": lambda: matches_any(path, sig.ENCODED_PATTERNS),
        "Persistence Path": lambda: contains_any(path, sig.PERSISTENCE_PATHS),
        "Script Interpreter Abuse": lambda: name.isin(sig.SCRIPT_INTERPRETERS),
        "Network Tool in Suspicious Path": lambda: name.isin(sig.NETWORK_TOOLS) & bad_path,
        "DLL Hijacking": lambda: path.endswith(".dll") & bad_path,
        "LOLBin Abuse": lambda: (name.isin(sig.LOLBINS) & path.isNotNull()
                                 & ~contains_any(path, sig.LOLBIN_HOME_PATHS)),
        "High Thread Count": lambda: threads > sig.HIGH_THREAD_COUNT,
        "Network Beacon": lambda: F.size("_public") > 0,
        "Persistence Autorun": lambda: name.isin(sig.AUTORUN_LOOKALIKES),
    }
    wanted = RULE_NAMES if keep_names is None else keep_names
    flags = {}
    for i, rule in enumerate(RULE_NAMES):
        if rule in wanted:
            test = tests[rule]()
            flags[f"_r{i}"] = test if i in (LINEAGE, FAMILY) else _yes(test)
    return df.withColumns(flags)


def fired(position: int) -> Column:
    flag = F.col(f"_r{position}")
    return flag > 0 if position in (LINEAGE, FAMILY) else flag


def drop_rule_columns(df: DataFrame) -> DataFrame:
    return df.drop(*_INPUTS, *_FLAGS)


def _texts(columns: list[str]) -> dict[str, Column]:
    """Alert text of every rule (fixed values, which users of the alerts match on)."""
    have = set(columns)
    shown = or_none(F.col("process_name")) if "process_name" in have else F.lit("None")
    shown_path = or_none(F.col("process_path")) if "process_path" in have else F.lit("None")
    parent = F.col("parent_process_name") if "parent_process_name" in have else F.lit("")
    user = or_none(F.col("user")) if "user" in have else F.lit("None")
    threads = F.col("thread_count").cast("string") if "thread_count" in have else F.lit("")
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    return {
        "Known Attack Tool": text("Known attack tool / malware detected: '", shown, "'."),
        "Suspicious Parent-Child": text(
            _lookup([g[3] for g in sig.PARENT_CHILD_GROUPS], F.col(f"_r{LINEAGE}") - 1), ": '", parent,
            "' -> '", shown, "'."),
        "Malware Family": text(
            _lookup([f[2] for f in sig.MALWARE_FAMILIES], F.col(f"_r{FAMILY}") - 1),
            ": process name '", shown, "'."),
        "Suspicious Execution Path": text("Process '", shown, "' executing from suspicious path: '",
                                          shown_path, "'."),
        "Privilege Escalation": text("Privilege escalation indicator: '", shown, "' running as '", user, "'."),
        "Double Extension": text("Double extension detected in '", shown, "'."),
        "Encoded Command": text("Encoded/obfuscated command detected in '", shown, "': possible payload."),
        "Persistence Path": text("Process '", shown, "' installed persistence at: '", shown_path, "'."),
        "Script Interpreter Abuse": text("Script interpreter '", shown, "' detected."),
        "Network Tool in Suspicious Path": text("Network tool '", shown, "' from suspicious path: '",
                                                shown_path, "'."),
        "DLL Hijacking": text("Possible DLL hijacking: '", shown, "' loaded from suspicious path."),
        "LOLBin Abuse": text("LOLBin '", shown, "' executed from non-standard path: '", shown_path, "'."),
        "High Thread Count": text("Process '", shown, "' has abnormally high thread count: ", threads,
                                  ". Possible injection."),
        "Network Beacon": text("Process '", shown, "' has ", F.size("_public").cast("string"),
                               " outbound connections: ", F.array_join(F.slice("_public", 1, 3), "; "), "."),
        "Persistence Autorun": text("Suspicious persistence-like process name: '", shown, "'."),
    }


def _lookup(values: list, index: Column) -> Column:
    """Entry of a constant list, null outside of it."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index)


def match_fields(position: Column, columns: list[str], names: list[str] | None = None,
                 custom: list[dict] = (), custom_text: list[Column] = ()) -> list[Column]:
    """Match columns of a rule position; custom rules follow the static ones.

    ``names`` limits the static rules that can occur (their flags must exist).
    """
    names = RULE_NAMES if names is None else names
    texts = _texts(columns)
    table = [r[:6] for r in sig.STATIC_RULES] + [
        (c["name"], c["severity"], None, c.get("mitre_tactic"), c.get("mitre_technique"),
         c.get("mitre_technique_id")) for c in custom]
    by_field = {"rule": 0, "severity": 1, "tactic_id": 2, "tactic": 3, "technique": 4, "technique_id": 5}
    groups, families = sig.PARENT_CHILD_GROUPS, sig.MALWARE_FAMILIES
    variants = {
        "severity": ([g[2] for g in groups], [f[1] for f in families]),
        "tactic_id": ([g[4] for g in groups], [f[3] for f in families]),
        "tactic": ([g[5] for g in groups], [f[3].replace("TA", "Tactic ") for f in families]),
        "technique": ([g[6] for g in groups], [f[4] for f in families]),
        "technique_id": ([g[7] for g in groups], [f[5] for f in families]),
    }
    out = []
    for field in MATCH_FIELDS:
        if field == "description":
            value = F.lit(None).cast("string")
            for i, rule in enumerate(RULE_NAMES):
                if rule in names:
                    value = F.when(position == i, texts[rule]).otherwise(value)
            for i, text in enumerate(custom_text, len(RULE_NAMES)):
                value = F.when(position == i, text).otherwise(value)
        else:
            value = _lookup([row[by_field[field]] for row in table], position)
            for i, which in ((LINEAGE, 0), (FAMILY, 1)):
                if field in variants and RULE_NAMES[i] in names:
                    value = F.when(position == i, _lookup(variants[field][which], F.col(f"_r{i}") - 1)
                                   ).otherwise(value)
        out.append(value.alias(field))
    return out


def severity_weight(severity: str | None) -> int:
    """LOW 1 .. CRITICAL 4, anything else 0."""
    return sig.SEVERITY_WEIGHT.get(severity, 0)


def fired_weight(position: int) -> Column:
    """Severity weight of a static rule that fired."""
    rows = {LINEAGE: [g[2] for g in sig.PARENT_CHILD_GROUPS],
            FAMILY: [f[1] for f in sig.MALWARE_FAMILIES]}.get(position)
    if rows is None:
        return F.lit(severity_weight(sig.STATIC_RULES[position][1]))
    return F.get(F.array(*[F.lit(severity_weight(s)) for s in rows]), F.col(f"_r{position}") - 1)


def is_allowed_updater(process_name: Column) -> Column:
    """Updaters that never alert on the queue route."""
    return _yes(strip(F.lower(process_name)).isin(sig.ALLOWED_UPDATERS))
