"""Rule patterns against Python's own engine: random patterns and texts, refused rules, pattern columns."""

import random
import re
import warnings

import pytest
from pyspark.sql import functions as F
from watchframe.functions.conditions import pattern_fault, refused_rules
from watchframe.functions.patterns import PatternError, java_pattern, match_pattern_column
from watchframe.functions.text import strip
from watchframe.operators import detection as D

from test_rules import P, events, rules

ATOMS = ["a", "B", "é", "É", "s", "k", "i", "İ", "ß", "Σ", "1", "٣", "_", " ", r"\.", ".", r"\w", r"\W", r"\d", r"\D", r"\s", r"\S", r"\b", r"\B",
         "^", "$", r"\A", r"\Z", "[a-c]", "[^a-c]", "[É-Ý]", r"[\w-]", r"[^\s]", r"[\[&&a]", "[K-ſ]", "{", "a{", "x{a}", "a{,3}", "a{2}", "a{1,2}?",
         "(a)", "(?:b|c)", "(?P<n>s)", "(?=a)", "(?!b)", "(?<=a)", "(?<!é)", "(?#note)", "(?i:k)", "(?-i:a)", "(?s:.)", "(?m:^a$)", r"(?a:\w)",
         "(?>a+)", "a++", r"\1", "(a)?(?(1)b|c)", "(b)?(?(1)a)", "|", "*", "+", "?", r"\n", r"\x41", r"\u00e9", "]"]
CHARS = list("aAbBcéÉsSſkKKiİıIßẞΣσς1٣_ \u00a0\n\r\u2028\x1c.[&{x漢😀]-")


def test_random_patterns_find_what_python_finds(spark):
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern
    r, used = random.Random(8), 0
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for _ in range(6000):
            p = "".join(r.choice(ATOMS) for _ in range(r.randint(1, 5)))
            try:
                own = re.compile(p, re.I)
            except re.error:
                with pytest.raises(PatternError):
                    java_pattern(p)
                continue
            found = pattern.compile(java_pattern(p))
            used += 1
            for _ in range(2):
                t = "".join(r.choice(CHARS) for _ in range(r.randint(0, 5)))
                assert found.matcher(t).find() == bool(own.search(t)), (p, t)
    assert used > 4000


@pytest.mark.parametrize(("pattern", "hit", "miss"), [
    ("é", ["CAFÉ"], ["cafe"]), (r"^\w+$", ["café", "CAFÉ\n"], ["a b", "a\r"]), (r"^\d+$", ["٣"], ["²"]), (r"a\sb", ["a\u00a0b", "a\u2028b"], ["ab"]),
    ("^.$", ["\r", "\u2028"], ["\n"]), ("a$", ["a", "a\n"], ["a\r", "a\n\n"]), ("a{,3}b", ["b", "aaab"], ["a"]), ("{", ["{"], ["}"]),
    ("a{", ["A{"], ["a"]), ("x{a}", ["x{A}"], ["xa"]), ("(?#note)curl", ["CURL"], ["note"]), (r"(?P<q>['\"])x(?P=q)", ["'x'"], ["'x\""]),
    ("(?x) a b # c", ["AB"], ["a b"]), (r"^(<)?a(?(1)>|$)", ["<a>", "a"], ["<a", "a>"]), ("k", ["\u212a"], ["c"])])
def test_spelled_patterns(spark, pattern, hit, miss):
    found = spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    for t in hit + miss:
        assert found.matcher(t).find() == (t in hit) == bool(re.search(pattern, t, re.I)), t


def test_refused_rules_are_listed_and_the_others_run(spark):
    table = rules(spark, {"pattern": "("}, {"pattern": "curl"}, {"pattern": r"(a)(?<=\1)b"}, {"pattern": "x{99999999999}"}, {"pattern": "[", "is_active": False},
                  {"pattern": "x", "conditions": {"logic": "or", "conditions": [
                      {"target_field": "process_name", "pattern": "*"}, {"target_field": "process_name", "operator": "equals", "pattern": "("},
                      {"target_field": "process_name", "pattern": "^CURL$"}]}}, {"pattern": None})
    refused = refused_rules(table).collect()
    assert [(r.rule_id, r.part, r.pattern) for r in refused] == [
        (1, "pattern", "("), (3, "pattern", r"(a)(?<=\1)b"), (4, "pattern", "x{99999999999}"), (6, "condition 1", "*"), (7, "pattern", None)]
    assert all(r.reason for r in refused) and pattern_fault(spark, "a|b") is None
    hits = {r.rule_id for r in D.custom_rule_matches(events(spark, [P(process_name="curl")]), table).collect()}
    assert hits == {2, 6}


def test_pattern_columns(spark):
    cases = [("CAFÉ", "é", True), ("x", "(", False), ("x", None, False), (None, "x", False), ("a{", "{", True), ("ab", r"(?P<p>a)b\Z", True),
             ("ab\n", r"b\Z", False), ("AB", "b$", True), ("", "", True), ("a", r"(a)(?<=\1)", False)] * 3
    rows = spark.createDataFrame([(i, v, p, "own") for i, (v, p, _) in enumerate(cases)], "id int, v string, p string, _java2 string")
    got = match_pattern_column(rows, "v", "p").orderBy("id").collect()
    assert [r.matched for r in got] == [c[2] for c in cases] and got[0].asDict().keys() == {"id", "v", "p", "_java2", "matched"}
    assert match_pattern_column(rows.limit(0), "v", "p").count() == 0


def test_strip_is_pythons(spark):
    texts = [" a ", "\u00a0a\u3000", "\x1ca\x85", "\n a b \r\n", "\u200ba", "", " "]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", strip(F.col("t")).alias("t"))
    assert [r.t for r in got.orderBy("i").collect()] == [t.strip() for t in texts]
