"""Text helpers: trimming, indicators of compromise, redaction, prompt checks."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchframe.functions import signatures as sig
from watchframe.functions.patterns import SPACE


def strip(c: Column) -> Column:
    """Trim all leading and trailing white space, not only blanks and not only ASCII."""
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_none(c: Column) -> Column:
    """Missing values print as ``None`` inside alert texts."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


def contains_any(c: Column, needles: list[str]) -> Column:
    """Plain substring test; wildcards and case are literal. Null gives false."""
    return F.coalesce(any_of([F.contains(c, F.lit(n)) for n in needles]), F.lit(False))


def equals_any_part(c: Column, needles: list[str]) -> Column:
    """Same test as one alternation of quoted texts: small code, for short values."""
    return F.coalesce(c.rlike("|".join(re.escape(n) for n in needles)), F.lit(False))


def matches_any(c: Column, patterns: list[str], prefix: str = "") -> Column:
    """Whether any of the patterns is found, as one alternation."""
    return F.coalesce(c.rlike(prefix + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def ilike_any_part(c: Column, part: str) -> Column:
    """``ILIKE '%part%'`` where ``%`` and ``_`` inside the part stay wildcards."""
    return c.ilike(f"%{part}%")


def extract_ips(text: Column) -> Column:
    """Distinct dotted quads in order of appearance (no range check on octets)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(sig.IP_PATTERN), F.lit(0)))


def extract_domains(text: Column) -> Column:
    """Distinct dotted names; also finds file names such as ``mal.exe``."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(sig.DOMAIN_PATTERN), F.lit(0)))


def is_domain(c: Column) -> Column:
    return F.coalesce(c.rlike(sig.DOMAIN_SYNTAX), F.lit(False))


def alert_context(process_name: Column, description: Column, process_path: Column) -> Column:
    """The text searched for indicators: name, description and path."""
    return F.concat_ws(" ", or_none(process_name), or_none(description),
                       F.coalesce(process_path, F.lit("")))


def prompt_score(text: Column) -> Column:
    low = F.lower(text)
    both = F.contains(low, F.lit("ignore")) & F.contains(low, F.lit("instructions"))
    return F.when(both, 0.95).otherwise(0.1)


def is_prompt_suspicious(text: Column) -> Column:
    return (prompt_score(text) > 0.85) | matches_any(text, sig.PROMPT_PATTERNS, "(?i)")


def _let(value: Column, use) -> Column:
    """Bind a value once for an expression that reads it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _guarded(pattern: str, mark: str, hints: list[str]):
    def use(t: Column) -> Column:
        searched = t if hints == ["@"] else F.lower(t)
        found = any_of([F.contains(searched, F.lit(h)) for h in hints])
        return F.when(found, F.regexp_replace(t, pattern, mark)).otherwise(t)
    return use


# a redaction can only apply where one of these (lower-cased) texts occurs
_REDACTION_HINTS = [None, ["@"], ["passw"], ["key", "token", "secret"], None]


def redact(text: Column) -> Column:
    """Five replacements, in order: address, e-mail, password, key, long hex.

    The costly patterns run only on texts that hold their key word.
    """
    for (pattern, mark), hints in zip(sig.REDACTIONS, _REDACTION_HINTS):
        if hints is None:
            text = F.regexp_replace(text, pattern, mark)
        else:
            text = _let(text, _guarded(pattern, mark, hints))
    return text


def thread_title(title: Column, prompt: Column) -> Column:
    """Given title, else the first 80 characters of the prompt's first line."""
    first_line = F.split(strip(prompt), r"\r\n|\r|\n").getItem(0)
    return F.coalesce(blank_to_null(title), blank_to_null(F.substring(first_line, 1, 80)),
                      F.lit("Security Investigation"))


def tag_tokens(tags: Column, is_list: bool) -> Column:
    """Lower-cased, trimmed tags of an array column or a comma-separated string."""
    items = tags if is_list else F.split(tags, ",")
    return F.transform(items, lambda t: F.lower(strip(t)))
