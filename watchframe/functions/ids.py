"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the DNS name space of RFC 4122
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

_HEX32 = r"^[0-9a-f]{32}$"


def _dashed(hex32: Column) -> Column:
    return F.concat_ws("-", *[F.substring(hex32, start, length)
                              for start, length in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]])


def name_uuid(text: Column) -> Column:
    """UUID version 5 of a text in the DNS name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(text, "UTF-8")))
    # RFC 4122: version nibble 5, variant bits 10xx
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]),
                           (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return _dashed(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3),
                            variant, F.substring(digest, 18, 15)))


def agent_uuid(text: Column) -> Column:
    """Texts that are UUIDs keep their value, others get a derived UUID.

    Accepted spellings: optional ``urn:uuid:`` prefix, braces and dashes, any case.
    """
    plain = F.regexp_replace(F.lower(text), r"urn:|uuid:", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^[{}]+|[{}]+$", ""), "-", "")
    return F.when(plain.rlike(_HEX32), _dashed(plain)).otherwise(name_uuid(text))


def unknown_pid(pid: Column) -> Column:
    """Process id as a key part; 0 and null share the key ``unknown``."""
    return F.coalesce(F.nullif(pid, F.lit(0)).cast("string"), F.lit("unknown"))
