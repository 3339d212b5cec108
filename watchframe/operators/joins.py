"""Joins with look-up tables, and the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def lookup(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join with a stored look-up table.

    Adaptive execution broadcasts it when it turns out small at run time, and
    otherwise splits a hot key of the left side; nothing runs while planning.
    """
    return left.join(right, on, how)


def skewed_lookup(left: DataFrame, right: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Left join with a derived table that has one row per key, for any skew of the left side.

    Adaptive skew splitting does not apply above an aggregation, so the rows of
    a key are dealt to ``salts`` places and each row of the right side is repeated
    as often.  Both sides are read once.  Rows without a key find nothing.
    """
    columns = [*left.columns, *[c for c in right.columns if c != key]]
    # dealt by position, so that equal rows part as well and columns of any type will do
    dealt = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    every = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(every, [key, "_salt"], "left").select(*columns)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``; combines before the shuffle, so hot keys are fine."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))
