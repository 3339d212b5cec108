"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchframe.llm.common import texts, written


def fold(id: str = "doc_id") -> Column:
    """crc32 of the id as text, from which folds are taken."""
    return F.crc32(F.col(id).cast("string").cast("binary"))


def held_out_flag(held_out: Callable[[Column], Column], id: str = "doc_id") -> Column:
    """Whether a row is in the fold that fits must not see; null ids never are."""
    return F.coalesce(held_out(fold(f"`{id}`")), F.lit(False)).alias("held_out")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable[[Column], Column],
                    rows: int, text: str = "text", id: str = "doc_id", label_id: str = "doc_id",
                    max_bytes: int | None = None) -> DataFrame:
    """Up to ``rows`` labelled documents outside the held-out fold, by the hash of their id: doc_id, label, text.

    With ``max_bytes``, up to as many of these as have so many bytes of text together.  An id
    labelled twice takes the larger label; of an id's several texts the one with the largest hash
    counts; rows without id or label are no labels.
    """
    known = (labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out_flag(held_out))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # as many rows as the parameter says at most, of two integers
    found = texts(docs, text=text, id=id).join(F.broadcast(chosen), "doc_id")
    one = F.max_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), "text"))
    sample = written(found.groupBy("doc_id").agg(one.alias("one")).select("doc_id", "one.label", "one.text"), "labelled")
    if max_bytes is None:
        return sample
    # sizes of at most ``rows`` texts in one sorted run
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = sample.select("doc_id", F.sum(F.octet_length("text")).over(order).alias("size")).where(F.col("size") <= max_bytes)
    return written(sample.join(F.broadcast(sizes.select("doc_id")), "doc_id", "left_semi"), "sample")
