"""Operator 2, exact deduplication by progressive refinement.

Texts are equal when their bytes are, after A-Z are lower-cased.  First lengths are counted,
then (length, hash of the first bytes) among the lengths that occur twice or more, and only
texts whose pair occurs twice or more are read and hashed in full.  Which they are, the tasks
learn from a bitmap of fixed size; a false hit only costs one more full hash.  No text is
shuffled, and groups are only ever counted, so a group may be of any size.

Null text counts as empty.  Of equal texts the largest doc_id stays (rows without an id only
if none has one); rows that repeat an id and a text are all marked kept, and ``deduplicated``
leaves one of them, the one whose other columns are greatest as JSON.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.common import batches, bitmap, in_bitmap, sorted_out, texts, unused, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _suspects(docs: DataFrame, prefix: int) -> bytes:
    """Bitmap of the (length, prefix hash) pairs that occur more than once."""
    head = F.xxhash64("n", F.translate(F.substring("text", 1, prefix), UPPER, LOWER))
    narrow = written(docs.withColumn("n", F.octet_length("text")).select("n", head.alias("h")), "lengths")
    lengths = written(narrow.groupBy("n").count().where("count > 1").select("n"), "repeated-lengths")
    pairs = narrow.join(lengths, "n", "left_semi").groupBy("h").count().where("count > 1")
    return bitmap(pairs, "h")


def exact_groups(docs: DataFrame, prefix: int = 64, digest: bool = False, text: str = "text",
                 id: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for texts known to be single without a full hash, unless ``digest``.
    """
    spark = docs.sparkSession
    rows = texts(docs, text=text, id=id)
    bits = spark.sparkContext.broadcast(_suspects(rows, prefix))  # 8 MB at most
    head = F.xxhash64(F.octet_length("text"), F.translate(F.substring("text", 1, prefix), UPPER, LOWER))

    def full(stream):
        found = np.frombuffer(bits.value, np.uint8)
        for batch, values in batches(stream):
            check = in_bitmap(found, batch.column(2).to_numpy())
            sha = [hashlib.sha256(v.lower()).hexdigest() if digest or c else None
                   for v, c in zip(values, check, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), pa.array(check)],
                                             ["doc_id", "text_sha256", "check"])

    hashed = written(rows.withColumn("h", head).mapInArrow(full, "doc_id bigint, text_sha256 string, check boolean"), "hashes")
    groups = written(hashed.where("check").groupBy("text_sha256")
                     .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    # the written groups shuffle on their own, so adaptive execution can split the rows of a hot group
    checked = hashed.where("check").join(groups, "text_sha256", "left")
    single = hashed.where("NOT check").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint")})
    return checked.unionByName(single, allowMissingColumns=True).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, prefix: int = 64, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents with one row left of each group of equal texts; columns as they were."""
    groups = written(exact_groups(docs, prefix, text=text, id=id), "exact")
    gone, sha, own, row = (unused(docs, n) for n in ("_gone", "_sha", "_own_sha", "_row"))
    drop = written(groups.where("NOT kept").select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha)), "drop")
    key = F.col(f"`{id}`")
    if groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        maybe, left = sorted_out(docs, key.cast("long"), drop, gone)  # no text of a row that stays is shuffled
        return left.union(maybe.join(drop, key.cast("long").eqNullSafe(F.col(gone)), "left_anti"))
    # an id comes more than once: rows are told apart by their text as well
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = docs.withColumn(own, F.sha2(F.translate(value, UPPER, LOWER), 256))
    left = marked.join(drop, key.cast("long").eqNullSafe(F.col(gone)) & (F.col(own) == F.col(sha)), "left_anti")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != id])
    one = left.groupBy(key, F.col(own)).agg(F.max_by(rest, F.to_json(rest)).alias(row))
    return one.select(*[key if c == id else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])
