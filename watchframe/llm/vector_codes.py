"""Operator 13, product codes of vectors with exact integer arithmetic.

Vectors are integers (``vectors.integer_vectors``), cut into consecutive parts.  Nearest entries
are found by squared distances |x|^2 - 2 x.c + |c|^2 in whole numbers: the products are matrix
products of limbs, so short that every sum of products in double precision stays below 2^53 and
is exact, put together in 64-bit integers.  The first of the smallest distances wins.  Tasks add
up their parts by entry; the sums are added on the cluster and make the next codebooks, which
have ``entries`` times the length of a vector numbers, whatever the table.

The codebooks start from the vectors of the smallest ids (null ids last; equal ids by vector);
tables with fewer vectors have fewer entries, empty ones no rows.  Parts are as equal as the
length allows, the first ones longer.  Rows without a complete finite vector, and those of
another length than most, have no result; repeated rows each have theirs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.common import written
from watchframe.llm.vectors import integer_vectors, matrices, summed


def limb_bits(terms: int) -> int:
    """Bits of a limb, so that ``terms`` products of two sum up to less than 2^53."""
    return (53 - max(1, terms).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Parts of the integers, lowest first, as doubles; the last one has the sign."""
    reach, out = int(np.abs(x).max(initial=0)), []
    while reach >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(float))
        x, reach = x >> bits, (reach >> bits) + 1
    return [*out, x.astype(float)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact; what needs more than 63 bits is refused."""
    terms = a.shape[1]
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * terms >= 2 ** 63:
        raise OverflowError("products need more than 63 bits")
    bits = limb_bits(terms)
    total = np.zeros((len(a), len(b)), np.int64)
    for i, high in enumerate(limbs(a, bits)):
        for j, low in enumerate(limbs(b, bits)):
            total += (high @ low.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries for each row, and its squared distance."""
    far = (entries * entries).sum(1) - 2 * exact_products(x, entries)
    code = far.argmin(1)
    return code, far[np.arange(len(x)), code] + (x * x).sum(1)


def _cuts(d: int, parts: int) -> list[slice]:
    ends = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(d), parts))]).tolist()
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _next_books(rows: DataFrame, books: np.ndarray, cuts: list[slice]) -> np.ndarray:
    """The codebooks after one round; ``books`` has an entry per row and the parts side by side."""
    k, d = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)  # entries times dimensions

    def per_task(stream):
        own, total, used = sent.value, np.zeros((k, d), np.int64), np.zeros((k, len(cuts)), np.int64)
        for _, x in matrices(stream):
            for p, cut in enumerate(cuts):
                code, _ = nearest(x[:, cut], own[:, cut])
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                total[code[order][first], cut] += np.add.reduceat(x[order, cut], first, 0)
                used[:, p] += np.bincount(code, minlength=k)
        return np.concatenate([total.ravel(), used.ravel()])

    sums = summed(rows, per_task, k * d + k * len(cuts))
    total, used = sums[:k * d].reshape(k, d), sums[k * d:].reshape(k, len(cuts))
    counts = np.repeat(used, [c.stop - c.start for c in cuts], 1)
    return np.where(counts > 0, total // np.maximum(counts, 1), books)


def books_digest(books: np.ndarray, cuts: list[slice]) -> str:
    numbers = [v for cut in cuts for v in books[:, cut].ravel().tolist()]
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def vector_codes(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vector: str = "embedding",
                 id: str = "vec_id", label: str = "label") -> DataFrame:
    """One row per row: vec_id, code, error, label_error, codebooks_sha256; null labels are one label."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    spark = rows.sparkSession
    vectors = written(integer_vectors(rows, F.col(f"`{label}`").alias("label"), vector=vector, id=id), "vectors")
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not start:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books = np.array([r.x for r in start], np.int64)
    cuts = _cuts(books.shape[1], parts)
    for _ in range(rounds):
        books = _next_books(vectors.select("x"), books, cuts)
    sent = spark.sparkContext.broadcast(books)

    def coded(stream):
        for batch, x in matrices(stream):
            codes, error = np.zeros((len(x), len(cuts)), np.uint8), np.zeros(len(x), np.int64)
            for p, cut in enumerate(cuts):
                codes[:, p], far = nearest(x[:, cut], sent.value[:, cut])
                error += far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    found = written(vectors.mapInArrow(coded, f"vec_id bigint, label {kind}, code string, error bigint"), "codes")
    sums = written(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books, cuts)).alias("codebooks_sha256"))
