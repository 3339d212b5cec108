"""Vectors as small integers, and sums of arrays over tasks, for operators 12 and 13."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes beyond this are refused, so products of two and their sums stay exact.
LARGEST = 2 ** 31 - 1
SCALE = 256


def integer_vectors(rows: DataFrame, *more: Column, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """vec_id, x (floor of 256 times each entry) and ``more`` of the rows with a complete, finite vector.

    Only vectors of the commonest length stay (the larger one of equals), and empty ones never.
    A code outside 32 bits stops the job.
    """
    entry = F.col(f"`{vector}`").cast("array<double>")
    whole = entry.isNotNull() & F.forall(entry, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    found = rows.where(F.coalesce(whole, F.lit(False)) & (F.size(entry) > 0))
    sizes = found.groupBy(F.size(entry).alias("size")).agg(F.count("*").alias("m"))
    best = sizes.orderBy(F.desc("m"), F.desc("size")).first()
    x = F.transform(entry, lambda v: F.floor(v * F.lit(float(SCALE))).cast("int"))
    far = F.exists(entry, lambda v: F.abs(F.floor(v * F.lit(float(SCALE)))) > F.lit(float(LARGEST)))
    checked = F.when(far, F.raise_error(F.lit("a vector entry has no code of 32 bits")).cast("array<int>")).otherwise(x)
    return found.where(F.size(entry) == (best.size if best else 0)).select(
        F.col(f"`{id}`").cast("long").alias("vec_id"), checked.alias("x"), *more)


def matrices(stream: Iterable[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as an int64 matrix."""
    for batch in stream:
        if batch.num_rows:
            flat = batch.column(batch.schema.get_field_index(column)).flatten().to_numpy()
            yield batch, flat.astype(np.int64).reshape(batch.num_rows, -1)


def summed(rows: DataFrame, per_task: Callable[[Iterable[pa.RecordBatch]], np.ndarray], width: int, groups: int = 64) -> np.ndarray:
    """Sum of one array of ``width`` (int64 or float64) per task, added up in two levels.

    Tasks are dealt to ``groups`` adders, so the driver gets that many arrays at most and an
    adder holds two; integers are exact.  Without rows: integer zeros.
    """
    def first(stream):
        total = per_task(stream)
        yield pa.RecordBatch.from_pydict({"g": pa.array([TaskContext.get().partitionId() % groups], pa.int32()),
                                          "kind": pa.array([total.dtype.str]), "v": pa.array([total.tobytes()], pa.binary())})

    def second(stream):
        total, kind = None, None
        for batch in stream:
            for kind, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got = np.frombuffer(v, kind)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind]), "v": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(first, "g int, kind string, v binary").repartition(groups, "g").mapInArrow(second, "kind string, v binary")
    found = [np.frombuffer(bytes(r.v), r.kind) for r in parts.collect()]
    return sum(found) if found else np.zeros(width, np.int64)
