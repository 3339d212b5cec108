"""Shared folder, written tables, bounded bitmaps and block sums for the text operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Bloom bitmap has 2**BITS bits (8 MB), however many keys it takes; false hits cost work, not results.
BITS, BUCKET = 26, 32_768
SHIFTS = (0, 19, 38)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only on local masters that set none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it ends, and not when the driver collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and outlives executors.

    Nothing reads the shuffle files of the query again, so they go with its end.
    """
    path, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANED)
        else:
            conf.set(CLEANED, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, *more: Column, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The two columns every operator needs, null text as empty."""
    return docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), *more)


_kept: dict[str, object] = {}
_kept_for: list[int | None] = [None]


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def new_stage() -> None:
    """Drop what a Python worker kept for other stages; before a task loads what it needs itself."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _kept_for[0]:
        _kept.clear()
        _kept_for[0] = stage
        give_back()


def kept(key: str, make: Callable):
    """An object that a Python worker keeps between its tasks of one stage; the next stage finds the memory free."""
    new_stage()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def slices(stream: Iterable[pa.RecordBatch], column: str = "text", size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``size`` bytes of text."""
    new_stage()
    for batch in stream:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def batches(stream: Iterable[pa.RecordBatch], column: str = "text", size: int = 1 << 21,
            raw: bool = True) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches holding about ``size`` bytes of text, with the texts as bytes or str."""
    for part in slices(stream, column, size):
        values = part.column(part.schema.get_field_index(column))
        yield part, (values.cast(pa.binary()) if raw else values).to_pylist()


def bitmap(keys: DataFrame, key: str, bits: int = BITS) -> bytes:
    """Bloom bitmap of a column of 64-bit hashes, built by map-side aggregation.

    The driver gets 2**bits / 8 bytes at most, whatever the number of keys.
    """
    spots = F.explode(F.array(*[F.shiftrightunsigned(F.col(key), s).bitwiseAND(F.lit((1 << bits) - 1)) for s in SHIFTS]))
    rows = (keys.select(spots.alias("p"))
            .groupBy(F.floor(F.col("p") / BUCKET).cast("int").alias("b"))
            .agg(F.bitmap_construct_agg((F.col("p") % BUCKET).cast("long")).alias("m")))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.collect():
        part = np.frombuffer(bytes(row.m), np.uint8)
        out[row.b * BUCKET // 8:row.b * BUCKET // 8 + len(part)] = part
    return out.tobytes()


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes may be in the bitmap (bits: its bytes as uint8)."""
    keys, found = keys.view(np.uint64), np.ones(len(keys), bool)
    mask = np.uint64(len(bits) * 8 - 1)
    for s in SHIFTS:
        spot = (keys >> np.uint64(s)) & mask
        found &= (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def sorted_out(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in the column ``name`` of ``keys``, and the others, of which none is.

    A bitmap tells, so neither part is shuffled; a null key is a key.
    """
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.xxhash64(name).alias("h")), "h"))  # 8 MB

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(np.frombuffer(bits.value, np.uint8), h.to_numpy()))

    flag = unused(rows, "_maybe")
    marked = rows.withColumn(flag, maybe(F.xxhash64(key)))
    return marked.where(flag).drop(flag), marked.where(f"NOT {flag}").drop(flag)


def block_sums(rows: DataFrame, count: Callable, width: int, blocks: int,
               limit: int = 64 << 20) -> np.ndarray:
    """Sum of one int64 array of ``width`` per task, added up block by block on the cluster.

    ``count(stream of record batches)`` returns the array of a task.  Blocks are shuffled
    compressed, each is summed in a stream, so memory is one block; the driver gets the sum,
    ``8 * width`` bytes, which must be within ``limit``.
    """
    if width * 8 > limit:
        raise ValueError("the array is too wide for the driver")
    step = -(-width // blocks)

    def per_task(stream):
        total = count(stream)
        if total is not None:
            parts = [total[b * step:(b + 1) * step] for b in range(blocks)]
            some = [(b, p) for b, p in enumerate(parts) if p.any()]
            yield pa.RecordBatch.from_pydict(
                {"b": pa.array([b for b, _ in some], pa.int32()),
                 "v": pa.array([pa.compress(p.astype("<i8").tobytes(), "lz4", asbytes=True) for _, p in some], pa.binary()),
                 "n": pa.array([len(p) for _, p in some], pa.int32())})

    def per_block(stream):
        sums: dict[int, np.ndarray] = {}
        for batch in stream:
            for b, v, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = np.frombuffer(pa.decompress(v, 8 * n, "lz4", asbytes=True), "<i8")
                sums[b] = sums[b] + got if b in sums else got
        yield pa.RecordBatch.from_pydict({"b": pa.array(list(sums), pa.int32()),
                                          "v": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    spread = rows.mapInArrow(per_task, "b int, v binary, n int").repartition(blocks, "b")
    out = np.zeros(width, np.int64)
    for row in spread.mapInArrow(per_block, "b int, v binary").collect():
        got = np.frombuffer(bytes(row.v), "<i8")
        out[row.b * step:row.b * step + len(got)] = got
    return out
