"""Operator 7, benchmark decontamination with a broadcast set of test n-grams.

Items are lower-cased (A-Z) and cut into words; every run of ten words, or the whole of a
shorter item, is a window.  Window hashes go to the tasks in blocks of a checked size, one
pass of the documents a block (one block up to ``block_windows`` windows); a task scans the
word windows of its documents, looks hits up, verifies them word by word and merges spans.
Row-local per block; more blocks are merged by document.

Null text has no words.  Items without words, or without text, have no window; items without
an id count under the empty id.  Repeated items each count by their id, once a document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.common import batches, texts, unused, written
from watchframe.llm.words import ALNUM, WordHashes, bounds, windows

#: Windows in one broadcast block: about 200 bytes each in a Python worker.
BLOCK_WINDOWS = 500_000


def item_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def _item_windows(benchmark: DataFrame, size: int, text: str, id: str) -> DataFrame:
    """One row per distinct window: h, words (joined by spaces), items (sorted distinct ids)."""
    def cut(stream):
        for batch, values in batches(stream):
            ids, hs, ws = [], [], []
            for item, value in zip(batch.column(0).to_pylist(), values, strict=True):
                words = item_words(value)
                if words:
                    n = min(size, len(words))
                    hs += windows(WordHashes()(words), n).view(np.int64).tolist()
                    ws += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
                    ids += [item] * (len(words) - n + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(hs, pa.int64()), pa.array(ws, pa.binary())],
                                             ["item", "h", "words"])

    rows = benchmark.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("item"),
                            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return (rows.mapInArrow(cut, "item string, h bigint, words binary").groupBy("h", "words")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


class WindowSet:
    """The hash set of one block: a bit table in front of a dictionary of words and items."""

    BITS = 20

    def __init__(self, rows: list[tuple[int, bytes, list[str]]]):
        self.table: dict[int, list[tuple[bytes, list[str]]]] = {}
        for h, words, items in rows:
            self.table.setdefault(h, []).append((words, items))
        self.sizes = sorted({w.count(b" ") + 1 for _, w, _ in rows})
        self.front = np.zeros(1 << self.BITS, bool)
        self.front[self._spot(np.array(list(self.table), np.int64).view(np.uint64))] = True

    def _spot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def scan(self, words: list[bytes], hashes: np.ndarray, starts: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Verified spans (word positions in the document) and items, by document with hits."""
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for size in self.sizes:
            h = windows(hashes, size)
            at = np.flatnonzero(self.front[self._spot(h)]) if len(h) else h
            docs = np.searchsorted(starts, at, "right") - 1
            inside = at + size <= starts[docs + 1] if len(at) else at
            for p, d in zip(at[inside].tolist(), docs[inside].tolist(), strict=True) if len(at) else ():
                for found, items in self.table.get(int(h[p].astype(np.int64)), ()):
                    if found == b" ".join(words[p:p + size]):
                        spans, hit = out.setdefault(d, ([], set()))
                        spans.append((p - int(starts[d]), p - int(starts[d]) + size))
                        hit.update(items)
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _blocks(benchmark: DataFrame, size: int, block_windows: int, text: str, id: str) -> list:
    """Broadcast window sets, each within the checked size."""
    spark = benchmark.sparkSession
    rows = written(_item_windows(benchmark, size, text, id), "windows")
    n = max(1, -(-rows.count() // max(1, block_windows // 2)))  # half full, as hashes spread unevenly
    return [spark.sparkContext.broadcast([tuple(r) for r in rows.where(F.pmod("h", F.lit(n)) == b).collect()]) for b in range(n)]


KIND = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<array<int>>"


def _scanned(rows: DataFrame, block, tie: bool) -> DataFrame:
    """The hits of one block in each document; with ``tie`` that third column is kept."""
    def scan(stream):
        found, hashes = WindowSet(block.value), WordHashes()
        for batch, values in batches(stream):
            lists = [item_words(v) for v in values]
            words, starts = [w for ws in lists for w in ws], bounds(lists)
            hits = found.scan(words, hashes(words), starts)
            spans = [merged(hits[d][0]) if d in hits else [] for d in range(len(values))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(starts)), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                 pa.array([sorted(hits[d][1]) if d in hits else [] for d in range(len(values))], pa.list_(pa.string())),
                 pa.array([[list(x) for x in s] for s in spans], pa.list_(pa.list_(pa.int32()))), *([batch.column(2)] if tie else [])],
                ["doc_id", "n_words", "n_hit", "items", "spans", *(["tie"] if tie else [])])

    return rows.mapInArrow(scan, KIND + ", tie bigint" * tie)


def _united(rows: DataFrame, blocks: list) -> DataFrame:
    """The hits of all blocks, one row per id and text: as KIND, with tie and copies."""
    every = reduce(DataFrame.unionByName, [_scanned(rows, block, True) for block in blocks])
    together = every.groupBy("doc_id", "tie").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("s"), (F.count("*") / len(blocks)).cast("int").alias("copies"))
    zero = F.expr("named_struct('done', cast(array() as array<array<int>>), 'a', -1, 'b', -1)")
    ended = lambda acc: F.when(acc["a"] < 0, acc["done"]).otherwise(
        F.concat(acc["done"], F.array(F.array(acc["a"], acc["b"]))))

    def step(acc, x):
        joins = x[0] <= acc["b"]
        return F.struct(F.when(joins, acc["done"]).otherwise(ended(acc)).alias("done"), F.when(joins, acc["a"]).otherwise(x[0]).alias("a"),
                        F.when(joins, F.greatest(acc["b"], x[1])).otherwise(x[1]).alias("b"))

    out = together.withColumn("spans", F.aggregate("s", zero, step, ended)).drop("s")
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + (x[1] - x[0])))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_windows: int = BLOCK_WINDOWS,
                  text: str = "text", id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted), spans (of hit words)."""
    rows, blocks = texts(docs, text=text, id=id), _blocks(benchmark, size, block_windows, text, item_id)
    if len(blocks) == 1:
        return _scanned(rows, blocks[0], False)
    found = _united(rows.withColumn("tie", F.xxhash64("text")), blocks)
    return (found.withColumn("_i", F.explode(F.sequence(F.lit(1), "copies")))
            .select("doc_id", "n_words", "n_hit", "items", "spans"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents",
                   block_windows: int = BLOCK_WINDOWS, text: str = "text", id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """The documents without those that hold a window (``documents``), or without the hit spans (``spans``).

    A span goes with the text between its words; columns stay as they were.  One map over the
    documents per block of windows, no shuffle; spans of several blocks are united by document first.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    blocks = _blocks(benchmark, size, block_windows, text, item_id)
    kind = docs.schema

    def cut(part: pa.RecordBatch, values: list, spans: dict) -> pa.RecordBatch:
        k = part.schema.get_field_index(text)
        new = [without(v, spans[d]) if d in spans else v for d, v in enumerate(values)]
        return part.set_column(k, part.schema.field(k), pa.array(new, pa.binary()).cast(pa.string()))

    if remove == "spans" and len(blocks) > 1:
        tie, own = unused(docs, "_tie"), unused(docs, "_spans")
        value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
        found = (_united(texts(docs, text=text, id=id).withColumn("tie", F.xxhash64("text")), blocks)
                 .where("n_hit > 0").select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_of"), F.col("spans").alias(own)))
        marked = docs.withColumn(tie, F.xxhash64(value))
        joined = marked.join(found, F.col(f"`{id}`").cast("long").eqNullSafe(found["_doc"]) & (F.col(tie) == found["_of"]), "left")

        def apply(stream):
            for batch in stream:
                for part, values in batches([batch], text):
                    spans = {d: s for d, s in enumerate(part.column(part.num_columns - 1).to_pylist()) if s}
                    yield cut(part.select(list(range(part.num_columns - 1))), values, spans)

        return joined.select(*[F.col(f"`{c}`") for c in docs.columns], own).mapInArrow(apply, kind)

    for block in blocks:
        def clean(stream, block=block):
            found, hashes = WindowSet(block.value), WordHashes()
            for batch in stream:
                for part, values in batches([batch], text):
                    lists = [item_words(v) if v else [] for v in values]
                    words, starts = [w for ws in lists for w in ws], bounds(lists)
                    hits = found.scan(words, hashes(words), starts)
                    if hits and remove == "documents":
                        part = part.filter(pa.array([d not in hits for d in range(len(values))]))
                    elif hits:
                        part = cut(part, values, {d: merged(s) for d, (s, _) in hits.items()})
                    if part.num_rows:
                        yield part
        docs = docs.mapInArrow(clean, kind)
    return docs


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given spans of words."""
    plain = text.translate(ALNUM)
    places, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)

