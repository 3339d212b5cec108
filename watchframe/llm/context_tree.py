"""Operator 4, scores of a context-tree weighting model over bytes.

A text's bytes (A-Z lower-cased, then one end byte 0) are eight binary decisions each.  For
every decision node of a byte there is a tree of contexts, the 0 to ``depth`` bytes before it;
every context holds a Krichevsky-Trofimov estimate of its decisions in the training texts, and
the tree mixes the estimates of all depths by the weights that the training texts give them.

Counting.  A block (a file split) reports its distinct runs of depth + 1 bytes with their
training counts, zero for runs it only needs scored, and its distinct words likewise: one row
per block and run, so no run is frequent.  Rows are added up by run; the trees below two bytes
of context are worked out where their runs lie, and sums for the pairs of bytes that occur
join them at the top (a bounded number, tens of thousands for UTF-8 text).  Each block gets back the values of its own runs, written to the shared folder, and scores its texts
with them.  The model is nowhere held as a whole, grows with the corpus and is exact.

The base score is a unigram model of words with add-one-half smoothing.

Null text counts as empty (one end); rows without an id are training texts.  Runs are at most
``depth`` 6; words are told apart by 63-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.llm.common import batches, new_folder, texts, written
from watchframe.llm.labelled import held_out_flag
from watchframe.llm.words import WordHashes, bounds

CHUNK = 1 << 21
#: Contexts of up to so many bytes are joined over all tasks; ``depth`` must be more.
TOP = 2
#: The end of a text as a word, told apart from all word hashes by being the least key.
END = np.int64(np.iinfo(np.int64).min)


# --- runs of bytes and words of texts -------------------------------------------------------

def byte_runs(values: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each byte with its context, nearest byte first, and the start of each text."""
    pad = b"\0" * depth
    buf = np.frombuffer(pad + (b"\0" + pad).join(values) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) + 1
    key = np.zeros(len(buf) - depth, np.int64)
    for j in range(1, depth + 1):
        key = (key << 8) | buf[depth - j:len(buf) - j]
    key = (key << 8) | buf[depth:]
    first = np.cumsum(sizes + depth) - sizes - depth
    starts = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.arange(starts[-1]) + np.repeat(first - starts[:-1], sizes)
    return key[inside], starts


def word_keys(values: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Keys (negative) of the words and the end of each text, and the start of each text."""
    lists = [v.split() for v in values]
    starts = bounds(lists)
    h = (hashes([w for ws in lists for w in ws]) >> np.uint64(1)).astype(np.int64)
    keys = np.where(h == 0, 1, h) | END
    return np.insert(keys, starts[1:], END), starts + np.arange(len(starts))


class Distinct:
    """Distinct keys with training counts, merged now and then."""

    def __init__(self, limit: int = 4_000_000):
        self.limit, self.parts, self.held = limit, [], 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        self._hold(*np.unique(keys[train], return_counts=True))
        rest = np.unique(keys[~train])
        self._hold(rest, np.zeros(len(rest), np.int64))

    def _hold(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > self.limit:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])
            self.limit = max(self.limit, 2 * self.held)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[start], np.add.reduceat(counts, start) if len(keys) else counts


# --- context trees --------------------------------------------------------------------------

_SMALL = 4096
_HALF = np.array([math.lgamma(k + 0.5) for k in range(_SMALL)])
_FULL = np.array([math.lgamma(k + 1.0) for k in range(_SMALL)])


def _log_gamma(n: np.ndarray, add: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1)]
    big = n >= _SMALL
    if big.any():
        x = n[big] + add
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    return out


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return (_log_gamma(a, 0.5, _HALF) + _log_gamma(b, 0.5, _HALF) - _log_gamma(a + b, 1.0, _FULL) - math.log(math.pi))


class Level:
    """Nodes of one depth: counts, log weighted probability, share of the own estimate, parent."""

    def __init__(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        self.a, self.b = a, b
        own = log_estimate(a, b)
        self.zero = (a + 0.5) / (a + b + 1.0)
        if below is None:
            self.log, self.own = own, np.ones(len(a))
        else:
            self.log = np.logaddexp(own, below) - math.log(2)
            self.own = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def trees(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> Iterator[tuple]:
    """For each of the eight bits: runs of the keys, levels from ``depth`` down to ``top``, and the maps between.

    ``keys`` are sorted.  Yields (bit, run of each key, codes of the top nodes, levels, maps).
    """
    for bit in range(8):
        node = keys >> (8 - bit)
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        run = np.cumsum(np.concatenate([[False], node[1:] != node[:-1]]))
        one = (keys >> (7 - bit)) & 1 == 1
        a, b = (np.add.reduceat(np.where(w, counts, 0), start) for w in (~one, one))
        head = keys[start]
        prefix = (1 << bit) | ((head & 255) >> (8 - bit))
        context = head >> 8
        levels, maps = [Level(a, b, None)], []
        for d in range(depth - 1, top - 1, -1):
            context >>= 8
            codes, to = np.unique(context << 8 | prefix, return_inverse=True)
            low = levels[-1]
            add = lambda x, to=to, n=len(codes): np.bincount(to, x, n)
            levels.append(Level(add(low.a).astype(np.int64), add(low.b).astype(np.int64), add(low.log)))
            maps.append(to)
            context, prefix = codes >> 8, codes & 255
        yield bit, run, context << 8 | prefix, levels, maps


class Top:
    """The nodes of depth TOP and less, from the sums of the depth below."""

    def __init__(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, log: np.ndarray):
        self.codes, self.levels, self.maps = codes, [Level(a, b, log)], []
        for _ in range(TOP):
            codes, to = np.unique(codes >> 16 << 8 | codes & 255, return_inverse=True)
            low = self.levels[-1]
            add = lambda x, to=to, n=len(codes): np.bincount(to, x, n)
            self.levels.append(Level(add(low.a).astype(np.int64), add(low.b).astype(np.int64), add(low.log)))
            self.maps.append(to)

    def mixed(self, codes: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Probability of a zero at nodes of depth TOP whose longer contexts say ``zero``."""
        at = np.searchsorted(self.codes, codes)
        for level, to in zip(self.levels, [*self.maps, None], strict=True):
            zero = level.own[at] * level.zero[at] + (1 - level.own[at]) * zero
            at = at if to is None else to[at]
        return zero


def top_sums(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Codes of the nodes of depth TOP, with the sums over their longer contexts in these keys."""
    out = []
    for _, _, codes, levels, _ in trees(keys, counts, depth, TOP + 1):
        up, to = np.unique(codes >> 16 << 8 | codes & 255, return_inverse=True)
        low = levels[-1]
        out.append((up, *(np.bincount(to, x, len(up)) for x in (low.a, low.b, low.log))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def log_probabilities(keys: np.ndarray, counts: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """Log10 of the probability of the last byte of each run after its context."""
    out = np.zeros(len(keys))
    for bit, run, codes, levels, maps in trees(keys, counts, depth, TOP + 1):
        zero, at = levels[0].zero, np.arange(len(levels[0].a))
        for level, to in zip(levels[1:], maps, strict=True):
            at = to[at]
            zero = level.own[at] * level.zero[at] + (1 - level.own[at]) * zero
        code = codes[at]
        zero = top.mixed(code >> 16 << 8 | code & 255, zero)
        one = (keys >> (7 - bit)) & 1 == 1
        out += np.log10(np.where(one, 1 - zero[run], zero[run]))
    return out


class Values:
    """Open-addressed table of key -> number for many look-ups at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, len(keys).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        spot, left = self._spot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[spot[left]] == -1]
            self.keys[spot[free]] = keys[free]  # of several, the last stays
            self.values[spot[free]] = values[free]
            won = self.keys[spot[left]] == keys[left]
            self.values[spot[left[won]]] = values[left[won]]
            left = left[~won]
            spot[left] = (spot[left] + 1) & self.mask

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        spot = self._spot(keys)
        out, left = self.values[spot], np.flatnonzero(self.keys[spot] != keys)
        while len(left):
            spot[left] = (spot[left] + 1) & self.mask
            found = self.keys[spot[left]]
            if (found == -1).any():
                raise RuntimeError("a block asks for a run that it did not report")
            hit = found == keys[left]
            out[left[hit]] = self.values[spot[left[hit]]]
            left = left[~hit]
        return out


# --- jobs -----------------------------------------------------------------------------------

def _reported(rows: DataFrame, depth: int) -> DataFrame:
    """block, key, n of every distinct run (key >= 0) and word (key < 0) of a block."""
    def report(stream):
        hashes, block, found = WordHashes(), None, Distinct()

        def rows_of():
            keys, n = found.merged()
            for s in range(0, len(keys), 200_000):
                part = keys[s:s + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(part),
                                                  pa.array(n[s:s + 200_000])], ["block", "key", "n"])

        for batch, values in batches(stream, size=CHUNK):
            blocks = batch.column(3).to_numpy()
            train = ~np.array(batch.column(2).to_pylist(), bool)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if block is not None and blocks[a] != block:
                    yield from rows_of()
                    found = Distinct()
                block = int(blocks[a])
                lower = [v.lower() for v in values[a:b]]
                for keys, starts in (byte_runs(lower, depth), word_keys(lower, hashes)):
                    found.add(keys, np.repeat(train[a:b], np.diff(starts)))
        if block is not None:
            yield from rows_of()

    return rows.mapInArrow(report, "block bigint, key bigint, n bigint")


def _table(stream) -> tuple[np.ndarray, np.ndarray]:
    parts = [b for b in stream if b.num_rows]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = pa.Table.from_batches(parts)
    keys, n = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _model(counts: DataFrame, depth: int) -> DataFrame:
    """key and value (log10 probability) of every run."""
    spark = counts.sparkSession
    # by the nearest bytes of context, one more than the top has
    dealt = counts.where("key >= 0").repartition(F.shiftright("key", 8 * (depth - TOP)))

    def sums(stream):
        keys, n = _table(stream)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in top_sums(keys, n, depth)], ["code", "a", "b", "log"])

    # the two nearest bytes, seen together, times the nodes of a byte: 16.7 million rows for any corpus
    rows = (dealt.mapInArrow(sums, "code bigint, a double, b double, log double").groupBy("code")
            .agg(*[F.sum(c).alias(c) for c in ("a", "b", "log")]).toArrow().sort_by("code"))
    top = spark.sparkContext.broadcast(Top(rows["code"].to_numpy(), rows["a"].to_numpy().astype(np.int64),
                                           rows["b"].to_numpy().astype(np.int64), rows["log"].to_numpy()))

    def value(stream):
        keys, n = _table(stream)
        if len(keys):
            yield from pa.table([keys, log_probabilities(keys, n, depth, top.value)], ["key", "value"]).to_batches(200_000)

    return dealt.mapInArrow(value, "key bigint, value double")


def scores(docs: DataFrame, held_out: Callable[[Column], Column], depth: int = 5, stored: bool = True,
           text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``stored``: the documents are a plain read of files, so a row's file split names its block;
    with False they are written first.
    """
    if not TOP < depth <= 6:
        raise ValueError("depth: 3 to 6 bytes")
    spark = docs.sparkSession
    rows = texts(docs, held_out_flag(held_out, id), text=text, id=id)
    if not stored:
        rows = written(rows, "texts")
    rows = rows.withColumn("block", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    reported = written(_reported(rows, depth), "reported")
    counts = written(reported.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    total, distinct = counts.where("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    model = written(_model(counts, depth).unionByName(counts.where("key < 0").select("key", F.col("n").cast("double").alias("value"))), "model")
    folder = new_folder(spark, "answers")
    (reported.select("block", "key").join(model, "key").select("block", "key", "value")
     .repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(folder))
    base = math.log10(total + 0.5 * (distinct + 1))

    def score(stream):
        import pyarrow.dataset as ds
        from pyarrow import fs
        hashes, block, table = WordHashes(), None, None
        store, root = fs.FileSystem.from_uri(folder)
        for batch, values in batches(stream, size=CHUNK):
            blocks = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[a] != block:
                    block = blocks[a]
                    got = ds.dataset(f"{root}/block={block}", filesystem=store, format="parquet").to_table(["key", "value"])
                    table = Values(got["key"].to_numpy(), got["value"].to_numpy())
                    del got
                lower = [v.lower() for v in values[a:b]]
                keys, starts = byte_runs(lower, depth)
                own = np.add.reduceat(table(keys), starts[:-1])
                size = np.diff(starts)
                keys, starts = word_keys(lower, hashes)
                c = table(keys)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(starts)), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts[:-1])),
                     pa.array(np.full(b - a, total, np.int64)), pa.array(np.add.reduceat(np.log10(c + 0.5) - base, starts[:-1])),
                     pa.array(own), pa.array(-own * math.log2(10) / size)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                  "base_score double, score double, bits_per_byte double")
