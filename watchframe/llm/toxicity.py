"""Operator 10, toxicity by the nearest labelled examples in TF-IDF cosine, from a block-max index.

Features are words (letters, digits and bytes beyond ASCII; A-Z lower-cased), known by 51-bit hashes.  All of those in the sample of examples have document counts taken over all documents;
others count as never seen, with the largest weight of their kind.  The ones that go with a label
(chi-square) have full weight, the rest ``rest`` of it, none has no weight.  The length of a text
is that of all its features.

The index.  Examples are put in an order of similar ones and cut into blocks.  Features that many
examples have are lists cut at the blocks, each piece with its largest weight; the others are
short lists of a single piece.  A text reads its short lists first, adds the largest weights of
the long ones to get a bound for every block, scores its best blocks, and skips all blocks whose
bound is below its k-th best cosine by then.  What is scored near the k-th best is summed again in
double precision, so the nearest ``k`` are exact (for weights of the examples kept in single).  Votes weighted by closeness, shrunk towards the
share of the label among examples without features, give the score; the nearest examples are the
evidence.

The examples are a bounded sample (``sample_rows``, ``sample_bytes``), which bounds their
features; everything else runs over whole texts of all documents, row-local.  Null and empty texts
have no features and get that share; so does everything if there are no examples (0.5 then).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.llm.common import batches, block_sums, give_back, new_stage, texts
from watchframe.llm.labelled import held_out_flag, labelled_sample
from watchframe.llm.words import ALNUM, RunHashes

#: Weight of features that do not go with a label, against 1 of those that do: words alone and this weight gave the
#: least log loss among four kinds of features (with and without beginnings of words) and eight weights in three inner
#: folds of the learning rows of the test table (see the README on how it was chosen).
REST = 0.1
#: Upper bits of a word's hash that are kept.
KEPT = 51
#: Rows that are hashed at once at the most; their numbers go above a hash.
ROWS = 1 << (63 - KEPT)


#: Bytes of text that are hashed, and that are scored at once.
PIECE, SCORED = 1 << 18, 1 << 19


class Words:
    """Hashes of the words of texts."""

    def __init__(self):
        self.runs = RunHashes(PIECE)

    def __call__(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The row and hash of every word, in order."""
        raw = np.frombuffer(b" ".join([b"", *(v.translate(ALNUM) for v in values), b""]), np.uint8)
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        hashes = self.runs(raw, start, end) >> np.uint64(64 - KEPT)
        begins = np.cumsum([1, *(len(v) + 1 for v in values)])[:-1]
        return np.searchsorted(begins, start, "right") - 1, hashes


#: Bytes that the document counts of the features may take on the driver.
COUNTED = 256 << 20


class Counts:
    """Features of some texts, text by text: how many each has, which (ascending but for unknown ones), and how often."""

    def __init__(self, sizes: np.ndarray, f: np.ndarray, n: np.ndarray):
        self.sizes, self.f, self.n = sizes, f, n

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def parts(self, size: int) -> Iterator[tuple[int, Counts]]:
        """The number of the first text and the counts of some texts, with ``size`` counts or one text at the most."""
        ends, at = np.cumsum(self.sizes), 0
        while at < len(self.sizes):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            span = slice(before, int(ends[stop - 1]))
            yield at, Counts(self.sizes[at:stop], self.f[span], self.n[span])
            at = stop

    @classmethod
    def of(cls, texts: list[dict[int, int]]) -> Counts:
        pairs = [sorted(t.items()) for t in texts]
        flat = np.array([p for t in pairs for p in t], np.int64).reshape(-1, 2)
        return cls(np.array([len(t) for t in pairs], np.int64), flat[:, 0], flat[:, 1])


class Features:
    """Counts features by their place among the sorted hashes of the examples' features; all others have the next number."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.words = hashes, Words()

    def __reduce__(self):
        return Features, (self.hashes,)

    def __call__(self, values: list[bytes]) -> Counts:
        sizes, fs, ns, at = [], [], [], 0
        ends = np.cumsum([len(v) for v in values])
        while at < len(values):
            before = int(ends[at - 1]) if at else 0
            stop = min(max(at + 1, int(np.searchsorted(ends, before + PIECE, "right"))), at + ROWS)
            row, h = self.words(values[at:stop])
            key = row.astype(np.uint64) << np.uint64(KEPT) | h
            key.sort()
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            found = key[cut] & np.uint64((1 << KEPT) - 1)
            place = np.searchsorted(self.hashes, found)
            if len(self.hashes):
                place[self.hashes[np.minimum(place, len(self.hashes) - 1)] != found] = len(self.hashes)
            fs.append(place)
            ns.append(np.diff(cut, append=len(key)))
            sizes.append(np.bincount((key[cut] >> np.uint64(KEPT)).astype(np.int64), minlength=stop - at))
            at = stop
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return Counts(join(sizes), join(fs), join(ns))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2 ** 31 and int(start.max(initial=0)) < 2 ** 31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((start - (ends - size)).astype(kind), size)


class Examples:
    """Unit TF-IDF vectors of the examples in a block-max index; exact nearest neighbours."""

    LONG, BLOCK, TEXTS, FIRST = 768, 128, 32, 2
    #: Counts that are indexed at once; the rest of the memory is the index and the packed counts.
    AT_ONCE = 1 << 17
    #: Texts of a group whose short lists are read at once.
    SOME = 8

    def __init__(self, ids: np.ndarray, labels: np.ndarray, counts: Counts | PackedCounts, idf: np.ndarray, other: float, k: int = 25):
        """``idf``: weight of each feature of the examples, ``other`` that of every other one."""
        self.labels, self.idf, self.other, self.k = np.asarray(labels, float), idf, other, k
        self.ids = np.asarray(ids, np.int64)
        n = len(self.ids)
        lone = self.labels[counts.sizes == 0]
        self.share = float((lone.sum() + (self.labels.mean() if n else 0.5)) / (len(lone) + 1))
        # the longest lists are cut at the blocks; similar examples stand together, by their heaviest long features
        held = np.zeros(len(idf), np.int64)
        for _, part in counts.parts(self.AT_ONCE):
            held += np.bincount(part.f, minlength=len(idf))
        long = np.sort(np.argsort(-held, kind="stable")[:self.LONG])
        self.column = np.full(len(idf) + 1, -1, np.int32)
        self.column[long] = np.arange(len(long))
        self.blocks = -(-n // self.BLOCK)
        heavy = np.full((n, 3), -1, np.int32)
        for first, part in counts.parts(self.AT_ONCE):
            at = self.column[part.f]
            cut = np.flatnonzero(at >= 0)
            rows = len(part.sizes)
            heavy[first:first + rows] = _heaviest(rows, part.row[cut], at[cut], self._unit(part, np.float32)[cut])
        main = np.lexsort(heavy.T[::-1])
        self.place = np.concatenate([main, np.arange(n, self.blocks * self.BLOCK)])  # which example stands where
        spot = np.empty(len(self.place), np.int32)
        spot[self.place] = np.arange(len(self.place))
        wide = np.zeros((len(self.place), len(long)), np.float32)
        held[long] = 0
        self.start = np.concatenate([[0], np.cumsum(held), [held.sum()]])
        self.listed, self.weight = np.empty(self.start[-1], np.int32), np.empty(self.start[-1], np.float32)
        free = self.start[:-1].copy()  # where the next example of a short list goes
        for first, part in counts.parts(self.AT_ONCE):
            at, w, e = self.column[part.f], self._unit(part, np.float32), spot[first + part.row]
            cut = np.flatnonzero(at >= 0)
            wide[e[cut], at[cut]] = w[cut]
            rest = np.flatnonzero(at < 0)
            rest = rest[np.argsort(part.f[rest], kind="stable")]
            some, size = np.unique(part.f[rest], return_counts=True)
            to = _ranges(free[some], size)
            self.listed[to], self.weight[to] = e[rest], w[rest]
            free[some] += size
        self.wide = wide.reshape(self.blocks, self.BLOCK, len(long))
        self.largest = self.wide.max(1, initial=0)  # of each long list, per block
        self.scored = self.skipped = 0

    def _unit(self, counts: Counts, kind: type = np.float64) -> np.ndarray:
        """Weights of the features of each text, at length one over all of its features."""
        w = np.log(counts.n, dtype=kind)
        w += 1
        w *= np.append(self.idf, self.other).astype(kind).take(counts.f, mode="clip")
        full = counts.sizes > 0
        starts = (np.cumsum(counts.sizes) - counts.sizes)[full]
        if len(starts):
            lengths = np.maximum(1e-12, np.sqrt(np.add.reduceat(w * w, starts, dtype=np.float64))).astype(kind)
            w /= np.repeat(lengths, counts.sizes[full])
        return w

    def nearest(self, counts: Counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text: positions and cosines of the k nearest examples with a cosine above 0; ties by position."""
        w, ends = self._unit(counts), np.cumsum(counts.sizes)
        known, row = counts.f < len(self.idf), counts.row
        for a in range(0, len(counts.sizes), self.TEXTS):
            z = min(a + self.TEXTS, len(counts.sizes))
            span = slice(int(ends[a] - counts.sizes[a]), int(ends[z - 1]))
            some = known[span]
            yield from self._group(z - a, row[span][some] - a, counts.f[span][some], w[span][some])

    def _group(self, texts: int, row: np.ndarray, f: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.blocks:
            yield from [(np.zeros(0, np.int64), np.zeros(0))] * texts
            return
        width, at = self.blocks * self.BLOCK, self.column[f]
        query = np.zeros((texts, self.wide.shape[2]))
        query[row[at >= 0], at[at >= 0]] = w[at >= 0]
        rough = query.astype(np.float32)
        row, f, w = row[at < 0], f[at < 0], w[at < 0]
        size = self.start[f + 1] - self.start[f]
        short = np.zeros((texts, width))
        for first in range(0, texts, self.SOME):
            span, some = slice(*np.searchsorted(row, (first, first + self.SOME)).tolist()), short[first:first + self.SOME]
            found = _ranges(self.start[f[span]], size[span])
            spots = np.repeat(((row[span] - first) * width).astype(np.int32), size[span]) + self.listed[found]
            some[:] = np.bincount(spots, np.repeat(w[span].astype(np.float32), size[span]) * self.weight[found], some.size).reshape(some.shape)
        short = short.reshape(texts, self.blocks, self.BLOCK)
        # a sum of m products in single precision is off by less than m * 2**-23 times both lengths
        doubt = (2 * self.LONG * 2.0 ** -23) * np.sqrt((query * query).sum(1)) + 2.0 ** -22
        bound = short.max(2) + rough @ self.largest.T + 2 * doubt[:, None]
        total = np.zeros_like(short)
        best = np.argpartition(-bound, min(self.FIRST, self.blocks) - 1, 1)[:, :self.FIRST]
        take = np.zeros(bound.shape, bool)
        take[np.arange(texts)[:, None], best] = True
        take &= bound > 2 * doubt[:, None]
        self._score(take, rough, short, total)
        floor = np.zeros(texts)
        if self.FIRST * self.BLOCK >= self.k and self.blocks >= self.FIRST:
            seen = np.take_along_axis(total, best[:, :, None], 1).reshape(texts, -1)
            floor = np.partition(seen, -self.k, 1)[:, -self.k]
        rest = (bound >= np.maximum(floor - doubt, 2 * doubt)[:, None]) & ~take
        self._score(rest, rough, short, total)
        self.scored += int(take.sum() + rest.sum())
        self.skipped += bound.size - int(take.sum() + rest.sum())
        total = total.reshape(texts, width)
        for t in range(texts):
            v = total[t]
            least = np.partition(v, -self.k)[-self.k] if width > self.k else 0.0
            spots = np.flatnonzero((v > 0) & (v >= least - 2 * doubt[t]))
            sums = short[t].ravel()[spots] + self.wide.reshape(width, -1)[spots] @ query[t]
            e = self.place[spots]
            order = np.lexsort((e, -sums))[:self.k]
            yield e[order], sums[order]

    def _score(self, take: np.ndarray, rough: np.ndarray, short: np.ndarray, total: np.ndarray) -> None:
        for b, some in enumerate(take.sum(0).tolist()):
            if 2 * some > len(take):  # most of the texts need the block: one product of all is cheaper
                total[:, b] = short[:, b] + rough @ self.wide[b].T
            elif some:
                t = np.flatnonzero(take[:, b])
                total[t, b] = short[t, b] + rough[t] @ self.wide[b].T

    def votes(self, counts: Counts) -> list[tuple[float, list[tuple[int, float]]]]:
        out = []
        for e, s in self.nearest(counts):
            w = s * s
            score = (float(w @ self.labels[e]) + 0.05 * self.share) / (float(w.sum()) + 0.05)
            out.append((score, list(zip(self.ids[e[:5]].tolist(), s[:5].tolist(), strict=True))))
        return out


def _heaviest(n: int, e: np.ndarray, column: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The columns of the three largest weights of each row (-1 for none), from entries sorted by row."""
    column = column[np.lexsort((column, -w, e))]
    held = np.bincount(e, minlength=n)
    first = np.cumsum(held) - held
    out = np.full((n, 3), -1, np.int32)
    for j in range(3):
        out[held > j, j] = column[first[held > j] + j]
    return out


class PackedCounts:
    """Counts in compressed parts, taken out one at a time."""

    def __init__(self, sizes: np.ndarray, packed: list[tuple[int, int, bytes, bytes]]):
        self.sizes, self.packed = sizes, packed

    @classmethod
    def of(cls, counts: Counts, size: int) -> PackedCounts:
        small = lambda x: pa.compress(np.ascontiguousarray(x, np.int32).tobytes(), "zstd", asbytes=True)
        return cls(counts.sizes, [(first, first + len(part.sizes), small(np.diff(part.f, prepend=0)), small(part.n))
                                  for first, part in counts.parts(size)])

    def parts(self, size: int) -> Iterator[tuple[int, Counts]]:
        """The parts as they were cut."""
        for first, stop, *columns in self.packed:
            sizes = self.sizes[first:stop]
            f, n = (np.frombuffer(pa.decompress(x, 4 * int(sizes.sum()), "zstd", asbytes=True) if sizes.any() else b"", np.int32) for x in columns)
            yield first, Counts(sizes, np.cumsum(f, dtype=np.int32), n)


class Packed:
    """Examples on their way to the tasks: counts of features, compressed; the index is built where they are unpickled."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, counts: Counts, *more):
        self.state = ids, labels, counts.sizes, PackedCounts.of(counts, Examples.AT_ONCE).packed, *more

    def __reduce__(self):
        return Packed.unpacked, self.state

    @staticmethod
    def unpacked(ids, labels, sizes, packed: list, *more) -> Examples:
        examples = Examples(ids, labels, PackedCounts(sizes, packed), *more)
        give_back()
        return examples


def _terms(sample: DataFrame, chi_square: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features of the sample, sorted, and which go with a label: chi-square of presence, in ``least`` examples at the least."""
    def presence(stream):
        words = Words()
        for batch, values in batches(stream, size=1 << 18):
            sets = [np.unique(words([value])[1]) for value in values]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)),
                                              pa.array(np.repeat(np.array(batch.column(1).to_pylist(), np.int32), list(map(len, sets))))], ["f", "y"])

    distinct = sample.groupBy(F.sha2("text", 256)).agg(F.max_by("text", "label").alias("text"), F.max("label").alias("label"))
    n, ones = distinct.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    a, k = F.col("a"), F.col("n")
    marks = F.lit(False)
    if 0 < ones < n:
        expected = k * (ones / n)
        marks = (k >= least) & ((a - expected) ** 2 / (expected * (1 - ones / n) * (1 - k / (n + 1.0))) >= chi_square)
    counts = (distinct.select("text", "label").select(F.lit(0).alias("z"), "label", "text").mapInArrow(presence, "f bigint, y int")
              .groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("n")))
    found = counts.select("f", marks.alias("marks")).toArrow()
    hashes, marked = found["f"].to_numpy().view(np.uint64), found["marks"].to_numpy().astype(bool)
    order = np.argsort(hashes)
    return hashes[order], marked[order]


def scores(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable[[Column], Column], threshold: float = 0.5,
           sample_rows: int = 10_000, k: int = 25, chi_square: float = 30.0, least: int = 3,
           text: str = "text", id: str = "doc_id", rest: float = REST, sample_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted, evidence (ids and cosines of nearest examples)."""
    known, model = fitted(docs, labels, label, held_out, sample_rows, k, chi_square, least, text, id, rest, sample_bytes)

    def score(stream):
        new_stage()
        features, examples = known.value, model.value
        for batch, values in batches(stream, size=SCORED):
            votes = examples.votes(features(values))
            s = [x for x, _ in votes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()),
                 pa.array([[{"doc_id": i, "cosine": c} for i, c in e] for _, e in votes],
                          pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))],
                ["doc_id", "held_out", "score", "predicted", "evidence"])

    return texts(docs, held_out_flag(held_out, id), text=text, id=id).mapInArrow(
        score, "doc_id bigint, held_out boolean, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double>>")


def fitted(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable[[Column], Column], sample_rows: int = 10_000,
           k: int = 25, chi_square: float = 30.0, least: int = 3, text: str = "text", id: str = "doc_id", rest: float = REST,
           sample_bytes: int = 64 << 20):
    """Broadcast features and examples."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, held_out, sample_rows, text, id, max_bytes=sample_bytes)
    hashes, marks = _terms(sample, chi_square, least)
    width = len(hashes) + 1
    known = spark.sparkContext.broadcast(Features(hashes))  # 8 bytes a feature

    def example(stream):
        new_stage()
        features = known.value
        for batch, values in batches(stream):
            counts = features(values)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts.sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (counts.f, counts.n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *lists], ["doc_id", "label", "tie", "f", "n"])

    def document_counts(stream):
        new_stage()
        features, total = known.value, np.zeros(width, np.int64)
        for _, values in batches(stream):
            f = features(values).f
            total[:-1] += np.bincount(f[f < width - 1], minlength=width - 1)
            total[-1] += len(values)
        return total

    counted = block_sums(texts(docs, text=text, id=id), document_counts, width, 16, limit=COUNTED)
    idf = np.log((1 + counted[-1]) / (1 + counted)) + 1e-3
    other = float(np.log(1 + counted[-1]) + 1e-3) * rest
    idf = idf[:-1] * np.where(marks, 1.0, rest)
    rows = (sample.select("doc_id", "label", "text", F.xxhash64("text").alias("tie"))
            .mapInArrow(example, "doc_id bigint, label int, tie bigint, f array<int>, n array<int>").toArrow())
    rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("label", "ascending"), ("tie", "ascending")]))
    f, n = rows["f"].combine_chunks(), rows["n"].combine_chunks()
    counts = Counts(pc.list_value_length(f).to_numpy().astype(np.int64), f.flatten().to_numpy(), n.flatten().to_numpy())
    examples = Packed(rows["doc_id"].to_numpy(), rows["label"].to_numpy().astype(float), counts, idf, other, k)
    return known, spark.sparkContext.broadcast(examples)


def without_toxic(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable[[Column], Column], threshold: float = 0.5,
                  text: str = "text", id: str = "doc_id", **fit) -> DataFrame:
    """The documents scored below the threshold; columns as they were, one map, no shuffle."""
    known, model = fitted(docs, labels, label, held_out, text=text, id=id, **fit)

    def keep(stream):
        new_stage()
        features, examples = known.value, model.value
        for batch in stream:
            for part, values in batches([batch], text, SCORED):
                clean = [s < threshold for s, _ in examples.votes(features([v or b"" for v in values]))]
                if any(clean):
                    yield part.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
