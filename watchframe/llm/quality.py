"""Operator 9, quality classifier on random-indexing word vectors.

Tokens are runs of letters and digits and runs of other signs, hashed into a fixed number of
slots.  Each slot has a sparse random index vector; its word vector is the sum of the index
vectors of its neighbours over all documents, counted per task and added up block by block.
A document is the mean of its tokens' vectors.  A two-layer network in numpy is fitted on a
bounded sample of labelled documents (``sample_rows``) and calibrated by a temperature on a
part of the sample that the fit did not see; every document is then scored in one map.

The slot table has 2**15 x 32 numbers whatever the corpus.  Null and empty texts have the zero
vector before scaling and are scored like any other; without labels of both classes the score
is the labels' share (1/2 without labels).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from watchframe.llm.common import batches, block_sums, texts
from watchframe.llm.labelled import held_out_flag, labelled_sample
from watchframe.llm.words import ALNUM, RunHashes

SLOTS, WIDTH, NONZERO, REACH = 1 << 15, 32, 2, 2
#: Kind of each byte: blank, letter or digit (or beyond ASCII), other sign.
KIND = bytes(0 if b in b" \t\n\r\f\v" else 1 if ALNUM[b] != 32 else 2 for b in range(256))
CHUNK, POOLED = 1 << 20, 1 << 17


class Tokens:
    """Slots of the tokens of texts, A-Z lower-cased."""

    def __init__(self):
        self.runs = RunHashes()

    def __call__(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all texts in a row, and where each text starts and the last ends."""
        joined = b" ".join([b"", *values, b""]).lower()
        kind = np.frombuffer(joined.translate(KIND), np.uint8)
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        full = np.flatnonzero(kind[edge[:-1]])
        start, end = edge[full], edge[full + 1]
        hashes = self.runs(np.frombuffer(joined, np.uint8), start, end)
        starts = np.searchsorted(start, np.cumsum([1, *(len(v) + 1 for v in values)]))
        return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), starts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each slot's random index vector."""
    r = np.random.Generator(np.random.PCG64(9))
    return r.integers(0, WIDTH, (SLOTS, NONZERO)), r.choice([-1.0, 1.0], (SLOTS, NONZERO))


def count_contexts(stream) -> np.ndarray:
    """Sum of the neighbours' index vectors for each slot; the last SLOTS entries count the slots."""
    places, signs = index_vectors()
    tokens, size = Tokens(), SLOTS * WIDTH
    total = np.zeros(size)
    seen = np.zeros(SLOTS, np.int64)
    for _, values in batches(stream, size=2 * CHUNK):
        slots, starts = tokens(values)
        seen += np.bincount(slots, minlength=SLOTS)
        text = np.repeat(np.arange(len(values)), np.diff(starts))
        for off in range(1, REACH + 1):
            same = text[off:] == text[:-off]
            a, b = slots[:-off][same], slots[off:][same]
            word, near = np.concatenate([a, b]), np.concatenate([b, a])
            for j in range(NONZERO):
                total += np.bincount(word * WIDTH + places[near, j], signs[near, j], size)
    return np.concatenate([total.astype(np.int64), seen])


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors of the slots, less the mean over all tokens; zero for slots never seen."""
    vectors, seen = sums[:SLOTS * WIDTH].reshape(SLOTS, WIDTH).astype(float), sums[SLOTS * WIDTH:]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    if seen.sum():
        vectors -= (vectors * seen[:, None]).sum(0) / seen.sum()
    vectors[seen == 0] = 0
    return vectors.astype(np.float32)


def pooled(vectors: np.ndarray, tokens: Tokens, values: list[bytes]) -> np.ndarray:
    """Mean vector of the tokens of each text; long texts in pieces of ``POOLED`` tokens."""
    slots, starts = tokens(values)
    size = np.diff(starts)
    cuts = -(-size // POOLED)  # pieces of each text
    row = np.repeat(np.arange(len(values)), cuts)
    begin = starts[row] + POOLED * (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    end, out, at = np.append(begin[1:], starts[-1]), np.zeros((len(values), WIDTH)), 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(end, begin[at] + POOLED, "right")))
        some = vectors[slots[begin[at]:end[stop - 1]]]
        np.add.at(out, row[at:stop], np.add.reduceat(some, begin[at:stop] - begin[at], axis=0, dtype=float))
        at = stop
    return out / np.maximum(size, 1)[:, None]


class Network:
    """Two layers: tanh units, one logit; scaled inputs, temperature.

    With a single label among the examples, or fewer than ten, every score is the share of label 1 (0.5 without any).
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 16, steps: int = 3000, batch: int = 256, seed: int = 3):
        self.share = float(y.mean()) if len(y) else 0.5
        self.ready = len(np.unique(y)) == 2 and len(y) >= 10
        if not self.ready:
            return
        r = np.random.Generator(np.random.PCG64(seed))
        order = r.permutation(len(y))
        test, fit = order[:max(2, len(y) // 5)], order[max(2, len(y) // 5):]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
             r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, steps + 1):
            k = r.choice(fit, min(batch, len(fit)), replace=False)
            h = np.tanh(z[k] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[k]) / len(k)
            back = np.outer(error, p[2]) * (1 - h * h)
            for i, g in enumerate((z[k].T @ back + 1e-4 * p[0], back.sum(0), h.T @ error + 1e-4 * p[2], error.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit = self.logit(x[test])
        loss = {t: np.logaddexp(0, np.where(y[test] == 1, -logit, logit) / t).mean() for t in np.geomspace(0.25, 8, 41)}
        self.temperature = float(min(loss, key=loss.get))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def scores(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable[[Column], Column],
           threshold: float = 0.5, sample_rows: int = 20_000, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted."""
    spark = docs.sparkSession
    rows = texts(docs, text=text, id=id)
    sums = block_sums(rows, count_contexts, SLOTS * WIDTH + SLOTS, 128)
    vectors = spark.sparkContext.broadcast(word_vectors(sums))  # 4 MB

    def features(stream):
        tokens = Tokens()
        for batch, values in batches(stream, size=CHUNK):
            x = pooled(vectors.value, tokens, values)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    sample = labelled_sample(docs, labels, label, held_out, sample_rows, text, id).mapInArrow(
        features, "label int, x array<double>").toArrow()
    x = np.array(sample["x"].to_pylist(), float).reshape(-1, WIDTH)
    y = sample["label"].to_numpy().astype(int)
    order = np.lexsort((*x.T, y))  # the rows come in any order
    model = spark.sparkContext.broadcast(Network(x[order], y[order]))

    def score(stream):
        tokens = Tokens()
        for batch, values in batches(stream, size=CHUNK):
            s = model.value.score(pooled(vectors.value, tokens, values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return texts(docs, held_out_flag(held_out, id), text=text, id=id).mapInArrow(
        score, "doc_id bigint, held_out boolean, score double, predicted int")
