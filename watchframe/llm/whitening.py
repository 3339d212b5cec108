"""Operator 12, embedding whitening by shifted CholeskyQR.

Vectors are integers (``vectors.integer_vectors``).  The distinct ones are centred on their mean,
and their matrix X is brought to orthonormal columns in passes over the table: each pass sums the
Gram matrix of the rows times the inverse of the triangular factors so far (triangular solves in
the tasks), and the driver factors it by Cholesky.  The first pass adds a shift to the diagonal,
which keeps the factorisation alive for any condition; the later ones mend what the shift changed.
X = Q R with R the product of the factors, so the singular values and right vectors of R are
those of X: components of the covariance X'X / n without its squared condition number.  If columns
are dependent, Q'Q tends to a projection instead of the identity, and its root goes into R.

Rows without a complete finite vector, and those of another length than most, have no result.
Components without variance are left out; so a table of equal vectors, or an empty one, gives no
rows.  Repeated rows count once in the fit and each get their result; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from watchframe.llm.common import written
from watchframe.llm.vectors import integer_vectors, matrices, summed

EPS = float(np.finfo(float).eps)
#: Q'Q may differ from a projection by this; passes at most.
CLOSE, PASSES = 1e-12, 8


@dataclass
class Whitening:
    """The fit: number of vectors, exact sums, unit components (columns), their variances, the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact; raises if it needs more than 63 bits."""
        reach = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        if reach ** 2 * x.shape[1] < 2 ** 63:
            d = self.n * x - self.sums
            return (d * d).sum(1)
        d = self.n * x.astype(object) - self.sums.astype(object)
        total = (d * d).sum(1)
        if max(total) >= 2 ** 63:
            raise OverflowError("a deviation needs more than 63 bits")
        return total.astype(np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n; the whole part of the mean goes first, so nothing is lost where the mean is large."""
    whole = sums // n
    return (x - whole).astype(float) - (sums - whole * n) / n


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverses of upper triangular factors, by forward substitution in their order."""
    q = rows.copy()
    for r in factors:
        for j in range(len(r)):
            if j:
                q[:, j] -= q[:, :j] @ r[:j, j]
            q[:, j] /= r[j, j]
    return q


def _gram(fit: DataFrame, n: int, sums: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    d = len(sums)

    def per_task(stream):
        total = np.zeros((d, d))
        for _, x in matrices(stream):
            q = solved(_centred(x, n, sums), factors)
            total += q.T @ q
        return total.ravel()

    gram = summed(fit, per_task, d * d).reshape(d, d).astype(float)
    return (gram + gram.T) / 2


def triangular_factors(gram: Callable[[list[np.ndarray]], np.ndarray], n: int, d: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Factors of the passes, and the Gram matrix of the rows that they leave."""
    factors: list[np.ndarray] = []
    for _ in range(PASSES):
        g = gram(factors)
        norm = float(np.linalg.norm(g, 2))
        if norm == 0:
            return factors, g
        values = np.linalg.eigvalsh(g)
        if len(factors) > 1 and np.minimum(np.abs(values - 1), np.abs(values)).max() < CLOSE * d:
            return factors, g
        # the shift of the first pass; later ones need one only where columns are dependent
        if not factors:
            shift = 11 * (n * d + d * (d + 1)) * EPS * norm
            shift = min(shift, norm * 1e-3)
        else:
            shift = 0.0 if values[0] > 1e-8 else 100 * d * EPS * norm
        factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
    return factors, gram(factors)


def fitted(fit: DataFrame, components: int) -> Whitening | None:
    """The whitening of a table of distinct vectors ``x``; None without any variance."""
    first = fit.first()
    if first is None:
        return None
    d = len(first.x)

    def moments(stream):
        total = np.zeros(d + 1, np.int64)
        for _, x in matrices(stream):
            total += np.append(x.sum(0), len(x))
        return total

    *sums, n = summed(fit, moments, d + 1).tolist()
    sums = np.array(sums, np.int64)
    factors, g = triangular_factors(lambda f: _gram(fit, n, sums, f), n, d)
    values, vectors = np.linalg.eigh(g)
    r = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for f in reversed(factors):
        r = r @ f
    _, sigma, right = np.linalg.svd(r)
    variances = sigma ** 2 / n
    found = int((sigma > sigma[0] * EPS * max(d, 10) * 10).sum()) if sigma[0] > 0 else 0
    found = min(found, components)
    if not found:
        return None
    return Whitening(n, sums, right[:found].T.copy(), variances[:found], float(variances.sum()))


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    k = len(model.variances)

    def moments(stream):
        total = np.zeros(k * k + k)
        for _, x in matrices(stream):
            z = model.whitened(x)
            total += np.concatenate([(z.T @ z).ravel(), z.sum(0)])
        return total

    total = summed(fit, moments, k * k + k) / model.n
    second, mean = total[:k * k].reshape(k, k), total[k * k:]
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, components: int = 4, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """One row per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors = integer_vectors(rows, vector=vector, id=id)
    # one row per vector: partly summed before the shuffle, so a repeated vector is no hot key
    fit = written(vectors.select("x").groupBy("x").count().select("x"), "distinct-vectors")
    model = fitted(fit, components)
    if model is None:
        return spark.createDataFrame([], schema)
    k, error = len(model.variances), _identity_error(fit, model)
    shares = model.variances / model.trace
    sent = spark.sparkContext.broadcast(model)  # a few times d numbers

    def project(stream):
        for batch, x in matrices(stream):
            rows, own = len(x), sent.value
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, own.n, np.int64)),
                 pa.array(np.repeat(own.deviations(x), k)), pa.array(own.whitened(x).ravel()), pa.array(np.tile(shares, rows)),
                 pa.array(np.full(rows * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(project, schema)
