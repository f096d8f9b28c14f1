"""Whitening of embeddings along the principal components of their distinct vectors.

Counts and sums are exact integers.  The covariance is added up in the tasks from centred
vectors; the driver sees its d x d entries, splits them by `spectral.eigenvectors`, and sends
out a mean and k directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.frames import with_results
from scanmill.llm.numeric import INTEGERS, SUMS, added, exact_sums, matrix, of_one_length, with_integers
from scanmill.llm.spectral import eigenvectors
from scanmill.runtime import written

SCALE = 256
COMPONENTS = 4

# A task holds one covariance, 8 MB at this length.
MAX_DIMS = 1024
_SLICE = 4096


@dataclass(frozen=True)
class Whitening:
    """Counts and sums of the fit list, and the components found in it."""

    n: int
    sums: list[int]
    directions: np.ndarray  # (k, d) unit vectors
    values: np.ndarray  # (k,) eigenvalues, falling
    explained: np.ndarray  # (k,) share of the trace

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as 64-bit integers if they fit, else as Python's."""
        most = max((int(np.abs(vectors).max()) if vectors.size else 0), 1)
        if self.n * most + max((abs(s) for s in self.sums), default=0) < 1 << 63:
            return vectors * np.int64(self.n) - np.array(self.sums, np.int64)
        return vectors.astype(object) * self.n - np.array(self.sums, object)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """Projections of (n * x - S) / n, over the root of the eigenvalue; NaN where that is 0."""
        roots = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return ((centred / self.n).astype(np.float64) @ self.directions.T) / roots


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null where they do not fit 64 bits."""
    most = int(np.abs(centred).max()) if centred.size else 0
    if most * most * centred.shape[1] >= 1 << 63:
        centred = centred.astype(object)
    return [int(s) if s < 1 << 63 else None for s in (centred * centred).sum(axis=1)]


def _sliced(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    for batch in batches:
        _, vectors = matrix(batch.column(0), length)
        for start in range(0, len(vectors), _SLICE):
            yield vectors[start : start + _SLICE]


def _products(fit: DataFrame, length: int, size: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of y'y, where y = make(x) has `size` columns."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for vectors in _sliced(batches, length):
            y = make(vectors)
            total += y.T @ y
        at, value = np.arange(size * size, dtype=np.int32), total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value)], names=["at", "value"])

    sums = fit.mapInArrow(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros(size * size)
    for row in sums.collect():
        total[row["at"]] = row["value"]
    return total.reshape(size, size)


def fit_whitening(fit: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    """Components of a table of distinct vectors, held in its column `__integers`."""
    if length > MAX_DIMS:
        raise ValueError(f"vectors of {length} components, at most {MAX_DIMS} are whitened")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield exact_sums(
            (np.zeros(1, int), v.sum(axis=0)[None, :], np.array([len(v)])) for v in _sliced(batches, length)
        )

    sums, n = added(fit.mapInArrow(partial, SUMS)).get(0, ([], 0))
    if not n:
        return Whitening(0, [], np.zeros((0, length)), np.zeros(0), np.zeros(0))
    plain = Whitening(n, sums, np.zeros((0, length)), np.zeros(0), np.zeros(0))
    products = _products(fit, length, length, lambda v: (plain.centred(v) / n).astype(np.float64))
    covariance = products / n
    values, vectors = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    # What rounding leaves of a direction without any variance counts as none.
    values = np.where(values > trace * length * np.finfo(np.float64).eps, values, 0.0)[:components]
    shares = values / trace if trace > 0 else np.zeros(len(values))
    return Whitening(n, sums, np.ascontiguousarray(vectors[:, :components].T), values, shares)


def identity_error(fit: DataFrame, length: int, whitening: Whitening) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, over components with variance."""
    k = int((whitening.values > 0).sum())
    if not k:
        return 0.0
    products = _products(fit, length, k, lambda v: whitening.whiten(whitening.centred(v))[:, :k])
    return float(np.abs(products / whitening.n - np.eye(k)).max())


def whiten_embeddings(
    rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS
) -> DataFrame:
    """Rows of finite vectors with `whitened` (array), `explained` (array), `deviation`, `n`, `identity_error`.

    * Rows whose vector is null or holds null or non-finite components are dropped; all
      others stay, repeated ones too, which count once in the fit.
    * Vectors of another length than the commonest (ties: the longer), empty ones, and those
      with a component beyond 2^40 after scaling take no part in the fit: their `deviation`
      and the entries of `whitened` are null.  So is a deviation that does not fit 64 bits.
    * Vectors shorter than `components` have as many entries as components.  A component
      without variance has null entries, explains 0, and is left out of `identity_error`.
    * An empty table gives an empty result.  Input columns with the new names are replaced.

    Equal vectors are combined in the tasks before they are shuffled.  Three scans of the
    distinct vectors follow (sums, covariance, identity error), each sending bounded rows.
    """
    whole, length = of_one_length(written(with_integers(rows, vector_col, scale), "integers"))
    fit = written(whole.filter(F.col(INTEGERS).isNotNull()).select(INTEGERS).distinct(), "fit")
    whitening = fit_whitening(fit, length, components)
    error = identity_error(fit, length, whitening)
    k = len(whitening.values)
    shared = rows.sparkSession.sparkContext.broadcast(whitening)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        arrays = batch.column(batch.schema.get_field_index(INTEGERS))
        there, vectors = matrix(arrays, length)
        deviation: list[int | None] = [None] * len(arrays)
        whitened = np.full((len(arrays), k), np.nan)
        for start in range(0, len(there), _SLICE):
            centred = shared.value.centred(vectors[start : start + _SLICE])
            at = there[start : start + _SLICE]
            whitened[at] = shared.value.whiten(centred)
            for row, value in zip(at, deviations(centred)):
                deviation[row] = value
        flat = pa.array(whitened.ravel(), from_pandas=True)
        offsets = pa.array(np.arange(len(arrays) + 1, dtype=np.int32) * k)
        return {
            "deviation": pa.array(deviation, pa.int64()),
            "whitened": pa.ListArray.from_arrays(offsets, flat),
        }

    result = with_results(whole, "deviation bigint, whitened array<double>", make, drop=(INTEGERS,))
    return result.withColumns(
        {
            "explained": F.array(*(F.lit(float(s)) for s in whitening.explained)).cast("array<double>"),
            "n": F.lit(whitening.n).cast("bigint"),
            "identity_error": F.lit(error),
        }
    )
