"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a short vector of transformed statistics of its whole text.  Per
class, Spark sums these vectors and their products over all labelled rows; the driver
turns the sums into a mean and a covariance, shrunk toward the pooled covariance and
toward a multiple of the identity, and keeps the Cholesky factor.  The score is the
difference of the two Gaussian log densities (Mahalanobis distances and determinants),
mapped to a probability by a logistic curve fitted to a histogram of the training rows.

What the driver holds does not grow with the data: sums of a fixed number of statistics
and a histogram with a fixed number of bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.frames import column, text_of, with_results
from scanmill.llm.textscan import BLOCK_BYTES, NOT_SPACE, Block, blocks, mixed, words_of
from scanmill.runtime import written

STATISTICS = (
    "word bytes",
    "words a line",
    "upper share",
    "digit share",
    "stop share",
    "comma share",
    "quote share",
    "symbol share",
    "symbol-ended words",
    "capital words",
    "symbol words",
    "distinct words",
    "repeated words",
)
# A few words say little about a text: shares are blended with so many usual ones.
_BLEND_WORDS, _BLEND_CHARS = 12, 60
_HISTOGRAM_BINS = 400
_LIMIT = 40.0

_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _QUOTE, _SYMBOL, _BEYOND = range(11)
_KIND = np.full(256, _OTHER, np.uint8)
for _chars, _kind in (
    ("abcdefghijklmnopqrstuvwxyz", _LOWER),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
    ("0123456789", _DIGIT),
    (" \t\r\v\f", _SPACE),
    ("\n", _LINE),
    (".!?", _STOP),
    (",;:", _COMMA),
    ("'\"()-", _QUOTE),
    ("#$%&*+/<=>@[\\]^_`{|}~", _SYMBOL),
):
    _KIND[[ord(c) for c in _chars]] = _kind
_KIND[128:] = _BEYOND
_KINDS = 11


@dataclass
class _Counts:
    """What the statistics are made of, one entry per text: all but `distinct` add up over pieces."""

    kinds: np.ndarray  # (texts, _KINDS) characters
    words: np.ndarray
    symbol_ended: np.ndarray
    capital: np.ndarray
    symbol: np.ndarray
    distinct: np.ndarray
    again: np.ndarray


def _counts(block: Block) -> tuple[_Counts, np.ndarray]:
    """Counts of a block, and the hashes of its words."""
    rows, data = block.rows, block.data
    row_of = np.repeat(np.arange(rows), np.diff(block.offsets))
    kinds = _KIND[data]
    table = np.bincount(row_of * _KINDS + kinds, minlength=rows * _KINDS).reshape(rows, _KINDS)
    del row_of
    words = words_of(block, NOT_SPACE)
    last = kinds[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    head = kinds[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    single = (words.ends - words.starts) == 1
    # Sorting hashes that also depend on the row counts the distinct words of all rows at once.
    own = mixed(words.hashes + words.rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    distinct = np.ones(len(own), bool)
    distinct[order[1:]] = own[order[1:]] != own[order[:-1]]
    again = np.zeros(len(own), bool)
    again[1:] = own[1:] == own[:-1]

    def found(mask: np.ndarray) -> np.ndarray:
        return np.bincount(words.rows[mask], minlength=rows)

    counts = _Counts(
        table, words.counts(), found(last == _SYMBOL), found(head == _UPPER),
        found(single & (head == _SYMBOL)), found(distinct), found(again),
    )
    return counts, words.hashes


def _long_counts(block: Block) -> _Counts:
    """Counts of a block of one long text, added up over pieces that no word crosses."""
    total: _Counts | None = None
    hashes: list[np.ndarray] = []
    start = 0
    while start < len(block.data):
        end = min(start + BLOCK_BYTES, len(block.data))
        while end < len(block.data) and NOT_SPACE[block.data[end]]:
            gap = NOT_SPACE[block.data[end : end + BLOCK_BYTES]]
            at = int(np.argmin(gap))
            end += at if not gap[at] else len(gap)
        piece = block.data[start:end]
        counts, own = _counts(Block(0, piece, np.array([0, len(piece)])))
        if total is None:
            total = counts
        else:
            for name in ("kinds", "words", "symbol_ended", "capital", "symbol", "again"):
                setattr(total, name, getattr(total, name) + getattr(counts, name))
            if len(own) and hashes:
                total.again += int(own[0] == hashes[-1][-1])
        if len(own):
            hashes.append(own)
        start = end
    total.distinct = np.array([len(np.unique(np.concatenate(hashes))) if hashes else 0])
    return total


def _statistics(block: Block) -> np.ndarray:
    """One row of transformed statistics per text; all of an empty text are those of no words."""
    long = block.rows == 1 and len(block.data) > BLOCK_BYTES
    c = _long_counts(block) if long else _counts(block)[0]
    n = c.words.astype(np.float64)
    ink = c.kinds.sum(axis=1) - c.kinds[:, _SPACE] - c.kinds[:, _LINE]

    def share(usual: float, *found: int) -> np.ndarray:
        """Square root of the share of some kinds of characters, blended with a usual share."""
        return np.sqrt((c.kinds[:, list(found)].sum(axis=1) + usual * _BLEND_CHARS) / (ink + _BLEND_CHARS))

    def word_share(usual: float, found: np.ndarray) -> np.ndarray:
        return np.sqrt((found + usual * _BLEND_WORDS) / (n + _BLEND_WORDS))

    return np.column_stack(
        [
            np.log((ink + 5 * _BLEND_WORDS) / (n + _BLEND_WORDS)),
            np.log((n + _BLEND_WORDS) / (c.kinds[:, _LINE] + 1 + _BLEND_WORDS / 25)),
            share(0.03, _UPPER),
            share(0, _DIGIT),
            share(0.03, _STOP),
            share(0.01, _COMMA),
            share(0, _QUOTE),
            share(0, _SYMBOL, _OTHER),
            word_share(0, c.symbol_ended),
            word_share(0.1, c.capital),
            word_share(0, c.symbol),
            word_share(0.8, c.distinct),
            word_share(0, c.again),
        ]
    )


def text_statistics(docs: DataFrame, text_col: str = "text", out: str = "statistics") -> DataFrame:
    """Documents with an array of the `STATISTICS` of their text; a null text counts as empty."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        parts = [_statistics(b) for b in blocks(text_of(batch, text_col))]
        values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        offsets = np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS)
        return {out: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))}

    return with_results(docs, f"`{out}` array<double>", make)


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    inverse: np.ndarray  # of the Cholesky factor of the covariance
    half_log_det: float

    @staticmethod
    def of(mean: np.ndarray, covariance: np.ndarray) -> Gaussian:
        factor = np.linalg.cholesky(covariance)
        return Gaussian(mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return -0.5 * (z * z).sum(axis=1) - self.half_log_det


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians and the logistic curve over their log-density difference.

    Without rows of both classes, every score is `prior`.
    """

    good: Gaussian | None
    bad: Gaussian | None
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.good.log_density(x) - self.bad.log_density(x), -_LIMIT, _LIMIT)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.good is None or self.bad is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.offset)))


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return text_of(batch, name).flatten().to_numpy().reshape(-1, len(STATISTICS))


def train_discriminant(
    labelled: DataFrame,
    label_col: str,
    statistics_col: str = "statistics",
    shrink_pooled: float = 0.1,
    shrink_identity: float = 0.02,
) -> Discriminant:
    """Fit to all rows whose label is 0 or 1; rows with another or no label are left out."""
    size = len(STATISTICS)
    rows = labelled.select(
        column(label_col).cast("int").alias("label"), column(statistics_col).alias("x")
    ).filter("label in (0, 1)")
    # Sums are taken around a common point, so that no digits are lost in the products.
    x = [F.col("x")[i] for i in range(size)]
    center = rows.agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(x))).first()
    center = np.array([center[f"m{i}"] or 0.0 for i in range(size)])
    d = [v - F.lit(float(c)) for v, c in zip(x, center)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(v) for v in d)).alias("s"),
        F.array(*(F.sum(d[i] * d[j]) for i, j in pairs)).alias("p"),
    )
    by_label = {r["label"]: r for r in sums.collect()}
    counts = {k: by_label[k]["n"] if k in by_label else 0 for k in (0, 1)}
    total = counts[0] + counts[1]
    prior = counts[1] / total if total else 0.5
    if not (counts[0] and counts[1]):
        return Discriminant(None, None, prior)
    means, scatters = {}, {}
    for label, row in by_label.items():
        mean = np.array(row["s"]) / row["n"]
        product = np.zeros((size, size))
        for (i, j), value in zip(pairs, row["p"]):
            product[i, j] = product[j, i] = value
        means[label] = mean
        scatters[label] = product - row["n"] * np.outer(mean, mean)
    pooled = (scatters[0] + scatters[1]) / total
    gaussians = {}
    for label in (0, 1):
        own = scatters[label] / counts[label]
        mixed_ = (1 - shrink_pooled) * own + shrink_pooled * pooled
        level = max(np.trace(mixed_) / size, 1e-9)
        covariance = (1 - shrink_identity) * mixed_ + shrink_identity * level * np.eye(size)
        gaussians[label] = Gaussian.of(means[label] + center, covariance)
    raw = Discriminant(gaussians[1], gaussians[0], prior)
    slope, offset = _calibrated(rows, raw)
    return Discriminant(raw.good, raw.bad, prior, slope, offset)


def _calibrated(rows: DataFrame, model: Discriminant) -> tuple[float, float]:
    """Logistic curve over the difference, by Newton steps on a histogram of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = shared.value.difference(_vectors(batch, "x"))
        return {"bin": pa.array(np.rint(found * (_HISTOGRAM_BINS / _LIMIT)).astype(np.int64))}

    counted = with_results(rows, "bin bigint", make, drop=("x",)).groupBy("label", "bin").count().collect()
    # One pseudo-row of each class at either end keeps the curve finite.
    x = np.array([r["bin"] * _LIMIT / _HISTOGRAM_BINS for r in counted] + [-_LIMIT, _LIMIT] * 2)
    y = np.array([r["label"] for r in counted] + [0, 0, 1, 1], float)
    n = np.array([r["count"] for r in counted] + [1, 1, 1, 1], float)
    design = np.column_stack([x, np.ones_like(x)])
    ridge = np.array([1e-3, 1e-9])

    def likelihood(beta: np.ndarray) -> float:
        z = design @ beta
        return float((n * (y * z - np.logaddexp(0, z))).sum() - (ridge * beta * beta).sum() / 2)

    beta = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (n * (y - p)) - ridge * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        # A whole step may overshoot: it is halved until the likelihood does not fall.
        while likelihood(beta + step) < likelihood(beta) and np.abs(step).max() > 1e-12:
            step /= 2
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def score_quality(
    described: DataFrame, model: Discriminant, threshold: float = 0.3, statistics_col: str = "statistics"
) -> DataFrame:
    """Rows with `score` (0 to 1) and `predicted` (1 if the score is at least the threshold).

    Input columns of these names are replaced; the statistics are left out.
    """
    shared = described.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        scores = shared.value.score(_vectors(batch, statistics_col))
        return {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    return with_results(described, "score double, predicted int", make, drop=(statistics_col,))


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    train_on,
    label_col: str = "quality",
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, score, predicted) of every row of `docs`.

    Labels are joined by id; only rows where the condition `train_on` holds train the
    model.  The label, and any column but the text, is never an input of a score.  A null
    or empty text has the statistics of a text without words.  A null id finds no label.
    Rows that share an id each train with its labels.
    """
    described = written(
        text_statistics(docs.select(column(id_col), column(text_col)), text_col)
        .drop(text_col),
        "statistics",
    )
    marks = labels.select(column(id_col).alias("__id"), column(label_col).alias("__label"))
    labelled = described.filter(train_on).join(marks, column(id_col) == F.col("__id"))
    model = train_discriminant(labelled, "__label")
    return score_quality(described, model, threshold)
