"""Vector codes: every part of a vector becomes the number of its nearest codebook entry.

Components become integers, so that codes, errors and codebooks are exact and do not depend
on the order of work.  The nearest entry is found by equal-average search: with d components,

    squared distance >= (sum of the part - sum of the entry)^2 / d

so a part is compared with entries outward from its own sum, and a side is given up as soon
as that bound strictly exceeds the best distance; at equality an entry of a lower number could
still tie, so the search goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.frames import column, with_group_values, with_results
from scanmill.llm.numeric import INTEGERS, SUMS, added, exact_sums, matrix, of_one_length, with_integers
from scanmill.runtime import written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6

# Rows of a batch that are worked on at once: bounds what a task holds beside the batch.
_SLICE = 4096


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and squared distance to, the nearest of `book` (k, d) for each of `parts` (n, d).

    Ties go to the lower number.  Integers of any size: those whose squares might not fit
    64 bits are computed as Python integers.
    """
    d = parts.shape[1]
    most = max((int(np.abs(a).max()) for a in (parts, book) if a.size), default=0)
    kind = np.int64 if 2 * d * most < 1 << 31 else object
    parts, book = parts.astype(kind), book.astype(kind)
    order = np.argsort(book.sum(axis=1), kind="stable")
    sums = book.sum(axis=1)[order]
    own = parts.sum(axis=1)
    last = len(book) - 1

    above = np.searchsorted(sums, own)  # the next entries to look at, on either side
    below = above - 1
    best = np.zeros(len(parts), kind)
    number = np.full(len(parts), -1)
    rows = np.arange(len(parts))
    while len(rows):
        low, high = below[rows], above[rows]
        gap_low = own[rows] - sums[np.maximum(low, 0)]
        gap_high = sums[np.minimum(high, last)] - own[rows]
        down = (low >= 0) & ((high > last) | (gap_low <= gap_high))
        gap = np.where(down, gap_low, gap_high)
        # The nearer side decides: if it is too far, so is the other.
        within = (number[rows] < 0) | (gap * gap <= best[rows] * d).astype(bool)
        going = within & ((low >= 0) | (high <= last))
        rows, down, low, high = rows[going], down[going], low[going], high[going]
        entry = order[np.where(down, low, high)]
        away = parts[rows] - book[entry]
        distance = (away * away).sum(axis=1)
        better = (number[rows] < 0) | (distance < best[rows]).astype(bool)
        better |= (distance == best[rows]).astype(bool) & (entry < number[rows])
        best[rows[better]], number[rows[better]] = distance[better], entry[better]
        below[rows] = np.where(down, low - 1, low)
        above[rows] = np.where(down, high, high + 1)
    return number, best


@dataclass(frozen=True)
class Codebooks:
    """Entries of every part: `entries[p]` is (k, d), all integers."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        values = [str(int(c)) for book in self.entries for c in book.ravel()]
        return hashlib.sha256(",".join(values).encode()).hexdigest()

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers (n, parts) and summed squared distances of vectors."""
        found = [nearest_entries(part, book) for part, book in zip(self.split(vectors), self.entries)]
        numbers = np.stack([number for number, _ in found], axis=1)
        return numbers, np.sum([best.astype(object) for _, best in found], axis=0)

    def split(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Equal consecutive parts; a length that they do not divide is filled with zeros at the end."""
        width = -(-vectors.shape[1] // len(self.entries))
        filled = np.zeros((len(vectors), width * len(self.entries)), vectors.dtype)
        filled[:, : vectors.shape[1]] = vectors
        return np.split(filled, len(self.entries), axis=1)


def _first_books(rows: DataFrame, id_col: str, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors of the smallest ids; equal ids are told apart by their vectors."""
    least = rows.filter(F.col(INTEGERS).isNotNull()).orderBy(column(id_col).asc_nulls_last(), INTEGERS)
    vectors = np.array([r[0] for r in least.select(INTEGERS).limit(entries).collect()], np.int64)
    return Codebooks(Codebooks([vectors[:0]] * parts).split(vectors))


def _refined(rows: DataFrame, books: Codebooks, length: int) -> Codebooks:
    """Every entry becomes the mean, rounded down, of the parts nearest to it; unused ones stay."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            _, vectors = matrix(batch.column(0), length)
            for start in range(0, len(vectors), _SLICE):
                some = vectors[start : start + _SLICE]
                numbers, _ = books.encode(some)
                for p, part in enumerate(books.split(some)):
                    used, counts = np.unique(numbers[:, p], return_counts=True)
                    sums = np.stack([part[numbers[:, p] == e].sum(axis=0) for e in used])
                    yield p * len(books.entries[p]) + used, sums, counts

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield exact_sums(pieces(batches))

    there = rows.filter(F.col(INTEGERS).isNotNull()).select(INTEGERS)
    refined = [book.copy() for book in books.entries]
    for slot, (totals, n) in added(there.mapInArrow(partial, SUMS)).items():
        p, e = divmod(slot, len(books.entries[0]))
        refined[p][e] = [t // n for t in totals]
    return Codebooks(refined)


def encode_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Rows of finite vectors with `code`, `error`, `label_error` and `codebooks_sha256`.

    * Rows whose vector is null or holds null or non-finite components are dropped; all
      others stay, repeated rows and repeated or null ids too (null ids count as largest).
    * `code` has two hex digits a part.  Vectors of another length than the commonest (ties:
      the longer), empty ones, and those with a component beyond 2^40 after scaling have no
      code and no error, and train nothing.
    * `error` is null if it does not fit 64 bits.  `label_error` sums the errors of equal
      labels, nulls being equal to each other; null if the sum does not fit or has no terms.
    * With fewer usable vectors than `entries`, there are that many entries.  An empty table
      gives an empty result.
    * Columns of the input that have the name of a new one are replaced.

    The vectors are written once; each round is one scan whose tasks send a row per entry and
    component, so what the driver sees does not grow with the table.
    """
    whole = with_integers(rows, vector_col, scale)
    kept, length = of_one_length(written(whole, "integers"))
    books = Codebooks([np.zeros((0, 1), np.int64)] * parts)
    if length:
        books = _first_books(kept, id_col, parts, entries)
        for _ in range(rounds):
            books = _refined(kept, books, length)
    final = books

    def coded(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        arrays = batch.column(batch.schema.get_field_index(INTEGERS))
        codes: list[str | None] = [None] * len(arrays)
        errors: list[int | None] = [None] * len(arrays)
        there, vectors = matrix(arrays, length)
        for start in range(0, len(there), _SLICE):
            numbers, totals = final.encode(vectors[start : start + _SLICE])
            for at, row, total in zip(there[start:], numbers.astype(np.uint8), totals):
                codes[at] = row.tobytes().hex()
                errors[at] = int(total) if total < 1 << 63 else None
        return {"code": pa.array(codes, pa.string()), "error": pa.array(errors, pa.int64())}

    result = written(with_results(kept, "code string, error bigint", coded, drop=(INTEGERS,)), "codes")
    by_label = result.groupBy(column(label_col)).agg(
        F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"),
        F.count(F.lit(1)).alias("__rows"),
    )
    joined = with_group_values(result, label_col, by_label, "__rows")
    return joined.withColumn("codebooks_sha256", F.lit(final.digest()))
