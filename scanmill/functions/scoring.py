"""Ranking formulas.

Those without a logarithm are plain arithmetic, for Columns and for numpy arrays alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.0
B = 0.5
AVERAGE_LENGTH = 450.0
SMOOTHING = 1000.0


def idf(df: Column, n_docs: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)); negative for terms in over half the documents.

    A dictionary built from a larger corpus can have df > N; such a term counts as
    one that is in every document.
    """
    n = F.greatest(n_docs.cast("double"), df.cast("double"))
    return F.log((n - df + 0.5) / (df + 0.5))


def bm25_term(tf, doc_len, average_length, k1: float = K1, b: float = B):
    """Saturated, length-normalised term frequency."""
    norm = k1 * ((1.0 - b) + b * doc_len / average_length)
    return (k1 + 1.0) * tf / (norm + tf)


def is_jelinek_mercer(smoothing: float) -> bool:
    """Up to 1 the parameter is an interpolation weight, above it a Dirichlet prior."""
    return smoothing <= 1.0


def likelihood(tf, doc_len, background, smoothing: float):
    """Smoothed probability of a term in a document (doc_len > 0)."""
    if is_jelinek_mercer(smoothing):
        return smoothing * tf / doc_len + (1.0 - smoothing) * background
    return (tf + smoothing * background) / (doc_len + smoothing)
