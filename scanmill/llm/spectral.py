"""Eigenvectors of a symmetric matrix by divide and conquer with polar decompositions.

The orthogonal polar factor of A - s*I is the matrix sign of A - s*I, so half of it plus the
identity projects on the eigenvectors with eigenvalues over s.  Bases of that subspace and of
its complement split the matrix into two smaller ones, and so on.  Polar factors come from
the QR form of the dynamically weighted Halley iteration, which takes about six steps
whatever the conditioning and inverts nothing.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
_STEPS = 60


def polar_factor(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix that is not singular."""
    n = len(matrix)
    x = matrix / np.linalg.norm(matrix, 2)
    # A lower bound of the smallest singular value: only the number of steps depends on it.
    low = max(float(np.linalg.norm(x, -2)) * 0.9, _EPS)
    for _ in range(_STEPS):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        a = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        following = (b / c) * x + ((a - b / c) / np.sqrt(c)) * (q[:n] @ q[n:].T)
        low = min(1.0, low * (a + b * square) / (1 + c * square))
        change = np.linalg.norm(following - x)
        x = following
        if change <= np.cbrt(_EPS) and 1 - low <= 10 * _EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix whose first `rank` columns span the range of a projector."""
    n = len(projector)
    q, _ = np.linalg.qr(projector @ rng.standard_normal((n, rank)))
    q, _ = np.linalg.qr(projector @ q)
    q, _ = np.linalg.qr(projector @ q, mode="complete")
    return q


def _shifts(matrix: np.ndarray) -> list[float]:
    """Where to split: amid the diagonal, then at other places between its ends.

    The diagonal lies between the smallest and the largest eigenvalue, and its mean strictly
    so unless all are equal.
    """
    diagonal = np.sort(np.diagonal(matrix))
    middle = len(diagonal) // 2
    places = [float(diagonal[middle - 1] + diagonal[middle]) / 2, float(diagonal.mean())]
    low, high = float(diagonal[0]), float(diagonal[-1])
    return places + [low + (high - low) * share for share in (0.31, 0.69, 0.11, 0.89)]


def _split(matrix: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    n = len(matrix)
    off = matrix - np.diag(np.diagonal(matrix))
    if n == 1 or np.linalg.norm(off) <= _EPS * scale:
        return np.eye(n)
    best = None
    for shift in _shifts(matrix):
        moved = matrix - shift * np.eye(n)
        if np.linalg.norm(moved, -2) <= 4 * n * _EPS * scale:
            continue  # an eigenvalue on the shift belongs to neither side
        factor = polar_factor(moved)
        projector = (factor + factor.T) / 4 + np.eye(n) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        q = _basis(projector, rank, rng)
        turned = q.T @ matrix @ q
        left = float(np.linalg.norm(turned[rank:, :rank]))
        if best is None or left < best[0]:
            best = (left, rank, q, turned)
        if left <= 8 * n * _EPS * scale:
            break
    if best is None:
        # No place parts the eigenvalues: they are equal, to rounding.
        return np.eye(n)
    _, rank, q, turned = best
    turned = (turned + turned.T) / 2
    vectors = np.zeros((n, n))
    vectors[:rank, :rank] = _split(turned[:rank, :rank], scale, rng)
    vectors[rank:, rank:] = _split(turned[rank:, rank:], scale, rng)
    return q @ vectors


def eigenvectors(matrix: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    matrix = (matrix + matrix.T) / 2
    scale = float(np.linalg.norm(matrix))
    vectors = np.eye(len(matrix))
    if scale > 0:
        vectors = _split(matrix, scale, np.random.Generator(np.random.PCG64(seed)))
        vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ik,kj->j", vectors, matrix, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]
