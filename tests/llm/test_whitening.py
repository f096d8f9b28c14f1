"""Whitening against an eigenvalue routine, and its exact columns against Python integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from scanmill.llm.spectral import eigenvectors, polar_factor
from scanmill.llm.whitening import whiten_embeddings


def test_polar_factor_is_the_sign_of_a_symmetric_matrix():
    rng = np.random.Generator(np.random.PCG64(1))
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    for values in (np.linspace(-3, 4, 12), np.r_[-1e-9, np.linspace(1, 1e6, 11)]):
        factor = polar_factor((q * values) @ q.T)
        assert np.abs(factor - (q * np.sign(values)) @ q.T).max() < 1e-6
        assert np.abs(factor @ factor.T - np.eye(12)).max() < 1e-13


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 2, 40),
        np.r_[5.0, 5.0, 5.0, 1.0, 1.0, 0.0],
        np.full(7, 2.5),
        np.r_[1e8, 1.0, 1e-8, 0.0, 0.0],
        np.zeros(4),
        np.r_[3.0],
        np.geomspace(1, 1e-12, 30),
        np.r_[1.0, 1.0 + 1e-12, 0.5, 0.5 + 1e-9],
    ],
)
def test_eigenvectors_of_given_spectra(values):
    rng = np.random.Generator(np.random.PCG64(len(values)))
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    matrix = (q * values) @ q.T
    found, vectors = eigenvectors(matrix)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * scale * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-12 * scale


def plain(rows, scale=256):
    """deviations and whitened rows of vectors of one length, by numpy's own routine."""
    x = [tuple(math.floor(scale * c) for c in v) for v in rows]
    fit = np.array(sorted(set(x)), dtype=np.int64)
    n, s = len(fit), [sum(c) for c in zip(*fit.tolist())]
    mean = np.array(s) / n
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    return n, deviation, (np.array(x) - mean) @ vectors / np.sqrt(values), values / values.sum()


def test_operator_equals_plain_version(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.5, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [v.tolist() for v in base.astype(np.float32)] + [base[0].astype(np.float32).tolist()] * 50
    data = spark.createDataFrame([(i, v, "kept") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, n string")
    got = sorted(whiten_embeddings(data.repartition(5)).collect(), key=lambda r: r.vec_id)
    n, deviation, whitened, explained = plain(rows)
    assert {r.n for r in got} == {n} and [r.deviation for r in got] == deviation
    ours = np.array([r.whitened for r in got])
    signs = np.sign((ours * whitened[:, :4]).sum(axis=0))
    assert np.abs(ours - whitened[:, :4] * signs).max() < 1e-10
    assert np.allclose(got[0].explained, explained[:4], rtol=1e-10)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12
    # Every component, not only the first four.
    every = np.array([r.whitened for r in sorted(whiten_embeddings(data, components=12).collect(), key=lambda r: r.vec_id)])
    first = np.unique(np.array([list(r) for r in every]).round(9), axis=0)
    assert len(first) == n and np.abs(np.cov(first.T, bias=True) - np.eye(12)).max() < 1e-6


def test_odd_rows(spark):
    nan = float("nan")
    rows = [
        (1, [0.5, 0.25]), (2, [1.0, 0.25]), (2, [1.0, 0.25]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]),
        (6, []), (7, [1.0]), (8, [1e300, 1.0]), (None, [0.75, 0.25]),
    ]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whiten_embeddings(data).collect()}
    assert set(got) == {1, 2, 6, 7, 8, None}
    # The second direction has no variance.
    assert got[1].n == 3 and got[1].whitened[1] is None and abs(abs(got[1].whitened[0]) - math.sqrt(1.5)) < 1e-12
    assert list(got[1].explained) == [1.0, 0.0] and got[1].identity_error < 1e-12
    for odd in (6, 7, 8):
        assert got[odd].deviation is None and got[odd].whitened == [None, None]
    # Sums of squares beyond 64 bits are null, large ones are exact.
    large = spark.createDataFrame([(i, [float(1 << 29) * i, 0.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whiten_embeddings(large).collect()} == {i: None for i in range(4)}
    large = spark.createDataFrame([(i, [float(1 << 20) * i, 0.1]) for i in range(4)], "vec_id long, embedding array<double>")
    expected = {i: (4 * (i << 28) - (6 << 28)) ** 2 for i in range(4)}
    assert {r.vec_id: r.deviation for r in whiten_embeddings(large).collect()} == expected
    assert whiten_embeddings(data.limit(0)).collect() == []
    assert whiten_embeddings(data.filter("vec_id in (3, 6)")).first().whitened == []
    one = whiten_embeddings(data.filter("vec_id = 2")).first()
    assert (one.n, one.deviation, one.whitened, one.identity_error) == (1, 0, [None, None], 0.0)
