"""Blocks of vectors in pieces, against the same on arrays."""

import numpy as np

from haplospark.operators import panels, solvers


def test_randomized_in_pieces(spark, monkeypatch):
    """Many parts, the last of fewer individuals than columns; the driver sees no block of all individuals but the results."""
    monkeypatch.setattr(panels, "PEOPLE", 17)
    n, k = 3 * 17 + 2, 3
    r = np.random.default_rng(4)
    basis = np.linalg.qr(r.standard_normal((n, n)))[0]
    matrix = (basis * 2.0 ** -np.arange(n)) @ basis.T
    values, vectors, residuals = panels.randomized(spark, lambda x: x @ matrix, n, k, oversample=5, power=6)
    np.testing.assert_allclose(values, [1, 0.5, 0.25], rtol=1e-9)
    assert (residuals < 1e-6).all()
    found = vectors.array()
    assert found.shape == (n, k) and solvers.largest_angle_sine(found, basis[:, :k]) < 1e-6
    long = vectors.vectors().toPandas()
    again = np.zeros((n, k))
    again[long["id"], long["row"]] = long["value"]
    np.testing.assert_array_equal(again, found)


def test_an_orthonormal_basis_of_dependent_columns(spark, monkeypatch):
    monkeypatch.setattr(panels, "PEOPLE", 10)
    start = panels.Panel.random(spark, 35, 2, 1)
    x = start.array()
    q = start.times(np.array([[1.0, 1.0, 0.0], [0.0, 1e-13, 1.0]])).orthonormal().array()
    np.testing.assert_allclose(q.T @ q, np.eye(3), atol=1e-12)
    np.testing.assert_allclose(q @ (q.T @ x), x, atol=1e-9)
