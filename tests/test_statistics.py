import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haplospark.functions import random_bits as rb
from haplospark.functions.statistics import chi2_sf, chi2_tail, g6, heritability, log_delta, p_text, p_value_text, register, six_digits
from haplospark.operators import mixed_model, qc, solvers
from haplospark.schema import Direction, InitMode


def test_normal_sequence():
    """The first five numbers that the generator draws for seed 12346."""
    bits = rb.Twister(12346)
    assert [rb.normal(bits) for _ in range(5)] == pytest.approx([1.3215278348242439, -0.05406356468865104, 0.25961218757166832, -1.8261137440309931, -0.11777653168380715], rel=0, abs=1e-15)


def test_twister_and_distributions():
    assert rb.Twister(5489).word() == 3499211612
    bits = rb.Twister(1)
    x = np.array([rb.normal(bits) for _ in range(20_000)])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs(np.mean(x**4) - 3) < 0.2
    e = np.array([rb.exponential(bits, 2.0) for _ in range(20_000)])
    assert abs(e.mean() - 0.5) < 0.02
    assert 0 <= bits.below_2_30() <= 1 << 30 and 0 <= bits.unit() < 1
    labels = rb.balanced_labels(7, 3)
    assert sorted(labels.tolist()) == [1, 1, 1, 1, 2, 2, 2] and (labels == rb.balanced_labels(7, 3)).all()


def test_texts(spark):
    assert six_digits(-1e9) == "-1e+09" and six_digits(0.1234567) == "0.123457" and six_digits(0) == "0"
    assert p_text(1.0, -1e9) == "1.0E+00" and p_text(0.000123, 1) == "1.2E-04"
    x = 2000.0
    log10p = math.log10(2) - 0.5 * math.log10(2 * math.pi * x) - x / 2 * math.log10(math.e)
    digits, power = p_text(0.0, x).split("E")
    assert int(power) == math.floor(log10p) and abs(float(digits) - 10 ** (log10p - math.floor(log10p))) <= 0.05
    assert chi2_tail(3.841458820694124) == pytest.approx(0.05) and chi2_tail(0.0) == 1 and chi2_tail(None) is None
    df = spark.createDataFrame([(3.841458820694124, 0.05), (0.0, 1.0)], "x double, p double")
    rows = df.select(chi2_sf(df.x).alias("s"), g6(df.x).alias("g"), p_value_text(df.p, df.x).alias("t")).collect()
    assert rows[0]["s"] == pytest.approx(0.05) and rows[0]["g"] == "3.84146" and rows[1]["t"] == "1.0E+00"
    register(spark)
    assert spark.sql("SELECT g6(chi2_sf(CAST(3.841458820694124 AS DOUBLE))) AS x").first()["x"] == "0.05"
    assert heritability(log_delta(0.3, 500.0, 20, 40), 500.0, 20, 40) == pytest.approx(0.3)


def test_enumerations():
    assert Direction.parse(" Up ") is Direction.UP and InitMode.parse(None) is InitMode.NONE and InitMode.parse("XTX") is InitMode.XTX
    for bad, kind in (("x", ValueError), (3, TypeError)):
        with pytest.raises(kind):
            Direction.parse(bad)
        with pytest.raises(kind):
            InitMode.parse(bad)


def spectrum(n, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = 100 * 0.7 ** np.arange(n)
    return (q * values) @ q.T, values, q


@pytest.mark.parametrize("solve", [solvers.randomized, solvers.lanczos, solvers.lobpcg])
def test_eigensolvers(solve):
    a, values, q = spectrum(60)
    got, vectors = solve(lambda v: a @ v, 60, 4)
    np.testing.assert_allclose(got, values[:4], rtol=1e-8)
    assert solvers.largest_angle_sine(q[:, :4], vectors) < 1e-2
    assert solvers.passes(solvers.relative_residuals(lambda v: a @ v, got, vectors), 0.0, 1e-6)
    if solve is solvers.lobpcg:
        with pytest.raises(ValueError):
            solve(lambda v: a @ v, 60, 20)


def test_conjugate_gradients():
    a, _, _ = spectrum(30)
    a += np.eye(30)
    b = np.random.default_rng(1).standard_normal((30, 3))
    report = solvers.CgReport()
    np.testing.assert_allclose(solvers.conjugate_gradients(lambda v: a @ v, b, rel_tol=1e-10, report=report), np.linalg.solve(a, b), atol=1e-7)
    assert len(report.iterations) == 3 and max(report.residuals) <= 1e-10
    solvers.conjugate_gradients(lambda v: a @ v, b, rel_tol=0.0, max_iter=2)  # the last iterate, no error


def test_components_are_standardised():
    x = solvers.standardised_components(np.random.default_rng(2).standard_normal((50, 3)))
    np.testing.assert_allclose(x.mean(0), 0, atol=1e-12)
    np.testing.assert_allclose(x.std(0, ddof=1), 1)
    assert (x[np.abs(x).argmax(0), range(3)] > 0).all()


@settings(deadline=None, max_examples=30)
@given(st.lists(st.floats(0.5, 2), min_size=3, max_size=12), st.integers(0, 100))
def test_calibration_factor(retro, seed):
    retro = np.array(retro)
    pro = retro * np.random.default_rng(seed).uniform(0.5, 2, len(retro))
    factor, std, of_medians, of_ratios = mixed_model.calibration_factor(pro, retro)
    jacks = [(pro.sum() - p) / (retro.sum() - r) for p, r in zip(pro, retro, strict=True)]
    n = len(jacks)
    assert std == pytest.approx(math.sqrt(max(0, (sum(j * j for j in jacks) - sum(jacks) ** 2 / n) * (n - 1) / n)), abs=1e-6)
    assert factor == pytest.approx(of_medians if std > 0.01 else pro.sum() / retro.sum())
    assert of_ratios == pytest.approx(np.median(pro / retro))


def test_basis():
    m = np.column_stack([np.ones(10), np.arange(10.0), 2 * np.arange(10.0)])
    q = qc.orthonormal_basis(m)
    assert q.shape == (10, 2)
    np.testing.assert_allclose(q.T @ q, np.eye(2), atol=1e-12)
    np.testing.assert_allclose(qc.project(q, np.arange(10.0)), 0, atol=1e-10)
