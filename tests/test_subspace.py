"""Axes by subspace iteration against those of the whole covariance."""

import numpy as np
import pytest

from stateloom.operators import preprocess, subspace


def table(spark, x, parts=6):
    rows = [(0, i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "session_id int, t int, y array<double>").repartition(parts)


def test_axes_equal_those_of_the_covariance(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.standard_normal((150, 60)) @ (r.standard_normal((60, 60)) * 0.9 ** np.arange(60)[:, None]) + 5
    val, vec = np.linalg.eigh(np.cov(x.T, bias=True))
    monkeypatch.setattr(subspace, "FAN", 2)
    axes, var, mean = subspace.leading_axes(table(spark, x), 3, tasks=5)
    assert axes.shape == (60, 3) and np.allclose(mean, x.mean(0)) and np.allclose(var, val[::-1][:3], rtol=1e-9)
    assert np.allclose(np.abs((axes * vec[:, ::-1][:, :3]).sum(0)), 1, atol=1e-10)
    theirs = preprocess.principal_axes(np.cov(x.T, bias=True), 3)[0]
    assert np.abs(axes - theirs).max() < 1e-6


def test_few_dimensions_equal_rows_and_none(spark):
    r = np.random.default_rng(2)
    flat = r.standard_normal((40, 2)) @ r.standard_normal((2, 9))
    out, axes = subspace.apply_wide_pca(table(spark, flat), 4, extra=2)
    assert axes.shape == (9, 2)
    s = np.array([v.y for v in out.orderBy("t").collect()])
    assert np.allclose(s @ axes.T + flat.mean(0), flat)
    same, axes = subspace.apply_wide_pca(table(spark, np.ones((5, 3))), 2)
    assert axes.shape == (3, 0) and [v.y for v in same.collect()] == [[]] * 5
    assert subspace.leading_axes(table(spark, np.ones((5, 3))).where("t < 0"), 2)[0].shape == (0, 0)


def test_no_square_of_many_channels(spark):
    q = 4000
    wave = np.sin(np.arange(q) / 50) / np.linalg.norm(np.sin(np.arange(q) / 50))
    r = np.random.default_rng(3)
    x = 30 * r.standard_normal((40, 1)) * wave + 0.01 * r.standard_normal((40, q))
    axes, var, _ = subspace.leading_axes(table(spark, x, 2), 1, extra=4, steps=4)
    assert abs(axes[:, 0] @ wave) == pytest.approx(1, abs=1e-4) and var[0] > 100
