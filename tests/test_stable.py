"""Moments and losses of responses that are large next to what is to be found in them."""

import numpy as np
import pytest

from deltaloom.operators import families, metrics, transfer


def by_hand(x, y, fold, alpha):
    sse = 0.0
    for k in set(fold):
        own, held = fold != k, fold == k
        z = (x - x[own].mean()) / x[own].std()
        b0 = y[own].mean(0)
        b1 = z[own] @ (y[own] - b0) / (z[own] @ z[own] + alpha)
        sse += ((y[held] - b0 - z[held, None] * b1) ** 2).sum()
    return sse / y.size


@pytest.mark.parametrize("slope", [0.0, 3e4])
def test_losses(spark, slope):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(60)
    y = np.linspace(1e5, 3e5, 20)[None, :] + slope * x[:, None] * np.linspace(-1, 1, 20) + 1e-3 * rng.standard_normal((60, 20))
    name = "t{:02}".format
    long = spark.createDataFrame([(name(i), j, float(v)) for i, r in enumerate(y) for j, v in enumerate(r)], "target string, gene long, y double")
    feature = spark.createDataFrame([(name(i), float(v)) for i, v in enumerate(x)], "target string, x double")
    parts = transfer.folds(feature, 5, 1)
    fold = np.array([r.fold for r in parts.orderBy("target").collect()])
    got = {r.alpha: r.mse for r in transfer.alpha_losses(feature, long, parts, [0.0, 1.0, 100.0]).collect()}
    assert got == {a: pytest.approx(by_hand(x, y, fold, a), rel=1e-6) for a in (0.0, 1.0, 100.0)}
    if slope:
        f = feature.withColumnRenamed("x", "a")
        grid = families.grid_losses(long, parts, lambda s: f, [families.Setting("ridge", "ridge", ("a",), 0.0)], 1, 1)
        # one component holds all but the noise
        assert {r["name"]: r.mse for r in grid.collect()}["ridge"] == pytest.approx(by_hand(x, y, fold, 0.0), rel=1e-4)


def test_moments(spark):
    rng = np.random.default_rng(2)
    n, scale = 500, 1e4
    counts = np.where(rng.random((n, 3)) < [0.0, 0.5, 1.0], 0, 10**6 + rng.integers(0, 3, (n, 3)))
    lib = np.full(n, 1e7)
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(lib)], "cell long, lib double")
    rows = spark.createDataFrame([(i, j, float(counts[i, j]), float(lib[i])) for i in range(n) for j in range(3) if counts[i, j]], "cell long, gene long, cnt double, lib double")
    genes = spark.createDataFrame([(j,) for j in range(3)], "gene long")
    x = np.log1p(counts.astype(np.longdouble) * scale / lib[:, None])
    got = metrics.moments(rows.repartition(7), cells, genes).orderBy("gene").collect()
    assert [r["mean"] for r in got] == pytest.approx([float(v) for v in x.mean(0)], rel=1e-12)
    # values differ in the seventh digit: squares of sums would leave nothing of the first gene's variance
    assert [r["variance"] for r in got] == pytest.approx([float(v) for v in x.var(0, ddof=1)], rel=1e-6)
    assert [r["dropout"] for r in got] == pytest.approx((counts == 0).mean(0))
