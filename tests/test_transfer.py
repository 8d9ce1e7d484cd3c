import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.operators import metrics, transfer


def long(spark, m, targets, genes):
    return spark.createDataFrame([(t, g, float(m[i][j])) for i, t in enumerate(targets) for j, g in enumerate(genes)], "target string, gene string, y double")


def test_ridge_equals_normal_equations(spark):
    x, y = [1.0, 2.0, None, 5.0, 9.0], (np.arange(15) ** 1.2).reshape(5, 3)
    t = [f"t{i}" for i in range(5)]
    xs = spark.createDataFrame(list(zip(t, x, strict=True)), "target string, x double")
    scale = transfer.fit_scale(xs)
    assert scale.head().median == 3.5
    z = transfer.apply_scale(xs, scale)
    p = {(r.target, r.gene): r.p for r in transfer.ridge_predict(z, transfer.ridge_fit(z, long(spark, y, t, "abc"), 3.0)).collect()}
    v = np.array([3.5 if a is None else a for a in x])
    d = np.stack([np.ones(5), (v - v.mean()) / v.std()], axis=1)
    w = np.linalg.solve(d.T @ d + np.diag([0, 3]), d.T @ y)
    assert max(abs(p[t[i], "abc"[j]] - (d @ w)[i, j]) for i in range(5) for j in range(3)) < 1e-9


def test_cross_validation_fits_on_training_folds_only(spark):
    rng = np.random.default_rng(1)
    t = [f"t{i:02d}" for i in range(12)]
    x, y = rng.normal(size=12), rng.normal(size=(12, 2))
    xs = spark.createDataFrame([(a, None if i % 5 == 0 else float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))], "target string, x double")
    parts = transfer.folds(xs, 3, 2026)
    fold = {r.target: r.fold for r in parts.collect()}
    assert sorted(list(fold.values()).count(k) for k in range(3)) == [4, 4, 4]
    found = {r.alpha: r.mse for r in transfer.alpha_losses(xs, long(spark, y, t, "ab"), parts, [1.0, 10.0]).collect()}
    for alpha in (1.0, 10.0):
        sse = 0.0
        for k in range(3):
            own = [i for i in range(12) if fold[t[i]] != k]
            med = np.median([x[i] for i in own if i % 5])
            v = np.array([med if i % 5 == 0 else x[i] for i in range(12)])
            z = (v - v[own].mean()) / v[own].std()
            for j in range(2):
                b0, b1 = y[own, j].mean(), (z[own] @ y[own, j]) / (z[own] @ z[own] + alpha)
                sse += sum((y[i, j] - b0 - z[i] * b1) ** 2 for i in range(12) if fold[t[i]] == k)
        assert found[alpha] == pytest.approx(sse / 24)
    tie = spark.createDataFrame([(1.0, 0.5), (10.0, 0.5), (0.1, 0.7)], "alpha double, mse double")
    assert transfer.best_alpha(tie).head().alpha == 10.0


def test_matrix(spark):
    rows = [("B", "y", 4.0), ("A", "x", 1.0), ("A", "y", 2.0), ("B", "x", 3.0)]
    t, g = spark.createDataFrame([("A",), ("B",)], "target string"), spark.createDataFrame([("x",), ("y",)], "gene string")
    df = spark.createDataFrame(rows, "target string, gene string, y double")
    assert transfer.matrix_problems(df, t, g).isEmpty()
    assert [r.n for r in transfer.matrix_problems(df.union(df.limit(1)), t, g).collect()] == [2]
    assert [r.n for r in transfer.matrix_problems(df.where("y < 4"), t, g).collect()] == [0]


def test_nearest_line_and_metrics(spark):
    train = long(spark, [[1, 2], [5, 8]], ["A", "B"], "xy")
    held = spark.createDataFrame([("B",), ("C",)], "target string")
    p = {(r.target, r.gene): r.p for r in transfer.nearest_line(train, held).collect()}
    assert p == {("B", "x"): 5, ("B", "y"): 8, ("C", "x"): 3, ("C", "y"): 5}
    zero = transfer.zero_delta(train.select("target").distinct(), train.select("gene").distinct())
    same = train.select(F.lit("same").alias("model"), "target", "gene", F.col("y").alias("p"))
    e = metrics.target_errors(train, zero.unionByName(same))
    cohort = spark.createDataFrame([("A", "shared"), ("B", "unseen")], "target string, cohort string")
    m = {(r.model, r.cohort): r for r in metrics.cohort_metrics(e, cohort).collect()}
    assert m["zero_delta", "all"].mse == 23.5 and m["zero_delta", "all"].mean_target_pearson is None
    assert m["same", "all"].mse == 0 and m["same", "all"].mean_target_pearson == pytest.approx(1) and m["same", "all"].pearson_defined_targets == 2
    assert m["zero_delta", "unseen"].n_targets == 1 and m["same", "unseen"].mse_relative_to_zero == 0


def test_best_per_family(spark):
    rows = [("f", "b", 1.0), ("f", "a", 1.0), ("g", "z", 0.5)]
    best = transfer.best_per_family(spark.createDataFrame(rows, "family string, name string, mse double")).orderBy("place").collect()
    assert [(r.family, r.name) for r in best] == [("g", "z"), ("f", "a")]


def test_moments_count_zeros(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(0.6, (20, 4))
    counts = spark.createDataFrame([(i, j, float(x[i, j]), 50.0) for i in range(20) for j in range(4) if x[i, j]], "cell long, gene int, cnt double, lib double")
    cells = spark.createDataFrame([(i, 50.0) for i in range(20)], "cell long, lib double")
    genes = spark.createDataFrame([(j,) for j in range(4)], "gene int")
    m = metrics.moments(counts, cells, genes)
    v = np.log1p(x * 1e4 / 50)
    for r in m.collect():
        assert (r["mean"], r["variance"], r["dropout"]) == pytest.approx((v[:, r.gene].mean(), v[:, r.gene].var(ddof=1), (x[:, r.gene] == 0).mean()))
    assert list(metrics.distribution_distance(m, m).head()) == [0, 0, 0]
