"""Tall matrices on the executors, numbering by ranges, and models whose features have a prior for each component."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.operators import families, graph, lowrank, numbering, tall, transfer


def blocks(spark, m):
    rows = -(-len(m) // tall.SIDE)
    padded = np.zeros((rows * tall.SIDE, m.shape[1]))
    padded[: len(m)] = m
    table = [(i, bytearray(padded[i * tall.SIDE : (i + 1) * tall.SIDE].tobytes())) for i in range(rows)]
    return tall.Tall(spark.createDataFrame(table, "i long, m binary").repartition(5), len(m), m.shape[1])


def whole(x):
    m = [np.frombuffer(r.m, float).reshape(tall.SIDE, x.width) for r in x.blocks.orderBy("i").collect()]
    return np.vstack(m)[: x.length]


@pytest.mark.parametrize(("n", "width"), [(1, 1), (300, 7), (1000, 24)])
def test_triangle_and_directions(spark, n, width):
    m = np.random.default_rng(n).standard_normal((n, width)) * 10.0 ** -np.arange(width)[None, :]
    x = blocks(spark, m)
    r = tall.triangle(x)
    assert r.shape == (width, width) and np.allclose(r.T @ r, m.T @ m, rtol=1e-10, atol=1e-12)
    q = whole(tall.orthonormal(x))
    known = (np.linalg.svd(m, compute_uv=False) > tall.NOTHING * np.linalg.norm(m, 2)).sum()
    assert q.shape == (n, known) and np.abs(q.T @ q - np.eye(known)).max() < 1e-12
    assert np.abs(m - q @ (q.T @ m)).max() < 1e-9


def test_directions_of_no_length(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((500, 3)) @ rng.standard_normal((3, 9))
    assert tall.orthonormal(blocks(spark, m)).width == 3
    assert tall.orthonormal(blocks(spark, np.zeros((200, 4)))).width == 0


def test_products(spark):
    rng = np.random.default_rng(2)
    a, x, y = rng.standard_normal((300, 200)), rng.standard_normal((200, 5)), rng.standard_normal((300, 5))
    a[rng.random(a.shape) < 0.3] = 0
    entries = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row long, column long, e double").repartition(7)
    tiles = tall.tiled(entries, 300, 200)
    assert np.allclose(whole(tall.times(tiles, blocks(spark, x))), a @ x) and np.allclose(whole(tall.times(tiles, blocks(spark, y), transposed=True)), a.T @ y)
    assert tall.gaussian(spark, 300, 4, 7).blocks.count() == 3


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_numbers_by_range(spark, n):
    rng = np.random.default_rng(n)
    keys = rng.permutation(n)
    df = spark.createDataFrame([(int(k) * 3, f"k{k:06}", int(k) % 5) for k in keys], "key long, name string, size long").repartition(5)
    for by in (["key"], ["name"]):
        rows = numbering.by_range(df, by, "at", 6).collect()
        assert sorted((r["key"], r["at"]) for r in rows) == [(3 * i, i) for i in range(n)]
    rows = numbering.running(df, ["key"], "size", "before", 6).orderBy("key").collect()
    assert [r["before"] for r in rows] == [sum(k % 5 for k in range(i)) for i in range(n)] if n < 3 else [r["before"] for r in rows] == np.concatenate([[0], np.cumsum(np.arange(n) % 5)[:-1]]).tolist()


def test_no_window_holds_all_rows(spark):
    plan = numbering.by_range(spark.range(100).withColumnRenamed("id", "key"), ["key"], "at", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(key" not in plan and "range_of_key" in plan


def study(rng, n, genes, rank):
    """Responses of an exact rank, a graph and basal values, some of them missing."""
    y = rng.standard_normal((n, rank)) * (3.0 ** -np.arange(rank)) @ np.linalg.qr(rng.standard_normal((genes, rank)))[0].T + rng.standard_normal(genes)
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.15), 1)
    w += w.T
    w[0] = w[:, 0] = 0  # a target without neighbours
    x = np.where(rng.random(n) < 0.2, np.nan, rng.standard_normal(n))
    return y, w, x


def tables(spark, y, w, x):
    name = "t{:02}".format
    long = spark.createDataFrame([(name(i), j, float(v)) for i, row in enumerate(y) for j, v in enumerate(row)], "target string, gene long, y double")
    edges = spark.createDataFrame([(name(i), name(j), float(w[i, j])) for i, j in zip(*np.nonzero(np.triu(w)), strict=True)], "src string, dst string, w double")
    return long, edges, spark.createDataFrame([(name(i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "target string, x double")


def by_hand(y, w, x, train, query, rank, alpha, string):
    """Predictions of ridge on basal or on all features for the rows in query, from those in train."""
    mean = y[train].mean(0)
    v = np.linalg.svd(y[train] - mean, full_matrices=False)[2][:rank]
    z = (y[train] - mean) @ v.T
    own = w[:, train] * (np.arange(len(y))[:, None] != np.array(train)[None, :])
    total = own.sum(1, keepdims=True)
    f = np.hstack([x[:, None], np.isnan(x)[:, None], np.log1p((own > 0).sum(1))[:, None], np.divide(own @ z, total, out=np.zeros((len(y), rank)), where=total > 0)])
    f = f if string else f[:, :2]
    median = np.nanmedian(f[train], axis=0)
    f = np.where(np.isnan(f), median, f)
    scale = f[train].std(0)
    f = (f - f[train].mean(0)) / np.where(scale == 0, 1, scale)
    c = np.linalg.solve(f[train].T @ f[train] + alpha * np.eye(f.shape[1]), f[train].T @ (z - z.mean(0)))
    return mean + (z.mean(0) + f[query] @ c) @ v


def test_priors_of_each_component(spark):
    y, w, x = study(np.random.default_rng(3), 24, 15, 3)
    long, edges, basal = tables(spark, y, w, x)
    settings = [families.Setting("a", "basal", families.BASAL, 0.5), families.Setting("b", "graph", families.GRAPH, 0.5)]
    maker = families.feature_maker(edges, basal)
    some = long.where("target < 't16'")
    known = {}
    found = families.predict(some, lambda s: maker(s).where("target < 't16'"), lambda s: maker(s).where("target >= 't16'"), settings, 3, 1, known)
    for s in settings:
        p = {(r.target, r.gene): r.p for r in found[s.name].collect()}
        want = by_hand(y, w, x, list(range(16)), list(range(16, 24)), 3, 0.5, s.name == "graph")
        assert len(p) == 8 * 15 and max(abs(p[f"t{i + 16:02}", j] - want[i, j]) for i in range(8) for j in range(15)) < 1e-8
    assert list(known["scaling"]["graph"]) == ["basal", "is_missing", "log_support", "prior0", "prior1", "prior2"]
    parts = transfer.folds(basal, 3, 1)
    losses = {r["name"]: r.mse for r in families.grid_losses(long, parts, maker, settings, 3, 1).collect()}
    fold = {r.target: r.fold for r in parts.collect()}
    for s in settings:
        sse = 0.0
        for k in range(3):
            held = [i for i in range(24) if fold[f"t{i:02}"] == k]
            rest = [i for i in range(24) if i not in held]
            sse += ((by_hand(y, w, x, rest, held, 3, 0.5, s.name == "graph") - y[held]) ** 2).sum()
        assert losses[s.name] == pytest.approx(sse / y.size, rel=1e-7)


def test_own_scores_are_not_seen(spark):
    y, w, x = study(np.random.default_rng(4), 12, 4, 4)
    _, edges, basal = tables(spark, y, w, x)
    queries = basal.withColumnRenamed("target", "gene")
    seen = []
    for moved in (0.0, 100.0):
        rows = [(f"t{i:02}", c, float(y[i, c] + moved * (i == 5))) for i in range(12) for c in range(4)]
        f = graph.neighbour_vectors(edges, queries, spark.createDataFrame(rows, "gene string, component int, z double"))
        seen.append({r.gene: tuple(round(v, 9) for v in tuple(r)[3:]) for r in f.collect()})  # sums may be taken in another order
    assert seen[0]["t05"] == seen[1]["t05"] and seen[0]["t00"] == (0.0,) * 5
    assert {g for g in seen[0] if seen[0][g] != seen[1][g]} == {f"t{i:02}" for i in np.flatnonzero(w[5])}
    # the same as one prior a component in rows
    rows = spark.createDataFrame([(f"t{i:02}", c, float(y[i, c])) for i in range(12) for c in range(4)], "gene string, k int, score double")
    for r in graph.neighbour_features(edges, queries, rows).collect():
        assert seen[0][r.gene][r.k + 1] == pytest.approx(r.prior, abs=1e-8) and seen[0][r.gene][0] == pytest.approx(r.log_support, abs=1e-8)


def test_a_wrong_basis_is_seen(spark):
    y, *_ = study(np.random.default_rng(5), 40, 25, 12)
    long = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(y) for j, v in enumerate(row)], "target long, gene long, y double")
    tail, all_of_it = lowrank.exact_tail(long, 4)
    s = np.linalg.svd(y - y.mean(0), compute_uv=False) ** 2
    assert tail == pytest.approx(s[4:].sum()) and all_of_it == pytest.approx(s.sum())
    mean, basis = lowrank.response_basis(long, 4, 1)
    r = lowrank.basis_report(long, mean, basis).head()
    assert r.components == 4 and r.off < 1e-9 and r.left <= 1.01 * tail and r.whole == pytest.approx(s.sum())
    wrong = basis.withColumn("gene", (F.col("gene") + 1) % 25)
    assert lowrank.basis_report(long, mean, wrong).head().left > 1.01 * tail
    assert lowrank.basis_report(long, mean, basis.withColumn("v", F.col("v") * 1.1)).head().off > 1e-9
