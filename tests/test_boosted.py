import numpy as np
import pytest

from deltaloom.operators import boosted, families, lowrank


def tables(spark, x, z):
    names = [f"f{i}" for i in range(x.shape[1])]
    f = spark.createDataFrame([(f"t{i:04}", *map(float, r)) for i, r in enumerate(x)], "target string, " + ", ".join(f"{n} double" for n in names))
    s = spark.createDataFrame([(f"t{i:04}", c, float(v)) for i, r in enumerate(z) for c, v in enumerate(r)], "target string, component int, z double")
    return f, s, names


def nodes(model):
    return sorted(tuple(r) for r in model.collect())


def test_bins_of_one_value_give_the_exact_trees(spark, monkeypatch):
    monkeypatch.setattr(boosted, "BLOCK", 17)
    monkeypatch.setattr(boosted, "WRITTEN", 2)
    rng = np.random.default_rng(0)
    x = np.hstack([rng.standard_normal((90, 2)), rng.integers(0, 4, (90, 1))])
    z = np.stack([np.sin(3 * x[:, 0]) + x[:, 2], 1e-3 * x[:, 1] * x[:, 0]], axis=1)
    f, s, names = tables(spark, x, z)
    want = nodes(lowrank.trees_fit(f, s, names, 4, 5, 0.3, 6))
    got = nodes(boosted.trees_fit(f.repartition(3), s, names, 4, 5, 0.3, 6))
    assert [r[:4] + r[5:7] for r in got] == [r[:4] + r[5:7] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want]) and [r[7] for r in got] == pytest.approx([r[7] for r in want], rel=1e-6, abs=1e-9)
    # the same trees, to the last bit, from any partitioning
    assert nodes(boosted.trees_fit(f.repartition(7), s.repartition(2), names, 4, 5, 0.3, 6)) == got


def test_leaves_of_least_forty_and_bins_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(boosted, "BLOCK", 200)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 2))
    z = (np.sign(x[:, 0]) + 0.5 * x[:, 1] ** 2 + 0.1 * rng.standard_normal(1500))[:, None]
    f, s, names = tables(spark, x, z)
    model = boosted.trees_fit(f, s, names, 7, 4, 0.5, 40)
    found = {}
    for c, t, node, feature, threshold, low, high, value in nodes(model):
        found.setdefault(t, []).append((feature, threshold, low, high, value))
    p = np.full(1500, found[-1][0][4])
    assert p[0] == pytest.approx(z.mean(), abs=1e-9)
    errors = [np.mean((z[:, 0] - p) ** 2)]
    for t in range(4):
        tree = np.array(found[t])
        leaf = lowrank._walk(tree, x)
        values, n = np.unique(leaf, return_counts=True)
        assert (tree[:, 0] < 0).sum() == 7 and n.min() >= 40
        assert all(v == pytest.approx(0.5 * (z[:, 0] - p)[leaf == v].mean(), abs=1e-9) for v in values)
        p = p + leaf
        errors.append(np.mean((z[:, 0] - p) ** 2))
    assert all(b < a for a, b in zip(errors, errors[1:], strict=False))
    # 255 bins of six targets lose little against every value: at most those of the bin at the step
    exact = {(r.target): r.z for r in lowrank.trees_predict(lowrank.trees_fit(f, s, names, 7, 4, 0.5, 40), f, names).collect()}
    best = np.mean([(z[i, 0] - exact[f"t{i:04}"]) ** 2 for i in range(1500)])
    assert errors[-1] < 1.2 * best
    got = {r.target: r.z for r in lowrank.trees_predict(model, f, names).collect()}
    assert [got[f"t{i:04}"] for i in range(1500)] == pytest.approx(p.tolist())


def test_nothing_to_split(spark):
    f, s, names = tables(spark, np.ones((20, 2)), np.arange(20.0)[:, None])
    assert [r[2:4] for r in nodes(boosted.trees_fit(f, s, names, 7, 2, 0.1, 1))] == [(0, -1)] * 3
    for bad in ({"leaves": 1}, {"rounds": 0}, {"rate": 0.0}, {"least": 0}, {"bins": 256}):
        with pytest.raises(ValueError, match="parameters"):
            boosted.trees_fit(f, s, names, **({"leaves": 3, "rounds": 1, "rate": 0.1, "least": 1} | bad))
    with pytest.raises(ValueError, match="lacks"):
        boosted.trees_fit(f, s.union(s.limit(1).selectExpr("target", "component + 1", "z")), names, 2, 1, 0.1, 1)


def test_settings_may_ask_for_histograms(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (40, 2)).astype(float)
    f, s, names = tables(spark, x, x[:, :1] * 2 + x[:, 1:])
    settings = [families.Setting("trees", f"t{b}", tuple(names), leaves=3, rounds=3, rate=0.3, least=4, bins=b) for b in (0, 255)]
    z = {}
    for r in families.predicted_scores(s, f, f, settings).collect():
        z.setdefault(r["name"], {})[r.target] = r.z
    assert z["t0"] == pytest.approx(z["t255"])
