import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deltaloom.operators import calibration, generate, lowrank, metrics, splits


def test_basis_recovers_low_rank(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 25)) + 4
    df = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(30) for j in range(25)], "target long, gene long, y double")
    mean, basis = lowrank.response_basis(df, 3, 1)
    p = {(r.target, r.gene): r.p for r in lowrank.reconstruct(lowrank.project(df, mean, basis), mean, basis).collect()}
    assert max(abs(p[i, j] - y[i, j]) for i in range(30) for j in range(25)) < 1e-8
    v = np.zeros((3, 25))
    for r in basis.collect():
        v[r.component, r.gene] = r.v
    assert np.abs(v @ v.T - np.eye(3)).max() < 1e-10


def test_multi_feature_ridge(spark):
    x = np.array([[1, 8], [3, 4], [5, 8], [7, 12]], float)
    z = (x - x.mean(0)) / x.std(0)
    s = np.arange(12).reshape(4, 3).astype(float)
    f = spark.createDataFrame([(i, float(z[i, 0]), float(z[i, 1])) for i in range(4)], "target long, a double, b double")
    sc = spark.createDataFrame([(i, c, float(s[i, c])) for i in range(4) for c in range(3)], "target long, component int, z double")
    w = lowrank.ridge_fit(f, sc, ["a", "b"], 2)
    d = np.hstack([np.ones((4, 1)), z])
    want = d @ np.linalg.solve(d.T @ d + np.diag([0, 2, 2]), d.T @ s)
    got = {(r.target, r.component): r.z for r in lowrank.ridge_predict(f, ["a", "b"], w).collect()}
    assert max(abs(got[i, c] - want[i, c]) for i in range(4) for c in range(3)) < 1e-9


def test_basis_of_named_genes(spark):
    """Ids of genes and targets are text, as real ones are; a pair may be absent."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=(12, 2)) @ rng.normal(size=(2, 9)) + rng.normal(size=9)
    df = spark.createDataFrame([(f"ENSG{i:011}", f"g{j}", float(y[i, j])) for i in range(12) for j in range(9)], "target string, gene string, y double")
    mean, basis = lowrank.response_basis(df.repartition(5), 2, 1)
    assert dict(basis.dtypes) == {"component": "int", "gene": "string", "v": "double"}
    p = {(r.target, r.gene): r.p for r in lowrank.reconstruct(lowrank.project(df, mean, basis), mean, basis).collect()}
    assert max(abs(p[f"ENSG{i:011}", f"g{j}"] - y[i, j]) for i in range(12) for j in range(9)) < 1e-8
    part = lowrank.project(df.where("not (target = 'ENSG00000000003' and gene = 'g4')"), mean, basis)
    assert part.count() == 24


def test_trees(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    z = (x[:, 0] > 0).astype(float)
    f = spark.createDataFrame([(f"t{i:02}", float(x[i, 0]), float(x[i, 1])) for i in range(60)], "target string, a double, b double")
    sc = spark.createDataFrame([(f"t{i:02}", c, float(z[i] * (c + 1))) for i in range(60) for c in range(2)], "target string, component int, z double")
    fit = lambda n: lowrank.trees_fit(f.repartition(n), sc.repartition(n), ["a", "b"], 3, 5, 0.3, 5)
    lowrank.save_trees(fit(3), f"{tmp_path}/trees")
    runs = [sorted(map(tuple, lowrank.trees_predict(m, f, ["a", "b"]).collect())) for m in (fit(1), lowrank.load_trees(spark, f"{tmp_path}/trees"))]
    assert runs[0] == runs[1] and len(runs[0]) == 120
    # one split is right, so each round takes 0.3 of what is left
    left = 0.7**5
    assert all(v == pytest.approx((c + 1) * (z.mean() + (z[int(t[1:])] - z.mean()) * (1 - left)), abs=1e-9) for t, c, v in runs[0])
    for bad in ({"leaves": 1}, {"rounds": 0}, {"rate": 0.0}, {"least": 0}):
        with pytest.raises(ValueError, match="parameters"):
            lowrank.trees_fit(f, sc, ["a"], **({"leaves": 3, "rounds": 1, "rate": 0.1, "least": 1} | bad))


def test_a_tree_has_its_leaves_and_least(spark):
    rng = np.random.default_rng(8)
    x, g = rng.normal(size=(400, 3)), rng.normal(size=400)
    for leaves, least in ((2, 1), (7, 40), (15, 40), (31, 5)):
        nodes = np.array(lowrank.grow_tree(x, g, leaves, least), float)
        ends = nodes[:, 0] < 0
        assert ends.sum() <= leaves and len(nodes) == 2 * ends.sum() - 1
        got = lowrank._walk(nodes, x)
        values, n = np.unique(got, return_counts=True)
        assert n.min() >= least and all(v == pytest.approx(g[got == v].mean()) for v in values)
    # the first split is the best of all there are
    best = max(((x[:, j] <= t) for j in range(3) for t in x[:, j]), key=lambda m: m.sum() * g[m].mean() ** 2 + (~m).sum() * g[~m].mean() ** 2 if 40 <= m.sum() <= 360 else -1)
    assert sorted(set(lowrank._walk(np.array(lowrank.grow_tree(x, g, 2, 40), float), x))) == pytest.approx(sorted([g[best].mean(), g[~best].mean()]))
    assert len(lowrank.grow_tree(np.ones((50, 2)), g[:50], 9, 1)) == 1


def study(spark, counts, libs, batches=None, name="g{}"):
    counts = np.asarray(counts)
    cells = spark.createDataFrame([(i, batches[i] if batches else "a", float(libs[i])) for i in range(len(libs))], "cell long, batch string, lib double")
    long = spark.createDataFrame([(i, name.format(j), float(v), float(libs[i])) for i, r in enumerate(counts) for j, v in enumerate(r) if v], "cell long, gene string, cnt double, lib double")
    genes = spark.createDataFrame([(name.format(j),) for j in range(counts.shape[1])], "gene string")
    return cells, long, genes, generate.transport_profiles(long, cells, genes)


def delta(spark, *d, target="t", name="g{}"):
    return spark.createDataFrame([(target, name.format(j), None if v is None else float(v)) for j, v in enumerate(d)], "target string, gene string, d double")


def test_transport(spark):
    *_, p = study(spark, [[10, 20, 30], [30, 10, 20], [15, 25, 20]], [100, 90, 80])
    donors = splits.balanced_donors(p.rows, 64, 1)
    runs = []
    for n in (1, 3):
        drawn = generate.transport_generate(p, donors.repartition(n), delta(spark, 0, 0, 0).union(delta(spark, 0, 0, 0, target="u")).repartition(n), 5)
        runs.append(sorted(map(str, drawn.collect())))
    assert runs[0] == runs[1] and len(runs[0]) == 128
    rows = drawn.collect()
    assert all(sum(r.cnt) <= r.depth and min(r.cnt) > 0 and r.depth in (100, 90, 80) for r in rows)
    long = generate.generated_counts(drawn, p).collect()
    assert {r.gene for r in long} == {"g0", "g1", "g2"} and sum(r.cnt for r in long) == sum(sum(r.cnt) for r in rows)


def test_moments_of_generated_cells(spark):
    _, _, _, p = study(spark, [[10, 0, 3], [1, 1, 0], [0, 5, 0]], [20, 30, 40])
    drawn = generate.transport_generate(p, splits.uniform_donors(p.rows, 50, 1), delta(spark, 0, 0.5, -1), 5)
    x = np.zeros((50, 3))
    for i, r in enumerate(drawn.collect()):
        x[i, r.idx] = np.log1p(np.array(r.cnt) * 1e4 / r.depth)
    got = generate.generated_moments(drawn, p).orderBy("gene").collect()
    assert [r["mean"] for r in got] == pytest.approx(x.mean(0)) and [r["variance"] for r in got] == pytest.approx(x.var(0, ddof=1)) and [r["dropout"] for r in got] == pytest.approx((x == 0).mean(0))
    r = generate.sample_report(drawn, p, delta(spark, 0, 0.5, -1)).head()
    mean = np.array([m["mean"] for m in generate.transport_mean(p).orderBy("gene").collect()])
    assert r.delta_rmse == pytest.approx(np.sqrt(np.mean((x.mean(0) - mean - [0, 0.5, -1]) ** 2))) and 0 < r.clip_fraction < 1


def test_direction(spark):
    *_, p = study(spark, [[30, 30]] * 5, [100] * 5)
    donors = splits.balanced_donors(p.rows, 200, 1)
    mean = lambda d: [r["mean"] for r in generate.generated_moments(generate.transport_generate(p, donors, d, 2), p).orderBy("gene").collect()]
    base, moved = mean(delta(spark, 0, 0)), mean(delta(spark, 1, -1))
    assert moved[0] > base[0] and moved[1] < base[1]


@pytest.mark.parametrize("counts, libs", [([[30, 30], [50, 60]], [100, 100]), ([[30.5, 3], [1, 1]], [100, 100]), ([[-1, 3], [1, 1]], [100, 100]), ([[1, 3], [1, 1]], [100, 0]), ([[1, 3], [1, 1]], [100, 10.5]), ([[1, 3], [1, 1]], [100, 2e6]), ([[float("nan"), 3], [1, 1]], [100, 100])])
def test_refuses_control_cells(spark, counts, libs):
    *_, p = study(spark, counts, libs)
    with pytest.raises(Exception, match="must be whole"):
        p.rows.collect()


@pytest.mark.parametrize("d", [(0.0,), (0.0, float("nan")), (0.0, None), (0.0, 0.0, 0.0), (0.0, 100.0), (0.0, float("inf"))])
def test_refuses_deltas(spark, d):
    *_, p = study(spark, [[30, 30]] * 3, [100] * 3)
    with pytest.raises(Exception, match="must be finite and cover|out of range"):
        generate.transport_generate(p, splits.balanced_donors(p.rows, 4, 1), delta(spark, *d), 1).collect()


def test_refuses_donors_and_parameters(spark):
    *_, p = study(spark, [[30, 30]] * 3, [100] * 3)
    donors, zero = splits.balanced_donors(p.rows, 4, 1), delta(spark, 0, 0)
    with pytest.raises(Exception, match="no profile"):
        generate.transport_generate(p, donors.withColumn("cell", F.lit(99)), zero, 1).collect()
    for bad in ({"iterations": 0}, {"rate": 0.0}, {"rate": 1.5}, {"step": 0.0}, {"step": 5.0}, {"most": float("inf")}, {"iterations": 1.5}):
        with pytest.raises(ValueError, match="parameters"):
            generate.calibrate(p, donors, zero, **({"iterations": 1, "seed": 1} | bad))
    with pytest.raises(ValueError, match="within"):
        generate.calibrate(p, donors, delta(spark, 0, -4.5), 1, 1)
    with pytest.raises(ValueError, match="finite"):
        generate.calibrate(p, donors, delta(spark, 0, float("nan")), 1, 1)
    for f in (splits.balanced_donors, splits.uniform_donors):
        with pytest.raises(ValueError, match="draws"):
            f(p.rows, 0, 1)


def test_calibration_improves_means(spark):
    rng = np.random.default_rng(4)
    x = rng.poisson(0.5, (40, 6))
    *_, p = study(spark, x, [100] * 40)
    p = p.written()
    donors = splits.balanced_donors(p.rows, 80, 1).cache()
    zero = delta(spark, *[0] * 6)
    c = generate.calibrate(p, donors, zero, 6, 1)
    assert len(c.history) == 7 and c.history[-1] < c.history[0] and c.impossible == c.bounded == 0
    report = lambda d, seed: generate.sample_report(generate.transport_generate(p, donors, d, seed), p, zero).head()
    assert np.mean([report(c.offsets, s).delta_rmse for s in (11, 12)]) < 0.75 * np.mean([report(zero, s).delta_rmse for s in (11, 12)])
    drawn, r = generate.generate_calibrated(p, donors, c, 11)
    assert drawn.count() == 80 and r.head().delta_rmse == pytest.approx(report(c.offsets, 11).delta_rmse) and r.head().within_depth and r.head().max_panel <= 100


def test_calibration_steps_from_the_request(spark):
    """One iteration in closed form: the first offset is the request, the last evaluation's isn't applied."""
    *_, p = study(spark, [[2, 5, 8]] * 30, [100] * 30)
    donors, asked = splits.balanced_donors(p.rows, 60, 1), delta(spark, 0.1, -0.1, -3)
    c = generate.calibrate(p, donors, asked, 1, 5, most=3.0)
    mean = np.array([r["mean"] for r in generate.transport_mean(p).orderBy("gene").collect()])
    first = np.array([r["mean"] for r in generate.generated_moments(generate.transport_generate(p, donors, asked, 5), p).orderBy("gene").collect()])
    error = np.maximum(mean + [0.1, -0.1, -3], 0) - first
    want = np.clip(np.array([0.1, -0.1, -3]) + np.clip(0.5 * error, -0.25, 0.25), -3.0, 3.0)
    assert [r.d for r in c.offsets.orderBy("gene").collect()] == pytest.approx(want) and c.history[0] == pytest.approx(np.sqrt(np.mean(error**2)))


def test_calibration_of_an_impossible_mean(spark):
    *_, p = study(spark, [[2, 5, 8]] * 100, [10_000] * 100)
    c = generate.calibrate(p, splits.balanced_donors(p.rows, 100, 1), delta(spark, 0.1, -0.1, -3), 4, 1)
    assert c.impossible == 1
    drawn, _ = generate.generate_calibrated(p, splits.balanced_donors(p.rows, 100, 2), c, 2)
    n = generate.generated_counts(drawn, p).where("gene = 'g2'").agg(F.coalesce(F.sum("cnt"), F.lit(0))).head()[0]
    assert n / 100 < 0.1


def test_multinomial_null(spark):
    share = {"A": (0.9, 0.1, 0.0), "B": (0.0, 0.9, 0.1), "C": (0.1, 0.0, 0.9)}
    profile = spark.createDataFrame([(c, f"g{j}", v) for c, p in share.items() for j, v in enumerate(p)], "context string, gene string, share double")
    grid = generate.prediction_grid(spark.createDataFrame([(c,) for c in share], "context string"), spark.createDataFrame([("G1",), ("G2",)], "perturbation string"), 4)
    assert [r.cell_idx for r in grid.orderBy("context", "perturbation", "replicate").collect()] == list(range(24))
    nz = generate.multinomial_null(profile, grid, 10, 7)
    assert sorted(map(str, nz.collect())) == sorted(map(str, generate.multinomial_null(profile.repartition(3), grid.repartition(5), 10, 7).collect()))
    sums = nz.groupBy("cell_name").agg(F.sum("cnt").alias("n")).collect()
    assert len(sums) == 24 and {r.n for r in sums} == {10}
    absent = {"A": "g2", "B": "g0", "C": "g1"}
    assert all(absent[r.context] != r.gene for r in nz.select("context", "gene").distinct().collect()) and nz.where("cnt <= 0").isEmpty()
    e = generate.expected_nonzeros(profile, 10, "context").where("context = 'A'").head().expected
    assert e == pytest.approx(1 - 0.1**10 + 1 - 0.9**10)


def test_candidate_selection(spark):
    rows = [("legacy", 1, 0.2), ("legacy", 2, 0.2), ("new", 1, 0.01), ("new", 2, 0.5)]
    df = spark.createDataFrame(rows, "candidate string, seed int, score double")
    assert calibration.select_candidate(df).head().candidate == "legacy" and calibration.seed_problems(df).isEmpty()
    assert not calibration.seed_problems(df.where("not (candidate = 'new' and seed = 2)")).isEmpty()
    tie = spark.createDataFrame([("a", 1, 0.2), ("legacy", 1, 0.2)], "candidate string, seed int, score double")
    assert calibration.select_candidate(tie).head().candidate == "legacy"


def test_evaluation(spark):
    rng = np.random.default_rng(5)
    cells, long, genes, p = study(spark, rng.poisson(2, (12, 3)), [50] * 12)
    reference = metrics.moments(long, cells, genes)
    deltas = calibration.candidates(p, splits.balanced_donors(p.rows, 12, 1), (0, 2), 5)
    out = calibration.evaluate_candidates(p, lambda seed: splits.balanced_donors(p.rows, 12, seed), deltas, reference, [1, 2]).collect()
    assert sorted((r.candidate, r.seed) for r in out) == [("legacy", 1), ("legacy", 2), ("mean_calibrated_2", 1), ("mean_calibrated_2", 2)] and all(r.mean_log_rmse > 0 for r in out)


def test_grid(spark):
    from deltaloom.operators import families, transfer

    rng = np.random.default_rng(9)
    x = rng.normal(size=24)
    rows = [(f"t{i:02d}", j, float(x[i] * (j + 1) + 0.01 * rng.normal())) for i in range(24) for j in range(4)]
    y = spark.createDataFrame(rows, "target string, gene long, y double")
    f = spark.createDataFrame([(f"t{i:02d}", None if i == 5 else float(x[i]), float(rng.normal())) for i in range(24)], "target string, a double, b double")
    settings = [families.Setting("ridge", "good", ("a",), 0.1), families.Setting("ridge", "bad", ("b",), 0.1), families.Setting("trees", "trees", ("a",), leaves=3, rounds=2, rate=0.3, least=2)]
    losses = families.grid_losses(y, transfer.folds(y, 2, 1), lambda scores: f, settings, 2, 1)
    chosen = families.choose(losses)
    assert chosen["winner"] == "good" and chosen["best"] == {"ridge": "good", "trees": "trees", "training_mean": "training_mean"} and losses.count() == 4
    # the same losses from predictions spelt out
    parts, want = transfer.folds(y, 2, 1), {s.name: 0.0 for s in settings} | {"training_mean": 0.0}
    for k in (0, 1):
        held = parts.where(F.col("fold") == k).select("target")
        train = y.join(held, "target", "left_anti")
        own, asked = f.join(held, "target", "left_anti"), f.join(held, "target", "left_semi")
        mean = train.groupBy("gene").agg(F.avg("y").alias("p")).crossJoin(held).select("target", "gene", "p")
        for name, p in (families.predict(train, lambda _, f=own: f, lambda _, f=asked: f, settings, 2, 1) | {"training_mean": mean}).items():
            want[name] += p.join(y, ["target", "gene"]).agg(F.sum((F.col("p") - F.col("y")) ** 2)).head()[0] / 96
    assert {r["name"]: r.mse for r in losses.collect()} == pytest.approx(want)
