"""Goodness of fit of what generators draw, and calibrations as one way with stops."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models_generation import delta, study

from deltaloom.operators import calibration, generate, splits

DEPTH = 500


@pytest.fixture(scope="module")
def null(spark):
    rng = np.random.default_rng(0)
    shares = {c: rng.dirichlet(np.full(40, 0.7)) for c in "AB"}
    shares["A"][3] = 0
    profile = spark.createDataFrame([(c, f"g{j}", float(v / s.sum())) for c, s in shares.items() for j, v in enumerate(s)], "context string, gene string, share double")
    grid = generate.prediction_grid(spark.createDataFrame([("A",), ("B",)], "context string"), spark.createDataFrame([("p",), ("q",)], "perturbation string"), 60)
    return profile.cache(), grid.cache(), generate.multinomial_null(profile, grid, DEPTH, 7).cache()


def judged(rows):
    return {r[0]: r["agrees"] for r in rows.collect()}


def test_draws_agree(spark, null):
    profile, grid, drawn = null
    assert judged(generate.null_agreement(drawn, profile, grid, DEPTH)) == {"A": True, "B": True}


def test_wrong_generators_are_seen(spark, null):
    profile, grid, drawn = null
    cells = drawn.select("cell_name", "cell_idx", "context").distinct()
    one_gene = cells.withColumn("gene", F.lit("g5")).withColumn("cnt", F.lit(DEPTH).cast("long"))
    assert set(judged(generate.null_agreement(one_gene, profile, grid, DEPTH)).values()) == {False}
    permuted = drawn.withColumn("gene", F.concat(F.lit("g"), ((F.substring("gene", 2, 9).cast("int") + 1) % 40).cast("string")))
    assert set(judged(generate.null_agreement(permuted, profile, grid, DEPTH)).values()) == {False}
    # sums are right, cells are all alike
    first = drawn.groupBy("context", "gene").agg(F.sum("cnt").alias("n")).join(grid.groupBy("context").agg(F.count("*").alias("cells")), "context")
    alike = grid.select("cell_idx", "context").join(first, "context").select("context", "gene", (F.col("n") / F.col("cells")).alias("cnt"))
    assert set(judged(generate.null_agreement(alike, profile, grid, DEPTH)).values()) == {False}
    absent = drawn.unionByName(cells.where("context = 'A'").limit(1).withColumn("gene", F.lit("g3")).withColumn("cnt", F.lit(1).cast("long")))
    assert judged(generate.null_agreement(absent, profile, grid, DEPTH)) == {"A": False, "B": True}
    short = drawn.where(F.col("cell_idx") % 2 == 0)
    assert set(judged(generate.null_agreement(short, profile, grid, DEPTH)).values()) == {False}


def test_transport_agrees(spark):
    rng = np.random.default_rng(1)
    *_, p = study(spark, rng.poisson(3, (20, 12)), [200] * 20)
    p = p.written()
    donors = splits.balanced_donors(p.rows, 300, 1).cache()
    moves = delta(spark, *rng.normal(0, 0.7, 12), target="t").union(delta(spark, *[0] * 12, target="u")).union(delta(spark, *[-9] * 12, target="v")).cache()
    drawn = generate.transport_generate(p, donors, moves, 5).cache()
    assert judged(generate.transport_agreement(drawn, p, donors, moves)) == {"t": True, "u": True, "v": True}
    other = drawn.withColumn("target", F.when(F.col("target") == "t", "u").when(F.col("target") == "u", "t").otherwise("v"))
    assert judged(generate.transport_agreement(other, p, donors, moves)) == {"t": False, "u": False, "v": True}
    moved = drawn.withColumn("idx", F.transform("idx", lambda i: (i + 1) % 12))
    assert judged(generate.transport_agreement(moved, p, donors, moves))["t"] is False


def test_fewer_iterations_are_the_beginning_of_more(spark):
    rng = np.random.default_rng(2)
    *_, p = study(spark, rng.poisson(0.7, (20, 5)), [60] * 20)
    p = p.written()
    donors, zero = splits.balanced_donors(p.rows, 30, 1).cache(), delta(spark, *[0] * 5, target="control")
    calls = []

    def counted(*args):
        calls.append(1)
        return generate.transport_generate(*args)

    found = generate.calibrations(p, donors, zero, (1, 3), 5, generate=counted)
    assert len(calls) == 4 and list(found) == [1, 3]
    for n, c in found.items():
        alone = generate.calibrate(p, donors, zero, n, 5)
        rows = lambda x: [(r.gene, pytest.approx(r.d, abs=1e-12)) for r in x.offsets.orderBy("gene").collect()]
        assert [(r.gene, r.d) for r in c.offsets.orderBy("gene").collect()] == rows(alone)
        assert c.history == pytest.approx(alone.history) and len(c.history) == n + 1 and (c.impossible, c.bounded) == (alone.impossible, alone.bounded)
    assert list(calibration.candidates(p, donors, (0, 1, 3), 5)) == ["legacy", "mean_calibrated_1", "mean_calibrated_3"] and list(calibration.candidates(p, donors, (0,), 5)) == ["legacy"]
