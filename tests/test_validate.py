import pytest

from deltaloom.operators import validate as v


def reasons(df):
    return sorted(str(r.reason) for r in df.collect())


@pytest.mark.parametrize(("values", "want"), [([-1.0, 2.0], ["negative"]), ([0.5, 2.0], ["whole"]), ([float("nan"), 2.0], ["finite"]), ([None, 2.0], ["finite"]), ([101.0, 0.0], ["total"]), ([100.0, 0.0], [])])
def test_counts(spark, values, want):
    df = spark.createDataFrame([(0, j, x) for j, x in enumerate(values)], "cell long, gene int, cnt double")
    assert reasons(v.bad_counts(df, 100)) == want


def test_library(spark):
    df = spark.createDataFrame([(0, 6.0, 10.0), (0, 5.0, 10.0), (1, 5.0, 5.0), (2, 0.0, 0.0)], "cell long, cnt double, lib double")
    assert sorted(r.cell for r in v.above_library(df).collect()) == [0, 2]
    assert sorted(r.cell for r in v.above_library(df, 1.5).collect()) == [2]


def test_names(spark):
    df = spark.createDataFrame([("a",), ("a",), (" b",), (None,), ("non-targeting",)], "name string")
    assert reasons(v.bad_names(df, "name", 5, "non-targeting")) == ["control", "null", "padded", "repeated"]
    assert reasons(v.bad_names(df.where("name = ' b'"), "name", 2)) == ["padded", "size"]


def test_identifiers(spark):
    df = spark.createDataFrame([("unexpected-id", "A"), ("", ""), ("nan", "B"), ("ENSG1", "C")], "identifier string, symbol string")
    assert reasons(v.bad_identifiers(df)) == ["blank", "kind"]
    ctl = spark.createDataFrame([("nt", "nt"), ("nt", "A"), ("ENSG1", "A")], "identifier string, symbol string")
    assert v.control_disagreement(ctl, "nt").count() == 1


def test_panel(spark):
    found = spark.createDataFrame([("A", "p")] * 2 + [("A", "q")] + [("B", "z")] * 2, "context string, perturbation string")
    want = spark.createDataFrame([("A", "p"), ("A", "q"), ("B", "p")], "context string, perturbation string")
    assert reasons(v.panel_difference(found, want, ["context", "perturbation"], 2)) == ["missing", "size", "unknown"]


def test_axis_and_rest(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "i int, gene string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "y")], "i int, gene string")
    assert v.axis_difference(a, a, "gene", "i").isEmpty() and v.axis_difference(a, b, "gene", "i").count() == 2
    nz = spark.createDataFrame([(0, 1, 3), (0, 2, 0)], "cell long, gene int, cnt int")
    assert v.stored_zeros(nz).count() == 1 and v.too_many_nonzeros(nz, 1).count() == 1 and v.too_many_nonzeros(nz, 2).isEmpty()
    assert v.repeated(a.union(a), "gene").count() == 2
    assert v.incomplete(a.withColumnRenamed("i", "t").where("t = 0"), a.withColumnRenamed("i", "t"), a, "t", "gene").count() == 3
    assert v.not_finite(spark.createDataFrame([(1.0,), (float("inf"),), (None,)], "x double"), "x").count() == 2
    cells = spark.createDataFrame([("c", 0, 1.0), ("d", 1, 1.0)], "context string, target int, lib double")
    assert v.bad_controls(cells, 0).count() == 1 and v.bad_controls(cells.where("target = 0"), 0).isEmpty() and v.bad_controls(cells.where("lib > 5"), 0).count() == 1
