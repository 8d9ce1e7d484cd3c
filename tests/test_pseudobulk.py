"""The hand-computed fixture of five cells and two genes, with unequal batches."""

import pytest
from pyspark.sql import functions as F

from deltaloom.functions.expr import target_id
from deltaloom.operators import cohorts, pseudobulk, validate

CELLS = [(0, "non-targeting", "nt1", 1), (1, "non-targeting", "nt2", 2), (2, "A", "g1", 1), (3, "A", "g2", 1), (4, "A", "g1", 2)]
COUNTS = [(1, 9), (8, 2), (2, 8), (3, 7), (9, 1)]


def tables(spark, cells=CELLS, counts=COUNTS):
    c = spark.createDataFrame([("L", t, b, g, i, 10.0) for i, t, g, b in cells], "line string, target string, batch int, guide string, cell long, lib double")
    n = spark.createDataFrame([(i, f"ENSG{j + 1}", float(v)) for i, row in enumerate(counts) for j, v in enumerate(row)], "cell long, gene string, cnt double")
    return c, c.join(n, "cell")


def test_matched_delta(spark):
    cells, counts = tables(spark)
    d = {r.gene: r for r in pseudobulk.matched_delta(counts, cells, "non-targeting").collect()}
    assert d["ENSG1"].delta_raw == pytest.approx(4 / 3) and d["ENSG2"].delta_raw == pytest.approx(-4 / 3)
    assert d["ENSG1"].delta_log == pytest.approx(0.636121, abs=1e-6) and d["ENSG2"].delta_log == pytest.approx(-0.353900, abs=1e-6)
    assert (d["ENSG1"].n_cells, d["ENSG1"].n_guides, d["ENSG1"].n_batches) == (3, 2, 2)


def test_zeros_count(spark):
    cells, counts = tables(spark)
    sparse = counts.where("not (cell = 4 and gene = 'ENSG2')")
    d = {r.gene: r for r in pseudobulk.matched_delta(sparse, cells, "non-targeting").collect()}
    assert d["ENSG2"].mean_raw == pytest.approx((8 + 7) / 3)


def test_partitions_do_not_matter(spark):
    cells, counts = tables(spark)
    for n in (1, 5):
        d = pseudobulk.matched_delta(counts.repartition(n), cells.repartition(n), "non-targeting")
        assert sorted(round(r.delta_raw, 6) for r in d.collect()) == [-1.333333, 1.333333]


def test_baseline_and_strata(spark):
    cells, counts = tables(spark)
    groups, genes, stats = pseudobulk.strata(cells), pseudobulk.panel(counts), pseudobulk.group_sums(counts)
    base = {r.gene: r.mean_raw for r in pseudobulk.control_baseline(stats, groups, genes, "non-targeting").collect()}
    assert base == {"ENSG1": 4.5, "ENSG2": 5.5}
    s = {r.batch: (r.n_target_cells, r.n_control_cells) for r in pseudobulk.matched_strata(groups, "non-targeting").collect()}
    assert s == {1: (2, 1), 2: (1, 1)}
    report = pseudobulk.quality_report(counts, cells).head()
    assert report.n_cells == 5 and report.min_retained == 1.0 and report.whole and report.within_library


def test_missing_batch_is_an_error(spark):
    cells = [*CELLS[:4], (4, "A", "g1", 3)]
    c, _ = tables(spark, cells)
    bad = validate.too_few_controls(pseudobulk.strata(c), "non-targeting", 1)
    assert [(r.batch, r.n_control) for r in bad.collect()] == [(3, 0)]
    with pytest.raises(validate.Violation, match="matched controls"):
        validate.require(bad, "matched controls")


def test_unmapped(spark):
    rows = spark.createDataFrame([("nan", "A"), ("nan", "B"), ("", "A"), ("ENSG1", "C"), (None, "D")], "identifier string, symbol string")
    found = {r.target_id: r.n_cells for r in cohorts.unmapped(rows).collect()}
    assert found == {"UNMAPPED:A": 2, "UNMAPPED:B": 1, "UNMAPPED:D": 1}
    assert rows.select(target_id("identifier", "symbol").alias("t")).where("t = 'ENSG1'").count() == 1


def test_cohorts_and_axis(spark):
    t = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("B", 3)], "line string, target int")
    assert {(r.target, r.cohort) for r in cohorts.cohorts(t, "A", "B").collect()} == {(2, "shared"), (3, "unseen")}
    g = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "z"), ("B", "z"), ("B", "y")], "line string, gene string")
    assert [(r.gene, r.gene_idx) for r in cohorts.common_axis(g, "A", "B").orderBy("gene_idx").collect()] == [("y", 0), ("z", 1)]
    assert cohorts.membership(g, g.where(F.col("gene") == "x"), "gene").where("is_member").count() == 1


def test_incremental_sums(spark, tmp_path):
    from deltaloom.streaming.incremental import read_sums, sums_writer

    cells, counts = tables(spark)
    write = sums_writer(str(tmp_path))
    write(counts.where("cell < 3"), 0)
    write(counts.where("cell >= 3"), 1)
    write(counts.where("cell >= 3"), 1)  # again after a failure
    want = {(r.target, r.batch, r.gene): round(r.s_log, 9) for r in pseudobulk.group_sums(counts).collect()}
    assert {(r.target, r.batch, r.gene): round(r.s_log, 9) for r in read_sums(spark, str(tmp_path), 1).collect()} == want
