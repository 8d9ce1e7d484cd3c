import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import audit, graph, splits


def test_graph(spark):
    ids = {i: f"ENSG0000000000{i}" for i in (1, 2, 3)}
    aliases = spark.createDataFrame([("p1", ids[1]), ("p2", ids[2]), ("p3", ids[3]), ("p3", "ENSG00000009999"), ("p1", "TP53"), ("p1", "ENSG12"), ("p2", "BRCA2"), ("p2", "ENSP00000000002"), ("p4", "only a name")], "protein string, gene string")
    links = spark.createDataFrame([("p1", "p2", 800), ("p2", "p1", 900), ("p1", "p1", 999), ("p2", "p3", 999)], "protein1 string, protein2 string, score int")
    wanted = spark.createDataFrame([(g,) for g in ids.values()], "gene string")
    edges = graph.build_graph(aliases, links, wanted, 700)
    (e,) = edges.collect()
    assert (e.src, e.dst) == (ids[1], ids[2]) and e.w == pytest.approx(0.9)
    r = graph.graph_report(edges, aliases, wanted).head()
    assert (r.n_edges, r.n_isolated, r.n_mapped, r.n_ambiguous) == (1, 1, 2, 1)
    assert graph.induced(edges, wanted.where(F.col("gene") != ids[2])).isEmpty()


def features(spark, own=(2.0, 4.0)):
    edges = spark.createDataFrame([("A", "V", 1.0), ("A", "B", 1.0), ("B", "V", 1.0)], "src string, dst string, w double")
    q = spark.createDataFrame([("A", 1.0), ("V", 2.0), ("I", None)], "gene string, x double")
    s = spark.createDataFrame([("A", 0, own[0]), ("A", 1, own[1]), ("B", 0, 10.0), ("B", 1, 20.0)], "gene string, k int, score double")
    return {(r.gene, r.k): r for r in graph.neighbour_features(edges, q, s).collect()}


def test_neighbours(spark):
    f = features(spark)
    assert (f["A", 0].prior, f["A", 1].prior, f["V", 0].prior, f["V", 1].prior, f["I", 0].prior) == (10, 20, 6, 12, 0)
    assert f["A", 0].log_support == pytest.approx(math.log(2)) and f["V", 0].log_support == pytest.approx(math.log(3)) and f["I", 0].log_support == 0
    assert f["I", 0].is_missing == 1 and f["A", 0].is_missing == 0
    changed = features(spark, (-99.0, 7.0))  # a target's own score doesn't leak
    assert changed["A", 0].prior == 10 and changed["V", 0].prior != 6


def test_control_split(spark):
    cells = spark.createDataFrame([(b, i) for i, b in enumerate("abc" * 30)], "batch string, cell long")
    parts = {"fit": 12, "calibration": 4, "audit": 4}
    rows = splits.split_controls(cells, parts, 1).collect()
    assert len({r.cell for r in rows}) == len(rows) == 60
    assert Counter((r.batch, r.part) for r in rows) == {(b, p): n for b in "abc" for p, n in parts.items()}
    assert rows_of(splits.split_controls(cells.repartition(7), parts, 1)) == sorted((r.batch, r.cell, r.part) for r in rows) != rows_of(splits.split_controls(cells, parts, 2))
    assert splits.short_batches(cells.where("cell < 30"), parts).count() == 3 and splits.short_batches(cells, parts).isEmpty()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_donors(spark):
    cells = spark.createDataFrame([("a" if i < 8 else "b", i) for i in range(28)], "batch string, cell long")
    d = splits.balanced_donors(cells, 16, 3).collect()
    assert Counter(r.batch for r in d) == {"a": 16, "b": 16} and sorted(r.draw for r in d) == list(range(32))
    assert all((r.cell < 8) == (r.batch == "a") for r in d)


def test_uniform_donors_and_numbers(spark):
    cells = spark.createDataFrame([(i,) for i in range(3000)], "cell long")
    d = splits.uniform_donors(cells, 9000, 3).collect()
    assert sorted(r.draw for r in d) == list(range(9000)) and sorted(map(tuple, d)) == sorted(map(tuple, splits.uniform_donors(cells.repartition(7), 9000, 3).collect()))
    assert max(Counter(r.cell for r in d).values()) < 20 and 2700 < len({r.cell for r in d}) < 3000
    rows = splits.numbered(cells.withColumn("h", splits.hash_order(1, "cell")), "h", "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(3000)) and [r.h for r in rows] == sorted(r.h for r in rows)


def test_selections(spark):
    t = spark.createDataFrame([(str(i), "xy"[i % 2]) for i in range(20)], "target string, cohort string")
    top = splits.hash_top_k(t, 3).collect()
    assert Counter(r.cohort for r in top) == {"x": 3, "y": 3} and {r.place for r in top} == {1, 2, 3}
    cells = spark.createDataFrame([(i % 3, i) for i in range(30)], "target int, cell long")
    assert Counter(r.target for r in splits.sample_per_target(cells, 4, 5).collect()) == {0: 4, 1: 4, 2: 4}
    s = splits.slices(cells, {"fit": 5, "score": 7}, 5).collect()
    assert Counter(r.part for r in s) == {"fit": 5, "score": 7} and len({r.cell for r in s}) == 12


def test_csr(spark):
    cells = spark.createDataFrame([(f"c{i}", i) for i in range(9000)], "cell string, cell_idx long")
    nz = spark.createDataFrame([(f"c{i}", g) for i in range(0, 9000, 3) for g in range(i % 4)], "cell string, gene int")
    rows = splits.csr_offsets(nz, cells).orderBy("cell_idx").collect()
    at = 0
    for r in rows:
        assert r.begin == at
        at += r.nnz


def test_audit(spark):
    rows = [("x-1", "g", "TRUE", "1"), ("y-1", "g", "True", "1.0"), ("y-1", "h", "true", "1"), ("z-2", "g", "FALSE", "1"), ("w-2", "h", "TRUE", "2"), ("v-2", "h", "TRUE", "1")]
    ident = spark.createDataFrame(rows, "barcode string, guide string, coverage string, cells string")
    matrix = spark.createDataFrame([("x-1",), ("y-1",), ("q-9",)], "barcode string")
    assert [r.barcode for r in audit.eligible(ident, matrix).collect()] == ["x-1"]
    assert Counter(r.side for r in audit.unmatched(ident, matrix).collect()) == {"identity": 3, "matrix": 1}
    assert {r.gem: r.guides for r in audit.nested(audit.guide_counts(ident)).collect()} == {"1": {"g": 2, "h": 1}, "2": {"g": 1, "h": 2}}
    assert tuple(audit.distinct_counts(ident).head()) == (5, 2, 6)
