"""Steps whose tasks must not grow with the tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from deltaloom import session
from deltaloom.sources import star

SF = "/root/testdata/sf0.001"


def test_counts_are_dealt_out_by_size(spark, monkeypatch):
    if not Path(SF).exists():
        pytest.skip("no tables")
    few = {tuple(r) for r in star.raw_counts(spark, SF).collect()}
    monkeypatch.setattr(session, "TASK_BYTES", 10_000, raising=False)
    wanted = Path(f"{SF}/lineitem.parquet").stat().st_size // 10_000
    raw = star.raw_counts(spark, SF)
    rows = [(r.task, *r[:3]) for r in raw.withColumn("task", F.spark_partition_id()).collect()]
    assert {r[1:] for r in rows} == few and len(rows) == len(few)
    assert len({r[0] for r in rows}) >= min(wanted, 12)  # Spark made one of them before
    assert len({(r[0], r[1]) for r in rows}) == len({r[1] for r in rows})  # a cell is in one task


def test_blocks_are_made_of_written_counts(spark, monkeypatch):
    """The store is made of several reads of the counts, which are joined and summed once."""
    from deltaloom.plans import registry

    if not Path(SF).exists():
        pytest.skip("no tables")
    read = []
    write = registry.blocks.write_blocks
    monkeypatch.setattr(registry.blocks, "write_blocks", lambda counts, cells, path: (read.extend([*counts.inputFiles(), *cells.inputFiles()]), write(counts, cells, path)))
    registry.blocked_cells(spark, SF)
    assert read and not any(SF in f for f in read)


def test_folds_go_side_by_side(spark, monkeypatch):
    """Losses of a grid are those of one fold after the other, but folds don't wait for one another."""
    import threading

    from deltaloom.operators import families, transfer

    y = spark.createDataFrame([(f"t{i:02d}", j, float((i * 7 + j * 3) % 11)) for i in range(8) for j in range(3)], "target string, gene long, y double")
    f = spark.createDataFrame([(f"t{i:02d}", float(i % 5)) for i in range(8)], "target string, a double")
    met, settings = threading.Barrier(2, timeout=120), [families.Setting("ridge", "ridge", ("a",), 0.1)]

    def features(scores):
        met.wait()
        return f

    parts = transfer.folds(y, 2, 1)
    found = {r["name"]: r.mse for r in families.grid_losses(y, parts, features, settings, 2, 1).collect()}
    monkeypatch.setattr(families, "ABREAST", 1)
    assert found == {r["name"]: r.mse for r in families.grid_losses(y, parts, lambda scores: f, settings, 2, 1).collect()} and len(found) == 2


def test_links_are_listed_once(spark, monkeypatch):
    """Of each pair of proteins there is one link, and a grid's inputs join and sum the counts once."""
    from deltaloom.plans import registry

    if not Path(SF).exists():
        pytest.skip("no tables")
    made, cells = [], registry.star.cells
    monkeypatch.setattr(registry.star, "cells", lambda *a: (made.append(a), cells(*a))[1])
    registry._maker_inputs(spark, SF)
    assert len(made) == 1
    _, links, _ = registry._graph(spark, SF)
    assert links.count() == links.where("protein1 < protein2").count() > 0
