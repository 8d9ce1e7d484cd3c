import numpy as np
import pytest

from deltaloom.sources import blocks


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    rows = [(int(3 * c), f"g{g:02}", int(rng.integers(1, 9))) for c in range(300) if c % 7 for g in rng.choice(40, rng.integers(1, 12), replace=False)]
    counts = spark.createDataFrame([*rows, (10_000, "g00", 5)], "cell long, gene string, cnt long").repartition(5)
    cells = spark.createDataFrame([(3 * c,) for c in range(300)] + [(3,)], "cell long")
    path = str(tmp_path_factory.mktemp("store") / "s")
    blocks.write_blocks(counts, cells, path, 16, 4)
    return path, rows


def test_points(spark, store):
    path, rows = store
    for some in ([0, 3, 9, 51, 888], list(range(0, 900, 3)), [1, 2], []):
        wanted = spark.createDataFrame([(c,) for c in [*some, *some[:1]]], "cell long")
        got = blocks.read_cells(spark, path, wanted)
        assert sorted((r.cell, r.gene, r.cnt) for r in got.collect()) == sorted(r for r in rows if r[0] in some)
        assert all(r.cell_idx * 3 == r.cell for r in got.collect())
    genes = spark.createDataFrame([("g03",), ("g07",), ("none",)], "gene string")
    got = blocks.read_cells(spark, path, spark.createDataFrame([(3,), (9,), (15,)], "cell long"), genes)
    assert sorted((r.cell, r.gene, r.cnt) for r in got.collect()) == sorted(r for r in rows if r[0] in (3, 9, 15) and r[1] in ("g03", "g07"))


def test_only_wanted_folders_are_read(spark, store):
    path, _ = store
    got = blocks.read_cells(spark, path, spark.createDataFrame([(51,)], "cell long"))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters" in plan
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() == 5


def test_offsets(spark, store):
    path, rows = store
    n = [sum(r[0] == 3 * c for r in rows) for c in range(300)]
    got = [(r.cell_idx, r.nnz, r.begin) for r in blocks.offsets(spark, path).orderBy("cell_idx").collect()]
    assert got == list(zip(range(300), n, np.concatenate([[0], np.cumsum(n)[:-1]]).tolist(), strict=True))
    assert all(len(r.offsets) == 17 or r.block == 18 for r in spark.read.parquet(f"{path}/blocks").collect())
