"""Queries against their SQL: on the smallest tables, and the mix on rows made to be awkward."""

from pathlib import Path

import duckdb
import pytest

from deltaloom.llm import registry

SF = "/root/testdata/sf0.001"


def same(spark, root, name, tables):
    con = duckdb.connect()
    for t in tables:
        path = Path(root) / f"{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    want = con.sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    found = registry.QUERIES[name](spark, str(root))
    assert sorted(found.columns) == columns
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
    assert order(tuple(r[c] for c in columns) for r in found.collect()) == order(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    if not Path(SF).exists():
        pytest.skip("no tables")
    same(spark, SF, name, ("documents", "embeddings", "conversations", "labels"))


@pytest.mark.parametrize("n", [0, 1, 400])
def test_mix_of_awkward_rows(spark, tmp_path, n):
    source = ["a", "B", "é", None, "a"]
    rows = [(i - 7, " ".join(["w"] * (i * 11 % 29)), source[i % 5]) for i in range(n)]
    rows += [(5, "w w", "a"), (5, "w w", "a"), (5, "w w w", "a"), (None, "x y", "a"), (None, None, None), (900, "", "none"), (901, "x\x0by\tz q r", "ü")][: 7 * bool(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2 if i % 7 else None) for i in range(0, n, 3)] + [(3, 0), (3, 1)][: 2 * bool(n)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    same(spark, tmp_path, "op4_mixing", ("documents", "labels"))
