"""Queries against their oracles on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from deltaloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not Path(SF).exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(records, columns):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, db, name):
    want = db.sql(registry.ORACLES[name])
    columns = want.columns
    want = [dict(zip(columns, r, strict=True)) for r in want.fetchall()]
    found = registry.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert rows([r.asDict() for r in found.collect()], columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    if not Path(SF).exists():
        pytest.skip("no tables")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
