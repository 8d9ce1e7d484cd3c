import datetime

import pytest
from pyspark.sql import functions as F

from deltaloom.plans.fingerprint import changed, fingerprint, manifest

ROWS = [(1, "a", 0.1, None, [1, None], b"x", {"k": 1, "j": 2}, datetime.date(2020, 1, 1)), (2, None, float("nan"), True, [], None, None, None), (2, None, float("nan"), True, [], None, None, None), (3, "b,1:c", -0.5, False, None, b"", {}, None)]
KINDS = "i long, s string, d double, f boolean, l array<int>, b binary, m map<string,int>, t date"


def test_order_partitions_and_columns_do_not_matter(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KINDS)
    want = fingerprint(df)
    assert want["rows"] == 4 and want == fingerprint(df.repartition(7)) == fingerprint(df.select(*reversed(df.columns)).orderBy(F.desc("i")))
    df.repartition(3).write.parquet(f"{tmp_path}/t")
    assert fingerprint(spark.read.parquet(f"{tmp_path}/t")) == want
    swapped = spark.createDataFrame([(*ROWS[0][:6], {"j": 2, "k": 1}, ROWS[0][7]), *ROWS[1:]], KINDS)
    assert fingerprint(swapped) == want


@pytest.mark.parametrize("change", [
    lambda d: d.dropDuplicates(["i"]), lambda d: d.union(d.limit(1)), lambda d: d.withColumn("s", F.coalesce("s", F.lit(""))), lambda d: d.withColumn("s", F.coalesce("s", F.lit("null"))), lambda d: d.withColumnRenamed("s", "r"),
    lambda d: d.withColumn("i", F.col("i").cast("int")), lambda d: d.withColumn("d", F.when(F.col("i") == 1, F.lit(0.1 + 1e-16 * 2)).otherwise(F.col("d"))), lambda d: d.withColumn("l", F.array_compact("l")), lambda d: d.withColumn("f", F.lit(None).cast("boolean")), lambda d: d.limit(0), lambda d: d.drop("m"),
])
def test_any_change_matters(spark, change):
    df = spark.createDataFrame(ROWS, KINDS)
    assert fingerprint(change(df)) != fingerprint(df)


def test_values_do_not_run_together(spark):
    pairs = [("a,1:b", "c"), ("a", "1:b,1:c"), ("a", None), (None, "a"), ("", "a"), ("null", "a"), ("a", "null")]
    assert len({fingerprint(spark.createDataFrame([p], "x string, y string"))["digest"] for p in pairs}) == len(pairs)


def test_manifest(spark):
    a, b = (spark.createDataFrame([(i, float(i)) for i in range(n)], "k long, v double") for n in (5, 6))
    kept = manifest(spark, {"a": a, "b": b})
    assert changed(kept, {"a": a.repartition(3), "b": b}).isEmpty()
    assert [r["name"] for r in changed(kept, {"a": b, "b": b, "c": a}).orderBy("name").collect()] == ["a", "c"]
