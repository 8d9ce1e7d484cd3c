"""Numbers in the order of a key, and running sums along it, without bringing all rows to one task.

Rows are dealt out by ranges of the key and written; a count (or sum) of each range gives where
the next one begins, and inside a range numbering is local. What is brought together is one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.session import materialize, small

_RANGE = "range_of_key"


def _dealt(df: DataFrame, keys: list[str], parts: int | None) -> tuple[DataFrame, int]:
    """df written in ranges of the keys, with the number of each row's range; how many there are."""
    if _RANGE in df.columns:
        raise ValueError(f"a column is called {_RANGE}")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if parts is None else parts
    return materialize(df.repartitionByRange(n, *keys).withColumn(_RANGE, F.spark_partition_id()), "ranges"), n


def _before(ranges: DataFrame, total: Column) -> DataFrame:
    """Of each range what all ranges before it have."""
    totals = ranges.groupBy(_RANGE).agg(total.alias("total"))
    whole = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return totals.select(_RANGE, F.coalesce(F.sum("total").over(whole), F.lit(0)).alias("before"))


def by_range(df: DataFrame, keys: list[str], index: str, parts: int | None = None) -> DataFrame:
    """df with a number from 0 in the order of the keys, which must differ for all rows but equal ones."""
    ranges, n = _dealt(df, keys, parts)
    local = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*keys)) - 1
    placed = ranges.withColumn(index, local).join(small(_before(ranges, F.count("*")), n), _RANGE)
    return placed.withColumn(index, F.col(index) + F.col("before")).select(*df.columns, index)


def running(df: DataFrame, keys: list[str], value: str, before: str, parts: int | None = None) -> DataFrame:
    """df with the sum of a whole-number column over all rows before each, in the order of the keys."""
    ranges, n = _dealt(df, keys, parts)
    local = F.coalesce(F.sum(value).over(Window.partitionBy(_RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    name = f"{before}_"
    placed = ranges.withColumn(name, local).join(small(_before(ranges, F.sum(value)), n), _RANGE)
    return placed.withColumn(before, (F.col(name) + F.col("before")).cast("long")).select(*df.columns, before)
