"""Sums and counts of cells that arrive in batches.

Sums by group are associative, so a table of sums is kept up to date by adding
those of each new batch; readers take the newest version. This is the only
incremental form that the engine's aggregates have: there are no windows over
event time or late data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators.pseudobulk import group_sums

KEYS = ["line", "target", "batch", "gene"]


def merge_sums(old: DataFrame | None, new: DataFrame) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*KEYS).agg(F.sum("s_raw").alias("s_raw"), F.sum("s_log").alias("s_log"))


def sums_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds each batch of counts to a versioned table of sums under path.

    A batch that is run again starts from the version before it, so it counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_sums(spark, path, number - 1) if number else None
        merge_sums(old, group_sums(batch)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def read_sums(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")
