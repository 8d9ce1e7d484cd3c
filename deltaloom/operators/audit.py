"""Audit of cell identities against a count matrix, from metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions.expr import last_part


def eligible(identities: DataFrame, matrix: DataFrame) -> DataFrame:
    """(barcode, guide, coverage, cells): good coverage, one cell, a barcode given once, and in the matrix."""
    n = F.count("*").over(Window.partitionBy("barcode"))
    good = (F.upper("coverage") == "TRUE") & (F.col("cells").cast("double") == 1) & (F.col("n") == 1)
    return identities.withColumn("n", n).where(good).drop("n").join(matrix.select("barcode").distinct(), "barcode", "left_semi")


def unmatched(identities: DataFrame, matrix: DataFrame) -> DataFrame:
    """Barcodes on one side only."""
    a, b = identities.select("barcode").distinct(), matrix.select("barcode").distinct()
    return a.join(b, "barcode", "left_anti").withColumn("side", F.lit("identity")).union(b.join(a, "barcode", "left_anti").withColumn("side", F.lit("matrix")))


def guide_counts(identities: DataFrame) -> DataFrame:
    """Cells by the barcode's batch suffix and guide."""
    return identities.groupBy(last_part("barcode", "-").alias("gem"), "guide").agg(F.count("*").alias("n"))


def nested(counts: DataFrame) -> DataFrame:
    """One row for each gem with a map of guides to cells."""
    return counts.groupBy("gem").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("guide", "n")))).alias("guides"))


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def distinct_counts(identities: DataFrame) -> DataFrame:
    return identities.agg(F.countDistinct("barcode").alias("n_barcodes"), F.countDistinct("guide").alias("n_guides"), F.count("*").alias("n_rows"))
