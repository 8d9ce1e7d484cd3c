"""Cohorts of targets and axes of genes, from metadata only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions.expr import is_missing, target_id


def cohorts(targets: DataFrame, train: str, held: str) -> DataFrame:
    """(line, target) to target, cohort: held-out targets that training has, or hasn't."""
    own, other = (targets.where(F.col("line") == x).select("target").distinct() for x in (held, train))
    shared = own.intersect(other).withColumn("cohort", F.lit("shared"))
    return shared.unionByName(own.exceptAll(other).withColumn("cohort", F.lit("unseen")))


def common_axis(genes: DataFrame, first: str, second: str) -> DataFrame:
    """(line, gene) to gene, gene_idx: genes of both lines in order, counted from 0."""
    both = genes.where(F.col("line") == first).select("gene").intersect(genes.where(F.col("line") == second).select("gene"))
    return with_index(both, "gene", "gene_idx")


def with_index(axis: DataFrame, name: str, index: str) -> DataFrame:
    """Distinct values with their place in order: an axis, small as it is."""
    return axis.select(name).distinct().withColumn(index, F.row_number().over(Window.orderBy(name)) - 1)


def unmapped(cells: DataFrame) -> DataFrame:
    """(identifier, symbol) rows without an identifier, as sentinel and cells by symbol."""
    return cells.where(is_missing("identifier")).groupBy(target_id("identifier", "symbol").alias("target_id"), "symbol").agg(F.count("*").alias("n_cells"))


def union_axis(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    return a.select(name).union(b.select(name)).distinct()


def membership(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """rows with a flag: whether some has the key."""
    flag = some.select(key).distinct().withColumn("is_member", F.lit(True))
    return rows.join(flag, key, "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))
