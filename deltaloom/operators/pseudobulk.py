"""Matched-control aggregation of counts.

Zeros count: means divide by cells. Counts are normalised by the library of the
cell, then averaged. Each target's controls are those of its batches, weighted
by its cells there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.expr import log_norm
from deltaloom.session import materialize

STRATUM = ("line", "target", "batch")


def group_sums(counts: DataFrame) -> DataFrame:
    """Sums of counts and of normalised counts by line, target, batch, gene; controls are one more target."""
    return counts.groupBy(*STRATUM, "gene").agg(F.sum("cnt").alias("s_raw"), F.sum(log_norm("cnt", "lib")).alias("s_log"))


def strata(cells: DataFrame) -> DataFrame:
    """Cells by line, target, batch."""
    return cells.groupBy(*STRATUM).agg(F.count("*").alias("n"))


def panel(counts: DataFrame) -> DataFrame:
    """Genes of each line."""
    return counts.select("line", "gene").distinct()


def control_means(stats: DataFrame, groups: DataFrame, genes: DataFrame, control: str | int) -> DataFrame:
    """Means of control cells by line, batch, gene, complete with zeros."""
    n = groups.where(F.col("target") == control).select("line", "batch", F.col("n").alias("n_control"))
    sums = stats.where(F.col("target") == control).drop("target")
    grid = n.join(genes, "line").join(sums, ["line", "batch", "gene"], "left")
    mean = lambda c: (F.coalesce(c, F.lit(0.0)) / F.col("n_control"))
    return grid.select("line", "batch", "gene", "n_control", mean("s_raw").alias("m_raw"), mean("s_log").alias("m_log"))


def matched_controls(groups: DataFrame, means: DataFrame, control: str | int) -> DataFrame:
    """Control means by line, target, gene: those of each batch, weighted by the target's cells in it."""
    n = F.sum("n")
    weighted = lambda c: F.sum(F.col("n") * F.col(c)) / n
    return groups.where(F.col("target") != control).join(means, ["line", "batch"]).groupBy("line", "target", "gene").agg(weighted("m_raw").alias("c_raw"), weighted("m_log").alias("c_log"))


def target_means(stats: DataFrame, groups: DataFrame, genes: DataFrame) -> DataFrame:
    """Means by line, target, gene, complete with zeros, with the number of cells."""
    n = groups.groupBy("line", "target").agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_batches"))
    sums = stats.groupBy("line", "target", "gene").agg(F.sum("s_raw").alias("s_raw"), F.sum("s_log").alias("s_log"))
    grid = n.join(genes, "line").join(sums, ["line", "target", "gene"], "left")
    mean = lambda c: (F.coalesce(c, F.lit(0.0)) / F.col("n_cells"))
    return grid.select("line", "target", "gene", "n_cells", "n_batches", mean("s_raw").alias("mean_raw"), mean("s_log").alias("mean_log"))


def guide_support(cells: DataFrame) -> DataFrame:
    return cells.groupBy("line", "target").agg(F.countDistinct("guide").alias("n_guides"))


def rows_of(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Every count, and every cell once more without a gene, which carries its guide."""
    none = F.lit(None)
    own = cells.select(*STRATUM, none.cast(dict(counts.dtypes)["gene"]).alias("gene"), none.cast("double").alias("cnt"), "lib", "guide")
    return counts.select(*STRATUM, "gene", F.col("cnt").cast("double").alias("cnt"), "lib", none.cast("string").alias("guide")).unionByName(own)


def sufficient(rows: DataFrame) -> DataFrame:
    """All that means, supports and panels are made of, by one aggregate over rows_of(); small next to the counts."""
    return rows.groupBy(*STRATUM, "gene", "guide").agg(F.sum("cnt").alias("s_raw"), F.sum(log_norm("cnt", "lib")).alias("s_log"), F.count("*").alias("n"))


def parts_of(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """group_sums(), strata(), panel() and guide_support() from sufficient()."""
    stats = table.where("gene is not null").select(*STRATUM, "gene", "s_raw", "s_log")
    marks = table.where("gene is null")
    groups = marks.groupBy(*STRATUM).agg(F.sum("n").alias("n"))
    return stats, groups, panel(stats), guide_support(marks)


def matched_delta_of(table: DataFrame, control: int | str) -> DataFrame:
    """line, target, gene: means of the target, of its matched controls, their differences and support."""
    stats, groups, genes, guides = parts_of(table)
    means = target_means(stats, groups, genes).where(F.col("target") != control)
    matched = matched_controls(groups, control_means(stats, groups, genes, control), control)
    out = means.join(matched, ["line", "target", "gene"]).join(guides, ["line", "target"])
    return out.select(
        "line", "target", "gene", "mean_raw", "c_raw", (F.col("mean_raw") - F.col("c_raw")).alias("delta_raw"),
        "mean_log", "c_log", (F.col("mean_log") - F.col("c_log")).alias("delta_log"), "n_cells", "n_guides", "n_batches",
    )


def matched_delta(counts: DataFrame, cells: DataFrame, control: int | str) -> DataFrame:
    """matched_delta_of() from counts and cells; the table in between is written, so that the counts are read once."""
    return matched_delta_of(materialize(sufficient(rows_of(counts, cells)), "sums"), control)


def control_baseline(stats: DataFrame, groups: DataFrame, genes: DataFrame, control: str | int) -> DataFrame:
    """Means over all control cells of a line: batch means weighted by control cells."""
    means = control_means(stats, groups, genes, control)
    n = F.sum("n_control")
    pooled = lambda c: F.sum(F.col("n_control") * F.col(c)) / n
    return means.groupBy("line", "gene").agg(pooled("m_raw").alias("mean_raw"), pooled("m_log").alias("mean_log"))


def matched_strata(groups: DataFrame, control: str | int) -> DataFrame:
    """Cells of each target and of controls, by batch."""
    own = groups.where(F.col("target") == control).select("line", "batch", F.col("n").alias("n_control_cells"))
    return groups.where(F.col("target") != control).join(own, ["line", "batch"], "left").select("line", "target", "batch", F.col("n").alias("n_target_cells"), F.coalesce("n_control_cells", F.lit(0)).alias("n_control_cells"))


def quality_report(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Per line: cells, libraries, and the share of the library that the panel keeps."""
    sums = counts.groupBy("line", "cell").agg(F.sum("cnt").alias("panel"), F.min("cnt").alias("lo"), F.max("cnt").alias("hi"), F.bool_and(F.col("cnt") == F.floor("cnt")).alias("whole"))
    both = cells.join(sums, ["line", "cell"], "left").withColumn("panel", F.coalesce("panel", F.lit(0.0)))
    return both.groupBy("line").agg(
        F.count("*").alias("n_cells"), F.min("lib").alias("min_library"), F.max("lib").alias("max_library"), F.sum("panel").alias("panel_total"),
        F.min("lo").alias("min_count"), F.max("hi").alias("max_count"), F.bool_and(F.coalesce("whole", F.lit(True))).alias("whole"),
        F.min(F.col("panel") / F.col("lib")).alias("min_retained"), F.bool_and(F.col("panel") <= F.col("lib")).alias("within_library"),
    )
