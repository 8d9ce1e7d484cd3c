"""Error metrics of predictions, by cohort, and distances between distributions of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions.expr import log_norm
from deltaloom.session import small

#: Product of norms below which a correlation is undefined.
UNDEFINED = 1e-15


def target_errors(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """observed (target, gene, y), predicted (model, target, gene, p) to sums of errors and the correlation by model and target."""
    own = Window.partitionBy("model", "target")
    both = predicted.join(observed, ["target", "gene"])
    both = both.withColumn("dy", F.col("y") - F.avg("y").over(own)).withColumn("dp", F.col("p") - F.avg("p").over(own)).withColumn("e", F.col("p") - F.col("y"))
    norms = F.sqrt(F.sum(F.col("dy") * F.col("dy"))) * F.sqrt(F.sum(F.col("dp") * F.col("dp")))
    sums = both.groupBy("model", "target").agg(
        F.sum(F.col("e") * F.col("e")).alias("sse"), F.sum(F.abs("e")).alias("sae"), F.count("*").alias("n"), F.sum(F.col("dy") * F.col("dp")).alias("co"), norms.alias("norms")
    )
    return sums.select("model", "target", "sse", "sae", "n", F.when(F.col("norms") > UNDEFINED, F.try_divide("co", "norms")).alias("pearson"))


def cohort_metrics(errors: DataFrame, cohorts: DataFrame, reference: str = "zero_delta") -> DataFrame:
    """Metrics by model for each cohort and for all targets, and the error relative to that of the reference model."""
    joined = errors.join(cohorts, "target")
    sums = joined.groupingSets([["model", "cohort"], ["model"]], "model", "cohort").agg(
        F.sum("sse").alias("sse"), F.sum("sae").alias("sae"), F.sum("n").alias("n"), F.avg("pearson").alias("mean_target_pearson"),
        F.count("pearson").alias("pearson_defined_targets"), F.count("*").alias("n_targets"), F.max("n").alias("n_output_genes"), F.grouping("cohort").alias("whole"),
    )
    cohort = F.when(F.col("whole") == 1, "all").otherwise(F.col("cohort"))
    rows = sums.select(
        "model", cohort.alias("cohort"), (F.col("sse") / F.col("n")).alias("mse"), (F.col("sae") / F.col("n")).alias("mae"), "mean_target_pearson", "pearson_defined_targets", "n_targets", "n_output_genes"
    )
    base = F.max(F.when(F.col("model") == reference, F.col("mse"))).over(Window.partitionBy("cohort"))
    return rows.withColumn("mse_relative_to_zero", F.try_divide(F.col("mse"), base))


def with_zeros(mean: Column, variance: Column, k: Column, n: Column) -> tuple[Column, Column]:
    """Mean and sample variance of n values of which k have a mean and a population variance, and all others are 0.

    Sums of squared deviations of both parts and the square of the difference of their means are added, nothing
    is subtracted. variance: var_pop(), whose partial states Spark merges in the same way.
    """
    squares = k * variance + mean * mean * k * (n - k) / n
    return mean * k / n, F.try_divide(squares, n - 1)


def moments(counts: DataFrame, cells: DataFrame, genes: DataFrame, *by: str) -> DataFrame:
    """Mean and variance of normalised counts and the share of zeros by gene; cells without a count are zeros."""
    n = cells.groupBy(*by).agg(F.count("*").alias("n_cells"))
    x = log_norm("cnt", "lib")
    sums = counts.groupBy(*by, "gene").agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.count(x).alias("rows"), F.count(F.when(F.col("cnt") > 0, 1)).alias("k"))
    grid = n.join(genes, list(by)) if by and set(by) <= set(genes.columns) else n.join(small(genes.select("gene").distinct()), how="cross")
    grid = grid.join(sums, [*by, "gene"], "left").fillna(0.0, ["m", "v"]).fillna(0, ["rows", "k"])
    mean, variance = with_zeros(F.col("m"), F.col("v"), F.col("rows"), F.col("n_cells"))
    # of a single cell there is no variance; it counts as 0
    return grid.select(*by, "gene", mean.alias("mean"), F.greatest(variance, F.lit(0.0)).alias("variance"), (1 - F.col("k") / F.col("n_cells")).alias("dropout"))


def distribution_distance(found: DataFrame, reference: DataFrame, *by: str) -> DataFrame:
    """Distances of two tables of moments over genes: of means, variances, and shares of zeros."""
    r = reference.select("gene", F.col("mean").alias("mean_r"), F.col("variance").alias("variance_r"), F.col("dropout").alias("dropout_r"))
    both = found.join(r, "gene")
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col(f"{c}_r")) * (F.col(c) - F.col(f"{c}_r"))))
    return both.groupBy(*by).agg(rmse("mean").alias("mean_log_rmse"), rmse("variance").alias("variance_log_rmse"), F.avg(F.abs(F.col("dropout") - F.col("dropout_r"))).alias("dropout_mae"))
