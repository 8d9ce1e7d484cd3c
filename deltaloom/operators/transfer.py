"""Transfer of responses from a training line to a held-out one: baselines and one-feature ridge.

Everything fitted (imputer, scaler, coefficients, penalty) sees training rows
of its fold only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions.expr import standardized
from deltaloom.session import materialize, small


def zero_delta(targets: DataFrame, genes: DataFrame) -> DataFrame:
    return targets.select("target").join(small(genes.select("gene")), how="cross").select(F.lit("zero_delta").alias("model"), "target", "gene", F.lit(0.0).alias("p"))


def training_mean(train: DataFrame, targets: DataFrame) -> DataFrame:
    """train (target, gene, y): the mean of each gene, for every target."""
    mean = train.groupBy("gene").agg(F.avg("y").alias("p"))
    return targets.select("target").join(small(mean), how="cross").select(F.lit("training_mean").alias("model"), "target", "gene", "p")


def nearest_line(train: DataFrame, targets: DataFrame) -> DataFrame:
    """The same target's response in training, or the training mean."""
    mean = training_mean(train, targets)
    same = train.select("target", "gene", "y")
    return mean.join(same, ["target", "gene"], "left").select(F.lit("nearest_line").alias("model"), "target", "gene", F.coalesce("y", "p").alias("p"))


def basal(targets: DataFrame, baseline: DataFrame) -> DataFrame:
    """target, x: what controls express of the target's own gene; null if the panel lacks it."""
    own = baseline.select(F.col("gene").alias("target"), F.col("mean_log").alias("x"))
    return targets.select("target").distinct().join(own, "target", "left")


def fit_scale(x: DataFrame, *by: str) -> DataFrame:
    """median (0 if there are no values), mean and scale (1 if 0) of x with missing values at the median."""
    x = x.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    median = x.groupBy(*by).agg(F.coalesce(F.median("x"), F.lit(0.0)).alias("median"))
    filled = x.join(F.broadcast(median), list(by)) if by else x.join(F.broadcast(median), how="cross")
    filled = filled.withColumn("v", F.coalesce("x", "median"))
    scale = F.coalesce(F.nullif(F.stddev_pop("v"), F.lit(0.0)), F.lit(1.0))
    return filled.groupBy(*by, "median").agg(F.avg("v").alias("mean"), scale.alias("scale"))


def apply_scale(x: DataFrame, fitted: DataFrame, *by: str) -> DataFrame:
    joined = x.join(F.broadcast(fitted), list(by)) if by else x.join(F.broadcast(fitted), how="cross")
    return joined.withColumn("z", standardized("x", "median", "mean", "scale")).drop("median", "mean", "scale")


def ridge_fit(z: DataFrame, y: DataFrame, alpha: float) -> DataFrame:
    """gene, b0, b1: closed form for a standardised feature; the intercept isn't penalised."""
    if alpha < 0:
        raise ValueError("the penalty is negative")
    both = y.join(z.select("target", "z"), "target")
    slope = F.try_divide(F.sum(F.col("z") * F.col("y")), F.sum(F.col("z") * F.col("z")) + F.lit(float(alpha)))  # 0 for a constant feature without a penalty
    return both.groupBy("gene").agg(F.avg("y").alias("b0"), F.coalesce(slope, F.lit(0.0)).alias("b1"))


def ridge_predict(z: DataFrame, model: DataFrame, name: str = "ridge") -> DataFrame:
    return z.select("target", "z").join(small(model), how="cross").select(F.lit(name).alias("model"), "target", "gene", (F.col("b0") + F.col("z") * F.col("b1")).alias("p"))


def folds(targets: DataFrame, k: int, seed: int) -> DataFrame:
    """target, fold: k parts by the order of a hash, the first ones larger."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("target").cast("string")), 256)
    return targets.select("target").distinct().withColumn("fold", F.ntile(k).over(Window.orderBy(order)) - 1)


def require_folds(k: int, n_targets: int) -> None:
    if not 2 <= k <= n_targets:
        raise ValueError(f"{k} folds of {n_targets} targets")


def require_observed(x: DataFrame, y: DataFrame) -> None:
    """(target, x) has a value somewhere, and all of (target, gene, y) are finite."""
    seen = x.agg(F.count(F.nanvl("x", F.lit(None).cast("double")))).head()[0]
    if not seen or not y.where(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))).isEmpty():
        raise ValueError("no observed feature, or responses that aren't finite")


def alpha_losses(x: DataFrame, y: DataFrame, parts: DataFrame, alphas: list[float]) -> DataFrame:
    """alpha, mse over held-out folds, every fold with its own imputer and scaler; one plan for all folds and penalties.

    Sums by gene and fold of the responses, less the gene's mean, and of these times the feature
    as each fold's models scale it give the sums of every fold's complement by
    subtraction, and so all models. Errors are then taken response by response: squares of large numbers are never subtracted.
    """
    if any(a < 0 for a in alphas):
        raise ValueError("a penalty is negative")
    parts = materialize(parts, "folds")
    ids = sorted({r[0] for r in parts.select("fold").distinct().collect()})
    out = F.explode(F.array(*(F.lit(i).cast("int") for i in ids))).alias("out")
    rows = x.join(parts, "target").select("target", "x", "fold", out)
    z = apply_scale(rows, fit_scale(rows.where("fold <> out"), "out"), "out")
    own = materialize(z.groupBy("target", "fold").agg(F.sort_array(F.collect_list(F.struct("out", "z"))).alias("z")).select("target", "fold", F.col("z.z").alias("z")), "scaled")
    means = materialize(y.groupBy("gene").agg(F.avg("y").alias("c")), "means")
    data = y.join(small(own), "target").join(small(means), "gene").withColumn("y", F.col("y") - F.col("c"))
    sums = [F.count("*").alias("n"), F.sum("y").alias("y"), F.max("c").alias("c")]
    for i in range(len(ids)):
        z = F.col("z")[i]
        sums += [F.sum(z).alias(f"z{i}"), F.sum(z * F.col("y")).alias(f"zy{i}"), F.sum(z * z).alias(f"zz{i}")]
    by_fold = materialize(data.groupBy("gene", "fold").agg(*sums), "fold_sums")
    added = [c for c in by_fold.columns if c not in ("gene", "fold", "c")]
    whole = by_fold.groupBy("gene").agg(*(F.sum(c).alias(f"all_{c}") for c in added))
    both = by_fold.join(whole, "gene")
    # in the fold left out, which is i: sums of all others
    per = [F.struct(*((F.col(f"all_{c}") - F.col(c)).alias(f"t{c}") for c in ("n", "y")), *((F.col(f"all_{c}{i}") - F.col(f"{c}{i}")).alias(f"t{c}") for c in ("z", "zy", "zz"))) for i in range(len(ids))]
    place = F.array_position(F.array(*(F.lit(i).cast("int") for i in ids)), F.col("fold").cast("int")).cast("int")
    s = both.select("gene", "fold", "c", F.element_at(F.array(*per), place).alias("s")).select("gene", "fold", "c", "s.*")
    # the slope of a feature whose sum isn't quite 0 also sees the mean that was taken off
    slope = lambda a: F.coalesce(F.try_divide(F.col("tzy") + F.col("c") * F.col("tz"), F.col("tzz") + F.lit(float(a))), F.lit(0.0))
    models = s.select("gene", "fold", F.try_divide("ty", "tn").alias("b0"), F.array(*(slope(a) for a in alphas)).alias("b1"))
    models = materialize(models, "models")
    e = data.join(small(models), ["gene", "fold"]).withColumn("e", F.col("y") - F.col("b0")).withColumn("own", F.element_at("z", place))
    off = lambda k: F.col("e") - F.col("b1")[k] * F.col("own")
    found = e.agg(F.count("*").alias("n"), *(F.sum(off(k) * off(k)).alias(f"e{k}") for k in range(len(alphas))))
    rows = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), (F.col(f"e{k}") / F.col("n")).alias("mse")) for k, a in enumerate(alphas)))
    return found.select(F.inline(rows))


def best_alpha(losses: DataFrame) -> DataFrame:
    """The smallest loss; of equal ones the larger penalty."""
    return losses.orderBy("mse", F.col("alpha").desc()).limit(1)


def best_per_family(losses: DataFrame) -> DataFrame:
    """(family, name, mse): the best setting of each, ties by name, with its place overall."""
    own = Window.partitionBy("family").orderBy("mse", "name")
    best = losses.withColumn("rank", F.row_number().over(own)).where("rank = 1").drop("rank")
    return best.withColumn("place", F.row_number().over(Window.orderBy("mse", "name")))


def matrix_problems(long: DataFrame, targets: DataFrame, genes: DataFrame) -> DataFrame:
    """What keeps a long table from being a matrix on two axes: repeated pairs and missing ones."""
    own = long.join(small(targets.select("target")), "target", "left_semi").join(small(genes.select("gene")), "gene", "left_semi")
    n = own.groupBy("target", "gene").agg(F.count("*").alias("n"))
    grid = targets.select("target").join(small(genes.select("gene")), how="cross").join(n, ["target", "gene"], "left")
    return grid.select("target", "gene", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")
