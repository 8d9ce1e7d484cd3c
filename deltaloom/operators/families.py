"""Model families on a low-rank basis: fitted per fold on training rows only, compared by cross-validated loss."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators import boosted, graph, lowrank
from deltaloom.operators.transfer import best_per_family
from deltaloom.session import materialize, small

#: Folds whose jobs run side by side.
ABREAST = 5


@dataclass(frozen=True)
class Setting:
    """One point of the grid. family "ridge" uses alpha; "trees" uses leaves; features are column names, PRIORS standing for one of each component.

    bins: 0 for trees that look at every value, a component a task, or so many bins for trees by histograms over all tasks.
    """

    family: str
    name: str
    features: tuple[str, ...]
    alpha: float = 1.0
    leaves: int = 7
    rounds: int = 60
    rate: float = 0.05
    least: int = 40
    bins: int = 0


MEAN, PRIORS = "training_mean", "prior*"
BASAL, GRAPH = ("basal", "is_missing"), ("basal", "is_missing", "log_support", PRIORS)


def grid(alphas: tuple[float, ...], leaves: tuple[int, ...], rounds: int = 60, rate: float = 0.05, least: int = 40) -> list[Setting]:
    """Ridge on basal and on graph features by penalty, trees on graph features by leaves."""
    ridge = [Setting(f"ridge_{kind}", f"ridge_{kind}_{a:g}", names, a) for kind, names in (("basal", BASAL), ("graph", GRAPH)) for a in alphas]
    return ridge + [Setting("trees", f"trees_{n}", GRAPH, leaves=n, rounds=rounds, rate=rate, least=least) for n in leaves]


#: Makes features (target, ...) from scores (target, component, z) of reference targets.
Maker = Callable[[DataFrame], DataFrame]


def feature_maker(edges: DataFrame, x: DataFrame) -> Maker:
    """A function of reference targets' scores on a basis that makes features of the targets in x (target, x).

    A target's priors are the weighted means of its neighbours' scores, a component each; itself is left out.
    """

    def make(scores: DataFrame) -> DataFrame:
        own = scores.select(F.col("target").alias("gene"), "component", "z")
        f = graph.neighbour_vectors(edges, x.select(F.col("target").alias("gene"), "x"), own)
        return materialize(f.withColumn("is_missing", F.col("is_missing").cast("double")).withColumnRenamed("gene", "target"), "features")

    return make


def columns_of(names: tuple[str, ...], features: DataFrame) -> list[str]:
    """The columns of features that names stand for."""
    priors = sorted((c for c in features.columns if c.startswith(PRIORS[:-1])), key=lambda c: int(c[len(PRIORS) - 1 :]))
    return [c for n in names for c in (priors if n == PRIORS else [n])]


def scaling(own: DataFrame, names: list[str]) -> dict[str, dict[str, float]]:
    """Median, mean and scale of each feature over own's rows, missing values at the median."""
    known = {n: F.nanvl(n, F.lit(None).cast("double")) for n in names}
    medians = own.agg(*(F.coalesce(F.median(c), F.lit(0.0)).alias(n) for n, c in known.items())).head()
    filled = {n: F.coalesce(c, F.lit(float(medians[n]))) for n, c in known.items()}
    stats = own.agg(*(f(filled[n]).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop)))).head()
    return {n: {"median": float(medians[n]), "mean": float(stats[f"m_{n}"] or 0.0), "scale": float(stats[f"s_{n}"] or 1.0)} for n in names}


def scaled(state: dict[str, dict[str, float]]) -> list[Column]:
    """The features as columns, scaled."""
    filled = {n: F.coalesce(F.nanvl(n, F.lit(None).cast("double")), F.lit(s["median"])) for n, s in state.items()}
    return [((filled[n] - F.lit(s["mean"])) / F.lit(s["scale"])).alias(n) for n, s in state.items()]


def predicted_scores(scores: DataFrame, features: DataFrame, asked: DataFrame, settings: list[Setting], known: dict | None = None) -> DataFrame:
    """name, target, component, z of the query targets by each setting, from training scores (target, component, z).

    features are those of training targets, asked those of the queries, made
    without the queries' labels; a target may be in both, with another line's values.
    Settings of the same features share their sums. known: takes what was fitted, by name.
    """
    out, sides = None, {}
    for s in settings:
        names = columns_of(s.features, features)
        if s.features not in sides:
            state = scaling(features, names)
            own, queries = (materialize(x.select("target", *scaled(state)), "standardized") for x in (features, asked))
            sides[s.features] = own, queries, lowrank.ridge_sums(own, scores, names), state
        own, queries, sums, state = sides[s.features]
        if s.family == "trees":
            size = (s.leaves, s.rounds, s.rate, s.least)
            model = boosted.trees_fit(own, scores, names, *size, s.bins) if s.bins else lowrank.trees_fit(own, scores, names, *size)
            model = materialize(model, "trees")
            z = lowrank.trees_predict(model, queries, names)
        else:
            model = lowrank.ridge_solve(sums, s.alpha)
            z = lowrank.ridge_predict(queries, names, model)
        if known is not None:
            known[s.name] = model
            known.setdefault("scaling", {})[s.name] = state
        row = z.select(F.lit(s.name).alias("name"), "target", "component", "z")
        out = row if out is None else out.unionByName(row)
    return out


def predict(y: DataFrame, features_of: Maker, asked_of: Maker, settings: list[Setting], rank: int, seed: int, known: dict | None = None) -> dict[str, DataFrame]:
    """Predictions (target, gene, p) for the targets of asked_of by each setting, from training responses y (target, gene, y).

    Both makers get the training targets' scores and nothing of the queries' own responses.
    """
    mean, basis = lowrank.response_basis(y, rank, seed)
    scores = materialize(lowrank.project(y, mean, basis), "scores")
    if known is not None:
        known["mean"], known["basis"], known["scores"] = mean, basis, scores
    z = materialize(predicted_scores(scores, features_of(scores), asked_of(scores), settings, known), "predicted")
    return {s.name: lowrank.reconstruct(z.where(F.col("name") == s.name).drop("name"), mean, basis) for s in settings}


def grid_losses(y: DataFrame, parts: DataFrame, features_of: Maker, settings: list[Setting], rank: int, seed: int) -> DataFrame:
    """family, name, mse over the folds in parts (target, fold).

    features_of makes the features of all targets from the scores of a
    fold's training targets, so that no held-out response is seen. As the basis is
    orthonormal, the squared error of a prediction V z against e is that of V s, s being the scores of e, and
    that of z against s: no prediction is spelt out, and nothing large is subtracted.
    The training mean is compared too, as a family of its own. Folds don't need one another, and their many jobs are
    too small for all cores: ABREAST of them go side by side.
    """

    def of_fold(k: int) -> DataFrame:
        held = materialize(parts.where(F.col("fold") == k).select("target"), "held")
        train = y.join(small(held), "target", "left_anti")
        mean, basis = lowrank.response_basis(train, rank, seed)
        scores = materialize(lowrank.project(y, mean, basis), "scores")
        asked = scores.join(small(held), "target", "left_semi").select("target", "component", F.col("z").alias("s"))
        near = lowrank.reconstruct(asked.withColumnRenamed("s", "z"), mean, basis)
        e = F.col("y") - F.col("p")
        size = y.join(near, ["target", "gene"]).agg(F.coalesce(F.sum(e * e), F.lit(0.0)).alias("whole"), F.count("*").alias("n"))
        reference = materialize(scores.join(small(held), "target", "left_anti"), "reference")
        features = features_of(reference)
        own, asked_features = (features.join(small(held), "target", how) for how in ("left_anti", "left_semi"))
        z = predicted_scores(reference, own, asked_features, settings)
        off = z.join(asked, ["target", "component"]).groupBy("name").agg(F.sum((F.col("z") - F.col("s")) * (F.col("z") - F.col("s"))).alias("off"))
        off = off.unionByName(asked.select(F.lit(MEAN).alias("name"), "s").groupBy("name").agg(F.sum(F.col("s") * F.col("s")).alias("off")))  # the training mean is z = 0
        return materialize(off.join(size, how="cross").select("name", (F.col("whole") + F.col("off")).alias("sse"), "n"), "losses")

    folds = [k for (k,) in parts.select("fold").distinct().orderBy("fold").collect()]
    with ThreadPoolExecutor(ABREAST) as pool:  # a thread for each fold only waits for its jobs
        started = [pool.submit(inheritable_thread_target(y.sparkSession)(of_fold), k) for k in folds]
        out = reduce(DataFrame.unionByName, [f.result() for f in started])
    family = F.create_map(*(F.lit(v) for s in [Setting(MEAN, MEAN, ()), *settings] for v in (s.name, s.family)))
    return out.groupBy("name").agg((F.sum("sse") / F.sum("n")).alias("mse")).select(family[F.col("name")].alias("family"), "name", "mse")


def choose(losses: DataFrame) -> dict:
    """Best setting of each family, and of all."""
    rows = best_per_family(losses).orderBy("place").collect()
    return {"winner": rows[0]["name"], "best": {r["family"]: r["name"] for r in rows}, "mse": {r["name"]: r["mse"] for r in rows}}
