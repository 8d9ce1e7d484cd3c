"""Choice of a generator: candidates scored on calibration cells over seeds, then frozen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.generate import Profiles, calibrations, generated_moments, transport_generate
from deltaloom.operators.metrics import distribution_distance
from deltaloom.session import materialize

LEGACY = "legacy"


def seed_problems(rows: DataFrame) -> DataFrame:
    """(candidate, seed, score): candidates whose seeds differ from the others', repeat, or whose scores aren't finite."""
    own = rows.groupBy("candidate").agg(
        F.sort_array(F.collect_list("seed")).alias("seeds"), F.count(F.when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), 1)).alias("bad"), F.countDistinct("seed").alias("distinct")
    )
    usual = own.agg(F.min("seeds").alias("usual"))
    return own.join(usual, how="cross").where((F.col("seeds") != F.col("usual")) | (F.col("bad") > 0) | (F.size("seeds") != F.col("distinct"))).select("candidate", "seeds")


def select_candidate(rows: DataFrame, legacy: str = LEGACY) -> DataFrame:
    """The smallest mean score over seeds; ties go to the legacy candidate, then by name."""
    mean = rows.groupBy("candidate").agg(F.avg("score").alias("score"))
    return mean.orderBy("score", F.col("candidate") != legacy, "candidate").limit(1)


def candidates(profiles: Profiles, donors: DataFrame, iterations: tuple[int, ...], seed: int) -> dict[str, DataFrame]:
    """Deltas (target, gene, d) of generators of control cells: unmoved, and calibrated by so many iterations, which are one way with stops."""
    zero = profiles.axis.select(F.lit("control").alias("target"), "gene", F.lit(0.0).alias("d"))
    moved = calibrations(profiles, donors, zero, tuple(n for n in iterations if n), seed) if any(iterations) else {}
    return {f"mean_calibrated_{n}" if n else LEGACY: moved[n].offsets if n else zero for n in iterations}


def evaluate_candidates(profiles: Profiles, donors_of: Callable[[int], DataFrame], deltas: dict[str, DataFrame], reference: DataFrame, seeds: list[int]) -> DataFrame:
    """candidate, seed, mean_log_rmse, variance_log_rmse, dropout_mae of each candidate's generated cells against reference moments.

    donors_of(seed): the donors (draw, cell) of an evaluation, the same for all candidates.
    """
    out = None
    for seed in seeds:
        donors = materialize(donors_of(seed), "donors")
        for name, delta in deltas.items():
            moments = generated_moments(transport_generate(profiles, donors, delta, seed), profiles)
            row = distribution_distance(moments, reference).select(F.lit(name).alias("candidate"), F.lit(seed).alias("seed"), "mean_log_rmse", "variance_log_rmse", "dropout_mae")
            out = row if out is None else out.unionByName(row)
    return out
