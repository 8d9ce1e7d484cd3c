"""Synthetic counts: multinomial nulls and transport of control profiles.

Random draws are made in Python whose generator is seeded by the seed and the
group's key, so results don't depend on partitions. Profiles travel once for a
block of cells or a group of targets, never with each cell. Inputs that break a
rule are refused where they are met; nothing is repaired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.expr import NORMALIZATION, cell_name, damped, log_norm, outside_mass
from deltaloom.operators.cohorts import with_index
from deltaloom.operators.metrics import with_zeros
from deltaloom.session import materialize, small

MOST_DEPTH, MOST_INTENSITY = 1_000_000, 20.0
#: Cells drawn from one generator; cells that a profile is sent for; targets that a block of donors is sent for.
BLOCK, CELLS, TARGETS = 128, 1024, 16


def generator(*key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, key)).encode()).digest()[:8]))


def prediction_grid(contexts: DataFrame, perturbations: DataFrame, n: int) -> DataFrame:
    """context, perturbation, replicate and cell_idx (from 0, in this order) for every combination; the panel of a prediction."""
    p = with_index(perturbations, "perturbation", "at_p")
    grid = with_index(contexts, "context", "at_c").join(small(p), how="cross").select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate"))
    index = (F.col("at_c").cast("long") * p.count() + F.col("at_p")) * n + F.col("replicate") - 1
    return grid.select("context", "perturbation", "replicate", index.alias("cell_idx"))


def expected_nonzeros(profile: DataFrame, depth: int, *by: str) -> DataFrame:
    """Expected number of nonzero genes of a cell: sum of 1 - (1 - p)^depth; profile (by, gene, share)."""
    p = F.least(F.col("share"), F.lit(1.0))
    seen = F.when(p >= 1, F.lit(1.0)).otherwise(-F.expm1(F.lit(float(depth)) * F.log1p(-p)))
    return profile.groupBy(*by).agg(F.sum(seen).alias("expected"))


def multinomial_null(profile: DataFrame, cells: DataFrame, depth: int, seed: int) -> DataFrame:
    """profile (context, gene, share), cells (context, cell_idx) to cell_name, cell_idx, context, gene, cnt: nonzeros of cells of equal depth.

    Ids of cells are grouped; a context's profile, as long as the gene axis, goes with CELLS of them.
    """
    if not 0 < depth <= MOST_DEPTH:
        raise ValueError("depth out of range")
    axis = materialize(with_index(profile, "gene", "idx"), "genes")
    entry = F.sort_array(F.collect_list(F.struct("idx", "share")))
    profiles = profile.join(small(axis), "gene").groupBy("context").agg(entry.alias("p")).select("context", F.col("p.idx").alias("idx"), F.col("p.share").alias("share"))
    blocks = cells.groupBy("context", F.floor(F.col("cell_idx") / CELLS).alias("block")).agg(F.sort_array(F.collect_list("cell_idx")).alias("ids"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                context, idx, share = batch.column(0)[i].as_py(), batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()
                ids = batch.column(1)[i].values.to_numpy()
                total = share.sum()
                if not (np.isfinite(total) and total > 0 and (share >= 0).all()):
                    raise ValueError(f"the profile of {context} isn't one")
                for part in np.split(ids, np.flatnonzero(np.diff(ids // BLOCK)) + 1):
                    counts = generator(seed, context, part[0] // BLOCK).multinomial(depth, share / total, len(part))
                    c, g = np.nonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(context, len(c))).cast(batch.schema.field(0).type), pa.array(part[c]), pa.array(idx[g].astype(np.int32)), pa.array(counts[c, g])], names=["context", "cell_idx", "idx", "cnt"])

    kind = profile.schema["context"].dataType.simpleString()
    drawn = blocks.join(profiles, "context").select("context", "ids", "idx", "share").mapInArrow(draw, f"context {kind}, cell_idx long, idx int, cnt long")
    return drawn.join(small(axis), "idx").select(cell_name("cell_idx").alias("cell_name"), "cell_idx", "context", "gene", "cnt")


#: How many standard deviations a sum of draws may be from what is expected of it.
SIGMAS = 6.0


def _agreement(totals: DataFrame, by: str) -> DataFrame:
    """(by, gene, found, expected, variance) of sums of draws: genes that can be drawn, largest standardised deviation, its mean square, and whether both are what chance gives.

    The mean square of n standardised deviations is 1 with a standard deviation of about sqrt(2 / n). Genes that can't be drawn must not have been.
    """
    z = (F.col("found") - F.col("expected")) / F.sqrt(F.col("variance") + 1)  # a few counts of what is rarely drawn are no deviation
    drawable = F.col("variance") > 0
    own = totals.groupBy(by).agg(
        F.count(F.when(drawable, 1)).alias("n_genes"), F.max(F.when(drawable, F.abs(z))).alias("largest"), F.avg(F.when(drawable, z * z)).alias("mean_square"),
        F.bool_and(drawable | (F.abs(F.col("found") - F.col("expected")) < 1e-6)).alias("nothing_else"),
    )
    good = F.col("nothing_else") & (F.coalesce("largest", F.lit(0.0)) < SIGMAS) & (F.coalesce("mean_square", F.lit(0.0)) < 1 + SIGMAS * F.sqrt(F.coalesce(F.try_divide(F.lit(2.0), "n_genes"), F.lit(0.0))))
    return own.select(by, "n_genes", "largest", "mean_square", F.coalesce(good, F.lit(True)).alias("agrees"))


def null_agreement(drawn: DataFrame, profile: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """By context: whether multinomial_null()'s counts are draws of its profile (context, gene, share): sums of genes, and how cells scatter.

    scatter: mean square of a gene's counts about depth x share, over its variance in a multinomial; 1 for independent cells.
    """
    n = cells.groupBy("context").agg(F.count("*").alias("n_cells"))
    one, p = F.col("share") * F.lit(float(depth)), F.col("share")
    sums = drawn.groupBy("context", "gene").agg(F.sum("cnt").alias("found"), F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("squares"))
    both = profile.select("context", "gene", "share").join(sums, ["context", "gene"], "full").fillna(0.0, ["share", "squares"]).fillna(0, ["found"]).join(small(n), "context")
    both = both.withColumns({"expected": one * F.col("n_cells"), "variance": one * (1 - p) * F.col("n_cells")})
    scatter = F.sum("squares") - F.sum(2 * one * F.col("found")) + F.sum(F.col("n_cells") * one * one)
    own = both.groupBy("context").agg(F.first("n_cells").alias("n_cells"), (scatter / F.nullif(F.sum("variance"), F.lit(0.0))).alias("scatter"))
    found = _agreement(both, "context").join(own, "context")
    # counts of few genes scatter most; a share of 6 / sqrt(cells) is far beyond chance and far below that of equal cells
    fine = F.abs(F.coalesce("scatter", F.lit(1.0)) - 1) < SIGMAS * F.sqrt(2 / F.col("n_cells")) + 0.05
    return found.select("context", "n_cells", "n_genes", "largest", "mean_square", "scatter", (F.col("agrees") & fine).alias("agrees"))


def transport_agreement(drawn: DataFrame, profiles: Profiles, donors: DataFrame, delta: DataFrame) -> DataFrame:
    """By target: whether transport_generate()'s counts are draws of the donors' moved profiles, gene by gene.

    Expected counts are spelt out for each target, draw and gene, as many as the generated cells could have; they are summed where they are made.
    """
    n = delta.select("target").distinct().count()
    cells = donors.select("draw", "cell").join(profiles.rows.select("cell", "lib", "outside", "idx", "x"), "cell")
    own = F.map_from_arrays("idx", "x")
    grid = cells.select("draw", "lib", "outside", own.alias("own")).join(small(profiles.axis, profiles.size), how="cross").select("draw", "lib", "outside", "idx", F.coalesce(F.col("own")[F.col("idx")], F.lit(0.0)).alias("x"))
    moves = delta.select("target", "gene", "d").join(small(profiles.axis, profiles.size), "gene").select("target", "idx", "d")
    rates = grid.join(small(moves, n * profiles.size), "idx").select("target", "draw", "lib", "outside", "idx", F.expm1(F.greatest(F.col("x") + F.col("d"), F.lit(0.0))).alias("rate"))
    total = rates.groupBy("target", "draw").agg((F.sum("rate") + F.first("outside")).alias("total"))
    p = F.col("rate") / F.col("total")
    expected = rates.join(total, ["target", "draw"]).groupBy("target", "idx").agg(F.sum(F.col("lib") * p).alias("expected"), F.sum(F.col("lib") * p * (1 - p)).alias("variance"))
    found = drawn.select("target", F.inline(F.arrays_zip("idx", "cnt"))).groupBy("target", "idx").agg(F.sum("cnt").alias("found"))
    return _agreement(expected.join(found, ["target", "idx"], "left").fillna(0, ["found"]), "target")


@dataclass(frozen=True)
class Profiles:
    """Control cells to draw from.

    rows: cell, batch, lib, outside (normalised mass beyond the panel), idx and x
    (places on the axis with counts, and log values there). axis: gene, idx. size: genes on the axis.
    """

    rows: DataFrame
    axis: DataFrame
    size: int

    def of(self, cells: DataFrame) -> Profiles:
        """Those of some cells only."""
        return replace(self, rows=self.rows.join(cells.select("cell"), "cell", "left_semi"))

    def written(self) -> Profiles:
        return replace(self, rows=materialize(self.rows, "profiles"))


def _refuse(good: Column, value: Column, why: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(why)).cast("double"))


def transport_profiles(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> Profiles:
    """counts (cell, gene, cnt, lib), cells (cell, batch, lib), genes (gene: the axis, of any type).

    Refused as the rows are read: counts that aren't whole numbers of 0 or more,
    libraries that aren't whole, positive and at most MOST_DEPTH, or smaller than the panel's sum.
    """
    axis = materialize(with_index(genes, "gene", "idx"), "genes")
    c = F.col("cnt").cast("double")
    whole = c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c == F.floor(c)) & (c < float("inf"))
    own = counts.join(small(axis), "gene").select("cell", "idx", _refuse(whole, c, "control counts must be whole numbers of 0 or more").alias("cnt"), _refuse(F.col("lib") > 0, F.col("lib").cast("double"), "libraries must be whole and positive").alias("lib"))
    entry = F.struct("idx", log_norm("cnt", "lib").alias("x"))
    sums = own.groupBy("cell").agg(F.sum("cnt").alias("panel"), F.sort_array(F.collect_list(F.when(F.col("cnt") > 0, entry))).alias("p"))
    lib, panel = F.col("lib").cast("double"), F.coalesce("panel", F.lit(0.0))
    fine = lib.isNotNull() & (lib > 0) & (lib == F.floor(lib)) & (lib <= MOST_DEPTH) & (panel <= lib)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = cells.select("cell", "batch", "lib").join(sums, "cell", "left").select(
        "cell", "batch", _refuse(fine, lib, "libraries must be whole, positive, bounded, and no less than the panel's sum").alias("lib"), outside_mass(lib, panel).alias("outside"),
        F.coalesce(F.col("p.idx"), none("int")).alias("idx"), F.coalesce(F.col("p.x"), none("double")).alias("x"),
    )
    return Profiles(rows, axis, axis.count())


def transport_mean(profiles: Profiles) -> DataFrame:
    """gene, mean of log values; cells without a count are zeros."""
    n = profiles.rows.agg(F.count("*").alias("n"))
    sums = profiles.rows.select(F.inline(F.arrays_zip("idx", "x"))).groupBy("idx").agg(F.sum("x").alias("s"))
    return profiles.axis.join(sums, "idx", "left").join(F.broadcast(n), how="cross").select("gene", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))


_DRAWN = "sample long, depth long, clipped long, idx array<int>, cnt array<int>"


def transport_generate(profiles: Profiles, donors: DataFrame, delta: DataFrame, seed: int, targets: int | None = None) -> DataFrame:
    """A generated cell for each target and draw: the donor's profile moved by the target's delta, drawn anew at the donor's depth.

    donors (draw, cell), delta (target, gene, d) to target, sample (the draw),
    depth, clipped (genes moved below 0), idx and cnt (places on the axis with counts); what
    falls outside the panel is dropped. A block of donors is sent once for TARGETS
    targets (how many there are: targets, counted if not known). Refused: deltas that aren't finite or don't cover the axis once, donors
    without a profile, intensities above MOST_INTENSITY, profiles without mass.
    """
    size = profiles.size
    if targets is None:
        targets = delta.select("target").distinct().count()
    moves = delta.join(small(profiles.axis, size), "gene", "left").groupBy("target").agg(F.sort_array(F.collect_list(F.struct("idx", "d"))).alias("m"))
    groups = F.lit(max(1, -(-targets // TARGETS)))
    moves = moves.select("target", F.col("m.idx").alias("places"), F.col("m.d").alias("d"), F.pmod(F.xxhash64("target"), groups).cast("int").alias("part"))
    block = F.floor(F.col("draw") / BLOCK)
    own = donors.select("draw", F.col("cell").alias("donor"), block.alias("block")).join(profiles.rows, F.col("donor") == F.col("cell"), "left")
    own = own.select("draw", "block", "lib", "outside", "idx", "x", F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"))
    moves = moves.join(donors.select(block.alias("block")).distinct(), how="cross")

    def draw(key: tuple, cells: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("draw")
        if cells["lib"].isna().any():
            raise ValueError("a donor has no profile")
        x = np.zeros((len(cells), size))
        for i, (idx, values) in enumerate(zip(cells["idx"], cells["x"], strict=True)):
            x[i, idx] = values
        depth, outside = np.rint(cells["lib"].to_numpy()).astype(np.int64), cells["outside"].to_numpy()
        out = []
        for target, places, d in zip(targets["target"], targets["places"], targets["d"], strict=True):
            d = np.asarray(d, float)
            if len(d) != size or not np.isfinite(d).all() or not np.array_equal(np.asarray(places, float), np.arange(size)):
                raise ValueError(f"deltas of {target} must be finite and cover the genes once")
            moved = x + d
            if (moved > MOST_INTENSITY).any():
                raise ValueError("intensity out of range")
            rates = np.hstack([np.expm1(np.maximum(moved, 0)), outside[:, None]])
            total = rates.sum(axis=1, keepdims=True)
            if (total <= 0).any():
                raise ValueError("a profile has no mass")
            counts = generator(seed, target, key[0]).multinomial(depth, rates / total)[:, :-1]
            seen = [np.flatnonzero(c) for c in counts]
            out.append(pd.DataFrame({"target": target, "sample": cells["draw"].to_numpy(), "depth": depth, "clipped": (moved < 0).sum(axis=1), "idx": seen, "cnt": [c[s] for c, s in zip(counts, seen, strict=True)]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["target", "sample", "depth", "clipped", "idx", "cnt"])

    kind = delta.schema["target"].dataType.simpleString()
    return own.groupBy("block", "part").cogroup(moves.groupBy("block", "part")).applyInPandas(draw, f"target {kind}, {_DRAWN}")


def generated_counts(drawn: DataFrame, profiles: Profiles) -> DataFrame:
    """target, sample, depth, gene, cnt: the nonzeros of generated cells."""
    long = drawn.select("target", "sample", "depth", F.inline(F.arrays_zip("idx", "cnt")))
    return long.join(small(profiles.axis, profiles.size), "idx").select("target", "sample", "depth", "gene", F.col("cnt").cast("long").alias("cnt"))


def generated_moments(drawn: DataFrame, profiles: Profiles, scale: float = NORMALIZATION) -> DataFrame:
    """target, gene: mean and variance of normalised counts and share of zeros of generated cells."""
    n = drawn.groupBy("target").agg(F.count("*").alias("n"))
    x = F.log1p(F.col("cnt") * F.lit(scale) / F.col("depth"))
    long = drawn.select("target", "depth", F.inline(F.arrays_zip("idx", "cnt"))).select("target", "idx", x.alias("x"))
    sums = long.groupBy("target", "idx").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("k"))
    grid = n.join(small(profiles.axis, profiles.size), how="cross").join(sums, ["target", "idx"], "left").fillna(0.0, ["m", "v"]).fillna(0, ["k"])
    mean, variance = with_zeros(F.col("m"), F.col("v"), F.col("k"), F.col("n"))
    return grid.select("target", "gene", mean.alias("mean"), F.coalesce(variance, F.lit(0.0)).alias("variance"), (1 - F.col("k") / F.col("n")).alias("dropout"))


def sample_report(drawn: DataFrame, profiles: Profiles, requested: DataFrame) -> DataFrame:
    """Per target: panel libraries, share of values moved below 0, and distance of the achieved from the requested change."""
    panel = F.aggregate("cnt", F.lit(0).cast("long"), lambda a, c: a + c)
    sizes = drawn.withColumn("panel", panel).groupBy("target").agg(
        F.min("panel").alias("min_panel"), F.max("panel").alias("max_panel"), F.bool_and(F.col("panel") <= F.col("depth")).alias("within_depth"),
        (F.sum("clipped") / (F.count("*") * profiles.size)).alias("clip_fraction"),
    )
    found = generated_moments(drawn, profiles).select("target", "gene", F.col("mean").alias("found")).join(transport_mean(profiles), "gene").join(requested.select("target", "gene", "d"), ["target", "gene"])
    e = F.col("found") - F.col("mean") - F.col("d")
    return sizes.join(found.groupBy("target").agg(F.sqrt(F.avg(e * e)).alias("delta_rmse")), "target")


@dataclass(frozen=True)
class Calibration:
    """offsets: target, gene, d, to be used instead of the requested delta. history: the error of each evaluation."""

    offsets: DataFrame
    requested: DataFrame
    history: list[float]
    impossible: int  # genes whose requested mean is below 0
    bounded: int  # offsets at the bound


def calibrate(
    profiles: Profiles, donors: DataFrame, requested: DataFrame, iterations: int, seed: int, rate: float = 0.5, step: float = 0.25, most: float = 4.0, generate: Callable = transport_generate
) -> Calibration:
    """The last calibration of calibrations() with so many iterations."""
    return calibrations(profiles, donors, requested, (iterations,), seed, rate, step, most, generate)[iterations]


def calibrations(
    profiles: Profiles, donors: DataFrame, requested: DataFrame, iterations: tuple[int, ...], seed: int, rate: float = 0.5, step: float = 0.25, most: float = 4.0, generate: Callable = transport_generate
) -> dict[int, Calibration]:
    """Offsets that bring means of generated cells near the requested ones, from the requested deltas (target, gene, d) on, after each of some numbers of iterations.

    Donors and seed are the same in all iterations, so that fewer iterations are the beginning of more: the way is gone once. The offset as a whole stays
    within most, and a request beyond it is refused. Offsets stay on the executors,
    a written table for each iteration.
    """
    last = max(iterations, default=0)
    if not all(isinstance(n, int) and n >= 1 for n in iterations) or last < 1 or not 0 < rate <= 1 or not 0 < step <= most or not np.isfinite(most):
        raise ValueError("calibration parameters out of range")
    requested = requested.select("target", "gene", F.col("d").cast("double").alias("d"))
    bad = F.count(F.when(F.col("d").isNull() | F.isnan("d") | (F.abs("d") == float("inf")), 1))
    not_finite, beyond, targets = requested.agg(bad, F.count(F.when(F.abs("d") > most, 1)), F.countDistinct("target")).head()
    if not_finite:
        raise ValueError("deltas must be finite")
    if beyond:
        raise ValueError(f"requested deltas must be within {most}")
    state = requested.join(transport_mean(profiles), "gene")
    state = materialize(state.select("target", "gene", F.greatest(F.col("mean") + F.col("d"), F.lit(0.0)).alias("desired"), (F.col("mean") + F.col("d") < 0).alias("impossible"), "d"), "offsets")
    versions, steps = {}, None
    for i in range(last + 1):
        found = generated_moments(generate(profiles, donors, state.select("target", "gene", "d"), seed, targets), profiles).select("target", "gene", F.col("mean").alias("found"))
        error = F.col("desired") - F.col("found")
        moved = damped(F.col("d"), error, rate, step, most) if i < last else F.col("d")
        state = materialize(state.join(found, ["target", "gene"]).select("target", "gene", "desired", "impossible", F.col("d").alias("used"), moved.alias("d"), error.alias("error")), "offsets")
        if i in iterations:
            versions[i] = state.select("target", "gene", F.col("used").alias("d"))
        own = state.select(F.lit(i).alias("i"), "error", "impossible", "used")
        steps = own if steps is None else steps.union(own)
    rmse, beyond = F.sqrt(F.avg(F.col("error") * F.col("error"))), F.count(F.when(F.abs("used") >= most, 1))
    rows = steps.groupBy("i").agg(rmse.alias("rmse"), F.count(F.when(F.col("impossible"), 1)).alias("impossible"), beyond.alias("bounded")).orderBy("i").collect()
    return {n: Calibration(versions[n], requested, [r["rmse"] for r in rows[: n + 1]], rows[n]["impossible"], rows[n]["bounded"]) for n in sorted(set(iterations))}


def generate_calibrated(profiles: Profiles, donors: DataFrame, calibration: Calibration, seed: int) -> tuple[DataFrame, DataFrame]:
    """Cells generated with a calibration's offsets, and their report, scored against what was requested."""
    drawn = materialize(transport_generate(profiles, donors, calibration.offsets, seed), "drawn")
    return drawn, sample_report(drawn, profiles, calibration.requested)
