"""Whole runs: from tables to written results, with selections frozen before held-out labels are read.

A run's folder may be on any file system that Spark writes to. A lock beside it lets one run at a time in; the last file
says that it is finished. One that was broken off is run again: its frozen selection holds if the tables are the same, and tables are written anew.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions.expr import is_mapped
from deltaloom.operators import calibration, cohorts, families, generate, graph, lowrank, metrics, pseudobulk, splits, transfer, validate
from deltaloom.plans import stages
from deltaloom.plans.fingerprint import changed, fingerprints, manifest
from deltaloom.session import materialize, small
from deltaloom.sources import sinks, star
from deltaloom.sources.star import CONTROL, HELD, TRAIN
from deltaloom.sources.store import Place


@stages.claimed
def run_pseudobulk(spark: SparkSession, sf_dir: str, out: str, least_controls: int = 10) -> dict:
    """Check the inputs, aggregate, and write deltas, control baselines, strata and cohorts."""
    began, root = time.time(), Place(spark, out)
    stages.require_new(root / "report.json")
    root.mkdir()
    data = star.cells(spark, sf_dir)
    sums = materialize(pseudobulk.sufficient(data.rows), "sums")
    stats, groups, genes, _ = pseudobulk.parts_of(sums)
    validate.require(validate.bad_counts(data.counts), "raw counts")
    validate.require(validate.above_library(data.counts, 0.01), "library")
    validate.require(validate.too_few_controls(groups, CONTROL, least_controls), "matched controls")
    sinks.write_table(pseudobulk.matched_delta_of(sums, CONTROL), f"{out}/delta", "line", mode="overwrite")
    sinks.write_table(pseudobulk.control_baseline(stats, groups, genes, CONTROL), f"{out}/baseline", mode="overwrite")
    sinks.write_table(pseudobulk.matched_strata(groups, CONTROL), f"{out}/strata", mode="overwrite")
    delta = spark.read.parquet(f"{out}/delta")
    validate.require(validate.repeated(delta, "line", "target", "gene"), "repeated pairs")
    found = cohorts.cohorts(delta, TRAIN, HELD).orderBy("target").collect()
    summary = {c: [r["target"] for r in found if r["cohort"] == c] for c in ("shared", "unseen")} | {"genes": cohorts.common_axis(delta, TRAIN, HELD).count()}
    sinks.write_json(summary, root / "cohorts.json")
    report = pseudobulk.quality_report(data.counts, data.cells).collect()
    sinks.write_json({"lines": [r.asDict() for r in report], "run": stages.provenance(began, {})}, root / "report.json")
    return summary


@stages.claimed
def run_transfer(spark: SparkSession, pseudobulk_dir: str, out: str, alphas: list[float], folds: int = 5, seed: int = 2026) -> dict:
    """Choose a penalty on the training line, freeze it, and only then read held-out responses and write metrics."""
    began, root = time.time(), Place(spark, out)
    root.mkdir()
    stages.require_new(root / "metrics.json")
    delta, baseline = spark.read.parquet(f"{pseudobulk_dir}/delta"), spark.read.parquet(f"{pseudobulk_dir}/baseline")
    line = lambda df, x: df.where(F.col("line") == x)
    axis = cohorts.common_axis(delta.select("line", "gene"), TRAIN, HELD)
    train = line(delta, TRAIN).join(small(axis), "gene").select("target", "gene", F.col("delta_log").alias("y"))
    validate.require(transfer.matrix_problems(train, train.select("target").distinct(), axis), "training matrix")
    x = transfer.basal(train, line(baseline, TRAIN))
    parts = transfer.folds(x, folds, seed)

    def select() -> dict:
        losses = transfer.alpha_losses(x, train, parts, alphas)
        return {"alpha": transfer.best_alpha(losses).head()["alpha"], "mse": {str(r["alpha"]): r["mse"] for r in losses.collect()}}

    key = {"alphas": alphas, "folds": folds, "seed": seed, "inputs": fingerprints({"delta": delta, "baseline": baseline})}
    chosen = stages.frozen_selection(root / "selection.json", key, select)
    targets = line(delta.select("line", "target"), HELD).select("target").distinct()
    scale = transfer.fit_scale(x)
    model = transfer.ridge_fit(transfer.apply_scale(x, scale), train, chosen["alpha"])
    sinks.write_table(model, f"{out}/model", mode="overwrite")
    genes = train.select("gene").distinct()
    predicted = transfer.ridge_predict(transfer.apply_scale(transfer.basal(targets, line(baseline, HELD)), scale), model)
    for p in (transfer.zero_delta(targets, genes), transfer.training_mean(train, targets), transfer.nearest_line(train, targets)):
        predicted = predicted.unionByName(p)
    sinks.write_table(predicted, f"{out}/predictions", "model", mode="overwrite")
    # held-out responses are first read here
    held = line(delta, HELD).join(small(axis), "gene").select("target", "gene", F.col("delta_log").alias("y"))
    found = metrics.cohort_metrics(metrics.target_errors(held, spark.read.parquet(f"{out}/predictions")), cohorts.cohorts(delta, TRAIN, HELD)).orderBy("model", "cohort")
    stages.release(root / "metrics.csv")
    sinks.write_report(found, root / "metrics.csv")
    rows = [r.asDict() for r in found.collect()]
    sinks.write_json({"selection": chosen, "metrics": rows, "run": stages.provenance(began, key)}, root / "metrics.json")
    return {"selection": chosen, "metrics": rows}


def _line(df: DataFrame, line: str) -> DataFrame:
    return df.where(F.col("line") == line)


@stages.claimed
def run_models(
    spark: SparkSession, pseudobulk_dir: str, aliases: DataFrame, links: DataFrame, out: str, settings: list[families.Setting] | None = None, rank: int = 16, folds: int = 5, seed: int = 2026, threshold: int = 700
) -> dict:
    """Graph and low-rank models: cross-validate the grid on the training line, freeze the choice, fit what was chosen on all of it, predict, and only then read held-out responses.

    aliases (protein, gene: any alias), links (protein1, protein2, score).
    """
    began, root = time.time(), Place(spark, out)
    root.mkdir()
    stages.require_new(root / "metrics.json")
    settings = families.grid((1.0, 100.0, 1000.0), (7, 15)) if settings is None else settings
    delta, baseline = spark.read.parquet(f"{pseudobulk_dir}/delta").where(is_mapped("target")), spark.read.parquet(f"{pseudobulk_dir}/baseline")
    axis = cohorts.common_axis(delta.select("line", "gene"), TRAIN, HELD)
    train = materialize(_line(delta, TRAIN).join(small(axis), "gene").select("target", "gene", F.col("delta_log").alias("y")), "train")
    targets = delta.select("line", "target").distinct()
    wanted = targets.select(F.col("target").alias("gene")).distinct()
    edges = graph.build_graph(aliases, links, wanted, threshold)
    sinks.write_table(edges, f"{out}/graph", mode="overwrite")
    edges = spark.read.parquet(f"{out}/graph").withColumn("w", F.col("w").cast("double"))
    x_train, x_held = (transfer.basal(_line(targets, x), _line(baseline, x)) for x in (TRAIN, HELD))
    validate.require(transfer.matrix_problems(train, train.select("target").distinct(), axis), "training matrix")
    transfer.require_folds(folds, x_train.count())
    transfer.require_observed(x_train, train)

    def select() -> dict:
        losses = families.grid_losses(train, transfer.folds(x_train, folds, seed), families.feature_maker(edges, x_train), settings, rank, seed)
        return families.choose(materialize(losses, "losses"))

    key = {"settings": [repr(s) for s in settings], "rank": rank, "folds": folds, "seed": seed, "threshold": threshold, "inputs": fingerprints({"delta": spark.read.parquet(f"{pseudobulk_dir}/delta"), "baseline": baseline, "aliases": aliases, "links": links})}
    chosen = stages.frozen_selection(root / "selection.json", key, select)
    best = [s for s in settings if s.name in chosen["best"].values()]
    known: dict = {}
    predicted = families.predict(train, families.feature_maker(edges, x_train), families.feature_maker(edges, x_held), best, rank, seed, known)
    held_targets, genes = x_held.select("target"), train.select("gene").distinct()
    rows = transfer.zero_delta(held_targets, genes).unionByName(transfer.training_mean(train, held_targets))
    for name, p in predicted.items():
        rows = rows.unionByName(p.select(F.lit(name).alias("model"), "target", "gene", "p"))
    sinks.write_table(rows, f"{out}/predictions", "model", mode="overwrite")
    sinks.write_table(manifest(spark, {"predictions": spark.read.parquet(f"{out}/predictions")}), f"{out}/manifest", mode="overwrite")
    sinks.write_table(known["mean"], f"{out}/mean", mode="overwrite")
    sinks.write_table(known["basis"], f"{out}/basis", mode="overwrite")
    sinks.write_table(known["scores"], f"{out}/scores", mode="overwrite")
    for s in best:
        if s.family == "trees":
            lowrank.save_trees(known[s.name], f"{out}/{s.name}", "overwrite")
        else:
            sinks.write_json({"features": known["scaling"][s.name], "coefficients": known[s.name].tolist()}, root / f"{s.name}.json")
    frozen = sinks.digest(root / "selection.json")
    # held-out responses are first read here
    held = _line(delta, HELD).join(small(axis), "gene").select("target", "gene", F.col("delta_log").alias("y"))
    found = metrics.cohort_metrics(metrics.target_errors(held, spark.read.parquet(f"{out}/predictions")), cohorts.cohorts(delta, TRAIN, HELD)).orderBy("model", "cohort")
    stages.release(root / "metrics.csv")
    sinks.write_report(found, root / "metrics.csv")
    rows = [r.asDict() for r in found.collect()]
    report = graph.graph_report(edges, aliases, wanted).head().asDict()
    sinks.write_json({"selection": chosen, "selection_sha256": frozen, "graph": report, "metrics": rows, "run": stages.provenance(began, key)}, root / "metrics.json")
    return {"selection": chosen, "metrics": rows, "graph": report}


def _controls(data: star.Cells) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Control cells of the training line, their counts, and the line's genes."""
    own = lambda df: _line(df, TRAIN).where(F.col("target") == CONTROL)
    return own(data.cells), own(data.counts), _line(data.counts, TRAIN).select("gene").distinct()


@stages.claimed
def run_calibration(
    spark: SparkSession, sf_dir: str, out: str, parts: dict[str, int] | None = None, iterations: tuple[int, ...] = (0, 8, 16), seed: int = 20261013, mc_seed: int = 71001, seeds: tuple[int, ...] = (72001, 72002, 72003)
) -> dict:
    """Generators of control cells: choose on calibration cells, freeze, and only then read the audit's; the choice must not change by it."""
    began, root = time.time(), Place(spark, out)
    stages.require_new(root / "metrics.json")
    parts = parts or {"fit": 12, "calibration": 4, "audit": 4}
    data = star.cells(spark, sf_dir)
    cells, counts, genes = _controls(data)
    validate.require(splits.short_batches(cells, parts), "controls in each batch")
    root.mkdir()
    sinks.write_table(splits.split_controls(cells, parts, seed), f"{out}/cells", mode="overwrite")
    split = spark.read.parquet(f"{out}/cells")
    of = lambda p: split.where(F.col("part") == p).select("cell")
    moments_of = lambda p: materialize(metrics.moments(counts.join(of(p), "cell", "left_semi"), cells.join(of(p), "cell", "left_semi"), genes), "reference")
    validate.require(validate.bad_counts(counts), "raw counts")
    fit = generate.transport_profiles(counts, cells, genes).of(of("fit")).written()
    donors = materialize(splits.balanced_donors(fit.rows, parts["fit"], mc_seed), "donors")
    deltas = calibration.candidates(fit, donors, iterations, mc_seed)
    for name, d in deltas.items():
        sinks.write_table(d, f"{out}/offsets/{name}", mode="overwrite")
    deltas = {name: spark.read.parquet(f"{out}/offsets/{name}") for name in deltas}
    donors_of = lambda s: splits.balanced_donors(fit.rows, parts["calibration"], s)

    def select() -> dict:
        scored = materialize(calibration.evaluate_candidates(fit, donors_of, deltas, moments_of("calibration"), list(seeds)), "scored")
        scores = scored.select("candidate", "seed", F.col("mean_log_rmse").alias("score"))
        validate.require(calibration.seed_problems(scores), "seeds of candidates")
        return {"candidate": calibration.select_candidate(scores).head()["candidate"], "rows": [r.asDict() for r in scored.orderBy("candidate", "seed").collect()]}

    key = {"parts": parts, "iterations": list(iterations), "seed": seed, "mc_seed": mc_seed, "seeds": list(seeds), "inputs": fingerprints({"cells": split, "counts": counts} | {f"offsets/{name}": d for name, d in deltas.items()})}
    chosen = stages.frozen_selection(root / "selection.json", key, select)
    frozen = sinks.digest(root / "selection.json")
    # audit cells are first read here; all candidates are audited, the choice stays
    audit = calibration.evaluate_candidates(fit, donors_of, deltas, moments_of("audit"), list(seeds)).orderBy("candidate", "seed")
    rows = [r.asDict() for r in audit.collect()]
    noise = {p: metrics.distribution_distance(moments_of("fit"), moments_of(p)).head().asDict() for p in ("calibration", "audit")}
    if sinks.digest(root / "selection.json") != frozen:
        raise RuntimeError("the selection has changed during the audit")
    sinks.write_json({"selection": chosen, "selection_sha256": frozen, "audit": rows, "split_noise": noise, "run": stages.provenance(began, key)}, root / "metrics.json")
    return {"selection": chosen, "audit": rows}


@stages.claimed
def run_rehearsal(spark: SparkSession, sf_dir: str, models_dir: str, out: str, models: tuple[str, ...], per_cohort: int = 3, cells: int = 128, fit: int = 512, score: int = 256, seed: int = 2026) -> dict:
    """Counts for some held-out targets from models' predicted deltas, and their distance from the targets' own cells.

    Targets are the first of each cohort by hash among those with enough cells;
    fit controls make the profiles, score controls go with the written cells. Predictions must be
    those that the models' run has written; the choice of targets is frozen, and a run that takes it up again needs the same tables.
    """
    began, root = time.time(), Place(spark, out)
    stages.require_new(root / "metrics.json")
    data = star.cells(spark, sf_dir)
    held_cells, held_counts = _line(data.cells, HELD), _line(data.counts, HELD)
    predicted = spark.read.parquet(f"{models_dir}/predictions")
    validate.require(changed(spark.read.parquet(f"{models_dir}/manifest"), {"predictions": predicted}), "predictions as written")
    genes = predicted.select("gene").distinct()
    support = held_cells.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") >= cells)
    able = cohorts.cohorts(data.cells.where(F.col("target") != CONTROL).select("line", "target").distinct(), TRAIN, HELD).join(support, "target", "left_semi").join(predicted.select("target").distinct(), "target", "left_semi")

    def select() -> dict:
        found = materialize(splits.hash_top_k(able, per_cohort), "targets")
        if short := [r["cohort"] for r in found.groupBy("cohort").count().collect() if r["count"] != per_cohort]:
            raise ValueError(f"too few targets in {short}")
        return {"targets": [[r["target"], r["cohort"], r["place"]] for r in found.orderBy("cohort", "place").collect()]}

    key = {"models": list(models), "per_cohort": per_cohort, "cells": cells, "fit": fit, "score": score, "seed": seed, "inputs": fingerprints({"predictions": predicted, "cells": data.cells, "counts": data.counts})}
    root.mkdir()
    frozen = stages.frozen_selection(root / "selection.json", key, select)["targets"]
    chosen = spark.createDataFrame([tuple(r) for r in frozen], "target string, cohort string, place int")
    controls = held_cells.where(F.col("target") == CONTROL)
    slices = materialize(splits.slices(controls, {"fit": fit, "score": score}, seed), "slices")
    if slices.count() < fit + score:
        raise ValueError("too few controls")
    sampled = materialize(splits.sample_per_target(held_cells.join(small(chosen.select("target")), "target", "left_semi"), cells, seed), "cells")
    sinks.write_table(sampled, f"{out}/cells", mode="overwrite")
    sinks.write_table(slices, f"{out}/controls", mode="overwrite")
    own = held_counts.where(F.col("target") == CONTROL).join(small(genes), "gene", "left_semi")
    profiles = generate.transport_profiles(own, controls, genes).of(slices.where("part = 'fit'")).written()
    donors = materialize(splits.uniform_donors(profiles.rows, cells, seed), "donors")
    real = metrics.moments(held_counts.join(sampled.select("cell"), "cell", "left_semi").join(small(genes), "gene", "left_semi"), held_cells.join(sampled.select("cell"), "cell", "left_semi"), genes, "target")
    real = materialize(real, "real").select("target", "gene", F.col("mean").alias("mean_r"), F.col("variance").alias("variance_r"), F.col("dropout").alias("dropout_r"))
    rows = []
    for model in models:
        delta = predicted.where(F.col("model") == model).join(small(chosen.select("target")), "target", "left_semi").select("target", "gene", F.col("p").alias("d"))
        sinks.write_table(generate.transport_generate(profiles, donors, delta, seed), f"{out}/generated/{model}", mode="overwrite")
        drawn = spark.read.parquet(f"{out}/generated/{model}")
        both = generate.generated_moments(drawn, profiles).join(real, ["target", "gene"])
        off = lambda c: F.sqrt(F.avg((F.col(c) - F.col(f"{c}_r")) * (F.col(c) - F.col(f"{c}_r"))))
        scored = both.groupBy("target").agg(off("mean").alias("mean_log_rmse"), off("variance").alias("variance_log_rmse"), F.avg(F.abs(F.col("dropout") - F.col("dropout_r"))).alias("dropout_mae"))
        scored = scored.join(generate.sample_report(drawn, profiles, delta), "target").join(chosen.select("target", "cohort"), "target")
        rows += [{"model": model} | r.asDict() for r in scored.orderBy("target").collect()]
    sinks.write_json({"targets": [t for t, *_ in frozen], "rows": rows, "run": stages.provenance(began, key)}, root / "metrics.json")
    return {"rows": rows}


#: Bytes that a stored count takes on disk, at most; bytes that must stay free.
ENTRY, RESERVE = 16, 512 << 20


@stages.claimed
def run_null(spark: SparkSession, sf_dir: str, out: str, replicates: int = 400, depth: int = 20_000, most: int = 4_750_000_000, seed: int = 2026) -> dict:
    """The null prediction: for every context and perturbation cells drawn from the context's control profile, whatever the perturbation.

    Expected entries and free space are looked at before anything is drawn. What is drawn is written under another name, held against the
    panel, the cap of stored entries, the depth and the profiles, and appears as prediction/ only if all of it is right.
    """
    began, root = time.time(), Place(spark, out)
    stages.require_new(root / "report.json", root / "prediction")
    root.mkdir()
    data = star.cells(spark, sf_dir)
    cells, counts, _ = _controls(data)
    validate.require(validate.bad_counts(counts), "raw counts")
    profile = splits.control_profile(counts, "batch").withColumnRenamed("batch", "context")
    profile = materialize(profile, "profile")
    perturbations = materialize(_line(data.cells, HELD).where(F.col("target") != CONTROL).select(F.col("target").alias("perturbation")).distinct(), "perturbations")
    contexts = profile.select("context").distinct()
    grid = materialize(generate.prediction_grid(contexts, perturbations, replicates), "grid")
    per_context = perturbations.count() * replicates
    expected = generate.expected_nonzeros(profile, depth, "context").agg(F.coalesce(F.sum("expected"), F.lit(0.0))).head()[0] * per_context
    if expected > most:
        raise ValueError(f"about {expected:.0f} stored entries are to be expected; the cap is {most}")
    if root.free() < expected * ENTRY + RESERVE:
        raise RuntimeError(f"{root.free()} bytes are free; about {expected * ENTRY:.0f} and {RESERVE} more are needed")
    partial = root / "prediction.partial"
    partial.remove()
    try:
        drawn = generate.multinomial_null(profile, grid, depth, seed)
        sinks.write_table(drawn.join(small(grid.select("cell_idx", "perturbation")), "cell_idx"), f"{partial}/counts", "context")
        sinks.write_table(grid, f"{partial}/cells")
        written = spark.read.parquet(f"{partial}/counts")
        fit = generate.null_agreement(written, profile, grid, depth)
        report = require_prediction(written, spark.read.parquet(f"{partial}/cells"), grid, profile, replicates, depth, most)
        validate.require(fit.where(~F.col("agrees")), "counts as drawn from the profiles")
        report["fit"] = [r.asDict() for r in fit.orderBy("context").collect()]
        partial.move(root / "prediction")
    finally:
        partial.remove()
    key = {"replicates": replicates, "depth": depth, "most": most, "seed": seed, "inputs": fingerprints({"profile": profile})}
    made = manifest(spark, {"prediction": spark.read.parquet(f"{out}/prediction/counts")}).head().asDict()
    sinks.write_json(report | {"expected_entries": expected, "prediction": made, "run": stages.provenance(began, key)}, root / "report.json")
    return report


def require_prediction(counts: DataFrame, cells: DataFrame, panel: DataFrame, profile: DataFrame, replicates: int, depth: int, most: int) -> dict:
    """Raise unless a prediction's cells are the panel's, and its counts are whole, positive, on known genes, of the depth in every cell and within the cap; what it holds otherwise."""
    validate.require(validate.panel_difference(cells, panel, ["context", "perturbation"], replicates), "cells of the panel")
    validate.require(validate.repeated(cells, "cell_idx"), "repeated cells")
    validate.require(validate.stored_zeros(counts), "stored zeros")
    validate.require(validate.too_many_nonzeros(counts, most), "stored entries")
    validate.require(validate.repeated(counts, "cell_idx", "gene"), "repeated pairs of cell and gene")
    validate.require(counts.join(small(profile.select("gene").distinct()), "gene", "left_anti"), "genes of the panel")
    sums = counts.groupBy("cell_idx").agg(F.sum("cnt").alias("depth"), F.min("cnt").alias("least"), F.count("*").alias("nnz"))
    both = cells.select("cell_idx").join(sums, "cell_idx", "full").where((F.coalesce("depth", F.lit(0)) != depth) | (F.col("least") < 1))
    validate.require(both, "depth of every cell")
    return sums.agg(F.count("*").alias("cells"), F.sum("nnz").alias("entries"), F.min("nnz").alias("least_genes"), F.max("nnz").alias("most_genes"), F.sum("depth").alias("counts")).head().asDict()
