"""Reproducible splits, selections and samples: order by a hash of seed and id instead of a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def split_controls(cells: DataFrame, parts: dict[str, int], seed: int) -> DataFrame:
    """(batch, cell) to batch, cell, part: disjoint parts of so many cells from each batch."""
    n = F.row_number().over(Window.partitionBy("batch").orderBy(hash_order(seed, "cell")))
    part, low = F.lit(None).cast("string"), 0
    for name, size in parts.items():
        part = F.when((n > low) & (n <= low + size), name).otherwise(part)
        low += size
    return cells.select("batch", "cell", part.alias("part")).where("part is not null")


def short_batches(cells: DataFrame, parts: dict[str, int]) -> DataFrame:
    """Batches with too few cells for the parts."""
    return cells.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") < sum(parts.values()))


def hash_top_k(targets: DataFrame, k: int) -> DataFrame:
    """(target, cohort): the k targets of each cohort with the smallest hash, with their place."""
    own = Window.partitionBy("cohort").orderBy(F.sha2(F.col("target").cast("string"), 256))
    return targets.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k)


def sample_per_target(cells: DataFrame, n: int, seed: int) -> DataFrame:
    """n cells of each target, without replacement; place keeps their order."""
    own = Window.partitionBy("target").orderBy(hash_order(seed, "cell"))
    return cells.select("target", "cell", F.row_number().over(own).alias("place")).where(F.col("place") <= n)


def slices(cells: DataFrame, sizes: dict[str, int], seed: int) -> DataFrame:
    """Successive slices of one permutation of all cells (a few controls)."""
    low, part, bound = 0, F.lit(None).cast("string"), sum(sizes.values())
    first = cells.select("cell", hash_order(seed, "cell").alias("h")).orderBy("h").limit(bound)
    n = F.row_number().over(Window.orderBy("h"))
    for name, size in sizes.items():
        part = F.when((n > low) & (n <= low + size), name).otherwise(part)
        low += size
    return first.select("cell", part.alias("part"))


def _place(key: Column, n: Column) -> Column:
    """A place below n, by the first 12 hexadecimal digits of a key's hash."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("long"), n).cast("int")


def balanced_donors(cells: DataFrame, per_batch: int, seed: int) -> DataFrame:
    """per_batch draws with replacement from each batch: draw, batch, cell (the donor). Draws are numbered in the order of a hash."""
    if per_batch < 1:
        raise ValueError("no draws")
    ranked = cells.select("batch", "cell", (F.row_number().over(Window.partitionBy("batch").orderBy("cell")) - 1).alias("at"))
    n = cells.groupBy("batch").agg(F.count("*").alias("n"))
    draws = n.select("batch", "n", F.explode(F.sequence(F.lit(0), F.lit(per_batch - 1))).alias("i"))
    at = _place(F.concat_ws(":", F.lit(str(seed)), "batch", F.col("i").cast("string")), F.col("n"))
    draws = draws.select("batch", "i", at.alias("at"))
    shuffled = draws.join(ranked, ["batch", "at"]).withColumn("h", F.sha2(F.concat_ws(":", F.lit(f"{seed}:order"), "batch", F.col("i").cast("string")), 256))
    return numbered(shuffled, "h", "draw").select("draw", "batch", "cell")


def uniform_donors(cells: DataFrame, draws: int, seed: int) -> DataFrame:
    """draws with replacement from all cells alike: draw, cell (the donor)."""
    if draws < 1:
        raise ValueError("no draws")
    ranked = numbered(cells.select("cell", hash_order(seed, "cell").alias("h")), "h", "at").select("at", F.col("cell"))
    n = cells.agg(F.count("*").alias("n"))
    drawn = cells.sparkSession.range(draws).join(F.broadcast(n), how="cross").select(F.col("id").alias("draw"), _place(F.concat(F.lit(f"{seed}:draw:"), F.col("id").cast("string")), F.col("n")).cast("long").alias("at"))
    return drawn.join(ranked, "at").select("draw", "cell")


def numbered(rows: DataFrame, h: str, name: str) -> DataFrame:
    """rows numbered from 0 in the order of a hash in hexadecimal; no task holds them all, but those of one of 4096 beginnings."""
    rows = rows.withColumn("_part", F.substring(h, 1, 3))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(h))
    return rows.withColumn("_in", inside).join(base, "_part").withColumn(name, F.col("_base") + F.col("_in") - 1).drop("_part", "_n", "_base", "_in")


def csr_offsets(nonzeros: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, cell_idx) to cell_idx, nnz, begin: where each cell's nonzeros begin in row order."""
    n = nonzeros.groupBy("cell").agg(F.count("*").alias("nnz"))
    rows = cells.join(n, "cell", "left").select("cell_idx", F.coalesce("nnz", F.lit(0)).alias("nnz"))
    # a running sum in two steps, so that no task holds all cells
    rows = rows.withColumn("part", F.floor(F.col("cell_idx") / 4096))
    own = Window.partitionBy("part").orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").agg(F.sum("nnz").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    return rows.withColumn("inside", F.sum("nnz").over(own)).join(base, "part").select("cell_idx", "nnz", (F.col("base") + F.col("inside") - F.col("nnz")).alias("begin"))


def control_profile(counts: DataFrame, *by: str) -> DataFrame:
    """Share of each gene in the counts of a group."""
    sums = counts.groupBy(*by, "gene").agg(F.sum("cnt").alias("s"))
    return sums.select(*by, "gene", (F.col("s") / F.sum("s").over(Window.partitionBy(*by))).alias("share"))
