"""Counts in blocks of cells, in compressed rows, for reads of some cells on some genes.

A folder: blocks/ (part=.../: block, offsets, columns, values; a row holds SIDE cells), cells/ (cell, cell_idx, part, block, start in the block, nnz) and
genes/ (gene, gene_idx). A reader finds the wanted cells' blocks in the table of cells; only the folders and row groups that hold these are opened,
as Spark prunes partitions by the join and skips row groups by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.operators.cohorts import with_index
from deltaloom.operators.numbering import by_range
from deltaloom.session import dealt, materialize, small

#: Cells of a block, and blocks of a folder.
SIDE, FOLDER = 256, 256


def write_blocks(counts: DataFrame, cells: DataFrame, path: str, side: int = SIDE, folder: int = FOLDER) -> None:
    """counts (cell, gene, cnt; no repeated pairs) of cells (cell) in the order of the cells' ids; cells without counts have empty rows, counts of other cells are left out."""
    spark = counts.sparkSession
    numbered = by_range(cells.select("cell").distinct(), ["cell"], "cell_idx")
    genes = with_index(counts, "gene", "gene_idx")
    genes.coalesce(1).write.parquet(f"{path}/genes")
    genes = spark.read.parquet(f"{path}/genes")
    placed = materialize(numbered.withColumn("block", F.floor(F.col("cell_idx") / side).cast("long")).withColumn("part", F.floor(F.col("block") / folder).cast("int")), "numbered")
    # folders are alike in cells, so a task for each has as much to do in a large store as in a small one
    folders = placed.count() // (side * folder) + 1
    own = counts.select("cell", "gene", "cnt").join(small(genes), "gene").select("cell", "gene_idx", "cnt")
    sums = dealt(own, folders, "cell").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("gene_idx", "cnt"))).alias("x"))
    # every cell has a row, empty or not; a block's rows are then laid end to end
    rows = placed.join(sums, "cell", "left").select("part", "block", "cell_idx", F.coalesce("x", F.array().cast(sums.schema["x"].dataType)).alias("x"))
    packed = dealt(rows, folders, "part").groupBy("part", "block").agg(F.sort_array(F.collect_list(F.struct("cell_idx", "x"))).alias("r"))
    ends = F.aggregate(F.transform("r", lambda r: F.size(r["x"])), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    flat = F.flatten(F.transform("r", lambda r: r["x"]))
    blocks = packed.select("part", "block", ends.alias("offsets"), F.transform(flat, lambda e: e["gene_idx"]).alias("columns"), F.transform(flat, lambda e: e["cnt"]).alias("values"))
    blocks.sortWithinPartitions("part", "block").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/blocks")
    written = spark.read.parquet(f"{path}/blocks").select("block", F.posexplode(F.slice("offsets", 1, F.size("offsets") - 1)).alias("nth", "start"), "offsets")
    begun = written.select((F.col("block") * side + F.col("nth")).alias("cell_idx"), "start", (F.element_at("offsets", F.col("nth") + 2) - F.col("start")).alias("nnz"))
    placed.join(begun, "cell_idx").select("cell", "cell_idx", "part", "block", "start", "nnz").repartitionByRange("cell_idx").sortWithinPartitions("cell_idx").write.parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str, wanted: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """cell, cell_idx, gene, cnt of the wanted cells (cell), on some genes (gene) or all."""
    found = spark.read.parquet(f"{path}/cells").join(small(wanted.select("cell").distinct()), "cell")
    # a block is opened once, for all of its cells that are wanted
    asked = found.groupBy("part", "block").agg(F.collect_list(F.struct("cell", "cell_idx", "start", "nnz")).alias("asked"))
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(asked) if _few(asked) else asked, ["part", "block"])
    each = blocks.select(F.explode("asked").alias("a"), "columns", "values")
    cut = lambda c: F.slice(c, F.col("a.start") + 1, F.col("a.nnz"))
    rows = each.select("a.cell", "a.cell_idx", F.inline(F.arrays_zip(cut("columns").alias("gene_idx"), cut("values").alias("cnt"))))
    axis = spark.read.parquet(f"{path}/genes")
    axis = axis if genes is None else axis.join(small(genes.select("gene").distinct()), "gene", "left_semi")
    return rows.join(small(axis), "gene_idx").select("cell", "cell_idx", "gene", "cnt")


#: Blocks whose wanted cells may be broadcast; a block has SIDE cells of a few numbers at most.
_FEW = 10_000


def _few(asked: DataFrame) -> bool:
    return asked.limit(_FEW + 1).count() <= _FEW


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """cell_idx, nnz, begin: where each cell's counts begin among all, in order."""
    cells = spark.read.parquet(f"{path}/cells")
    blocks = cells.groupBy("block").agg(F.sum("nnz").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    base = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return cells.join(small(base), "block").select("cell_idx", "nnz", (F.col("base") + F.col("start")).alias("begin"))
