"""The driver's star schema as cells x genes counts.

An order is a cell; its customer's nation the perturbed target (nation 0: the
control), its market segment the batch, its priority the guide; the supplier's
nation is the gene and the quantity ordered the count. Genes and targets have
identifiers as real ones are: text, of the prefix and length of mapped genes. Orders before SPLIT are
line A (training), later ones line B (held out). Some targets and genes are cut
so that both lines have something of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.functions.expr import ID_LENGTH, PREFIX
from deltaloom.session import dealt, materialize, tasks_of

CONTROL = "non-targeting"
SPLIT = "1998-04-01"
TRAIN, HELD = "A", "B"


def ensembl(number: int) -> str:
    return f"{PREFIX}{number:0{ID_LENGTH - len(PREFIX)}}"


UNSEEN_TARGETS = tuple(map(ensembl, (7, 15, 23)))
CUT_GENES = {TRAIN: tuple(map(ensembl, (3, 11))), HELD: (ensembl(5),)}


def gene_of(nation: str) -> Column:
    """The identifier of a nation as a gene."""
    return F.concat(F.lit(PREFIX), F.lpad(F.col(nation).cast("string"), ID_LENGTH - len(PREFIX), "0"))


def target_of(nation: str) -> Column:
    return F.when(F.col(nation) == 0, CONTROL).otherwise(gene_of(nation))


@dataclass
class Cells:
    """cells: line, target, batch, guide, cell, lib. counts: those and gene, cnt. rows: both, as pseudobulk.rows_of(), from one scan."""

    cells: DataFrame
    counts: DataFrame
    rows: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene, cnt over all genes, dealt out by cell, so that what follows by cell needs no other shuffle."""
    lines = table(spark, sf_dir, "lineitem")
    items = lines.select("l_orderkey", "l_suppkey", "l_quantity")
    genes = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    own = items.join(genes, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("cell"), "s_nationkey", "l_quantity")
    sums = dealt(own, tasks_of(lines), "cell").groupBy("cell", "s_nationkey").agg(F.sum("l_quantity").alias("cnt"))
    return sums.select("cell", gene_of("s_nationkey").alias("gene"), "cnt")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, target, batch, guide, cell of every order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", target_of("c_nationkey").alias("target"), "c_mktsegment")
    line = F.when(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp_ntz"), TRAIN).otherwise(HELD)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        line.alias("line"), "target", F.col("c_mktsegment").alias("batch"), F.col("o_orderpriority").alias("guide"), F.col("o_orderkey").alias("cell")
    )


def cells(spark: SparkSession, sf_dir: str, written: bool = False) -> Cells:
    """Cells with a library (that of all genes, cut or not) and their counts on their line's genes. written: all are made once, as a table, for many reads."""
    own = Window.partitionBy("cell").orderBy("gene")
    library = F.sum("cnt").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    raw = raw_counts(spark, sf_dir).withColumns({"lib": library, "first": F.row_number().over(own) == 1})
    obs = observations(spark, sf_dir).where(~((F.col("line") == TRAIN) & F.col("target").isin(*UNSEEN_TARGETS)))
    joined = obs.join(raw, "cell")
    if written:
        joined = materialize(joined, "observed")
    keys = ["line", "target", "batch", "guide", "cell", "lib"]
    keep = F.lit(True)
    for line, genes in CUT_GENES.items():
        keep = keep & ~((F.col("line") == line) & F.col("gene").isin(*genes))
    one = F.struct("gene", "cnt")
    mark = F.struct(F.lit(None).cast("string").alias("gene"), F.lit(None).cast("double").alias("cnt"))
    rows = joined.select("line", "target", "batch", "lib", "guide", F.inline(F.when(F.col("first"), F.array(one, mark)).otherwise(F.array(one))))
    rows = rows.where(F.col("gene").isNull() | keep).withColumn("guide", F.when(F.col("gene").isNull(), F.col("guide")))
    return Cells(joined.where("first").select(*keys), joined.where(keep).select(*keys, "gene", "cnt"), rows)
