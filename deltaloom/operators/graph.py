"""A weighted gene graph from protein aliases and links, and features of a gene's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.expr import is_mapped, missing_flag, scaled_score


def mapped_aliases(aliases: DataFrame) -> DataFrame:
    """(protein, gene) rows whose alias is a gene's identifier: a protein has symbols and names of other kinds too."""
    return aliases.where(is_mapped("gene"))


def gene_of_protein(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(protein, gene: any alias) to protein, gene, for proteins with one gene only, that is wanted."""
    one = mapped_aliases(aliases).groupBy("protein").agg(F.min("gene").alias("gene"), F.max("gene").alias("other")).where("gene = other")
    return one.select("protein", "gene").join(wanted.select("gene").distinct(), "gene", "left_semi")


def ambiguous_proteins(aliases: DataFrame) -> DataFrame:
    return mapped_aliases(aliases).groupBy("protein").agg(F.countDistinct("gene").alias("n_genes")).where("n_genes > 1")


def build_graph(aliases: DataFrame, links: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """src < dst, w: undirected edges between wanted genes, the strongest link of each pair (protein1, protein2, score)."""
    genes = gene_of_protein(aliases, wanted)
    ends = [genes.select(F.col("protein").alias(f"protein{i}"), F.col("gene").alias(f"gene{i}")) for i in (1, 2)]
    mapped = links.where(F.col("score") >= threshold).join(ends[0], "protein1").join(ends[1], "protein2").where("gene1 <> gene2")
    return mapped.groupBy(F.least("gene1", "gene2").alias("src"), F.greatest("gene1", "gene2").alias("dst")).agg(F.max(scaled_score("score")).alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").union(edges.select(F.col("dst"), F.col("src"), "w"))


def graph_report(edges: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: edges, wanted genes without one, mapped genes, ambiguous proteins."""
    wanted = wanted.select("gene").distinct()
    linked = both_ways(edges).select(F.col("src").alias("gene")).distinct()
    parts = [
        edges.agg(F.count("*").alias("n_edges")),
        wanted.join(linked, "gene", "left_anti").agg(F.count("*").alias("n_isolated")),
        gene_of_protein(aliases, wanted).agg(F.countDistinct("gene").alias("n_mapped")),
        ambiguous_proteins(aliases).agg(F.count("*").alias("n_ambiguous")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, how="cross")  # single rows
    return out


def induced(edges: DataFrame, some: DataFrame) -> DataFrame:
    """Edges between some genes only."""
    s = some.select("gene").distinct()
    return edges.join(s.withColumnRenamed("gene", "src"), "src", "left_semi").join(s.withColumnRenamed("gene", "dst"), "dst", "left_semi")


def neighbour_features(edges: DataFrame, queries: DataFrame, scores: DataFrame) -> DataFrame:
    """queries (gene, x), scores (gene, k, score) of reference genes to gene, k, basal, is_missing, log_support, prior.

    A query's neighbours don't include itself; without any the prior is 0.
    """
    near = both_ways(edges).join(scores.select(F.col("gene").alias("dst"), "k", "score"), "dst").where("src <> dst")
    prior = near.groupBy(F.col("src").alias("gene"), "k").agg(F.count("*").alias("support"), F.try_divide(F.sum(F.col("w") * F.col("score")), F.sum("w")).alias("prior"))
    grid = queries.join(F.broadcast(scores.select("k").distinct()), how="cross").join(prior, ["gene", "k"], "left")
    return grid.select("gene", "k", F.col("x").alias("basal"), missing_flag("x").alias("is_missing"), F.log1p(F.coalesce("support", F.lit(0))).alias("log_support"), F.coalesce("prior", F.lit(0.0)).alias("prior"))


def neighbour_vectors(edges: DataFrame, queries: DataFrame, scores: DataFrame) -> DataFrame:
    """queries (gene, x), scores (gene, component, z) of reference genes to gene, basal, is_missing, log_support and one prior for each component.

    The graph times the matrix of scores: a reference gene's scores travel as one
    array, edges add up partial sums of all components at once, a gene's before they are shuffled. A query's neighbours
    don't include itself; without any the priors are 0, the mean of centred scores.
    """
    rank = scores.agg(F.coalesce(F.max("component") + 1, F.lit(0))).head()[0]
    at = lambda c: F.sum(F.when(F.col("component") == c, F.col("z")))
    wide = scores.groupBy(F.col("gene").alias("dst")).agg(F.array(*(at(c) for c in range(rank))).alias("zs"))
    near = both_ways(edges).join(wide, "dst").where("src <> dst")
    sums = near.groupBy(F.col("src").alias("gene")).agg(F.count(F.when(F.col("w") > 0, 1)).alias("support"), F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col("zs")[c]).alias(f"s{c}") for c in range(rank)))
    priors = (F.coalesce(F.try_divide(f"s{c}", "w"), F.lit(0.0)).alias(f"prior{c}") for c in range(rank))
    return queries.join(sums, "gene", "left").select("gene", F.col("x").alias("basal"), missing_flag("x").alias("is_missing"), F.log1p(F.coalesce("support", F.lit(0))).alias("log_support"), *priors)
