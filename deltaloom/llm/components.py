"""Connected components of links between 64-bit ids, by contraction, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.session import materialize


def _labels(edges: DataFrame) -> DataFrame:
    """of, label: the id of the smallest hash among each id and its neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    low = both.groupBy(F.col("a").alias("of")).agg(F.min_by("b", F.xxhash64("b")).alias("low"))  # of plain numbers, so that it is a hash aggregate
    return low.select("of", F.when(F.xxhash64("of") <= F.xxhash64("low"), F.col("of")).otherwise(F.col("low")).alias("label"))


def connected_components(links: DataFrame, most: int) -> DataFrame:
    """(a, b) to (id, component) for each id in a link; the component's name is one of its ids.

    In each round every id takes as its label the id of the smallest hash among itself
    and its neighbours, and links are contracted to links between labels: the order
    of ids doesn't matter, so long chains take rounds in the order of the logarithm
    of their length. most: a bound of the number of links.
    """
    rounds = [materialize(links.where("a != b").select("a", "b").distinct(), "links", most)]
    while not rounds[-1].isEmpty():
        edges = rounds[-1]
        label = _labels(edges)
        for end in ("a", "b"):
            edges = edges.join(label.withColumnsRenamed({"of": f"of_{end}", "label": f"label_{end}"}), F.col(end) == F.col(f"of_{end}"))
        edges = edges.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a != b").distinct()
        rounds.append(materialize(edges, "links", most))
    names = _labels(rounds[0]).withColumnsRenamed({"of": "id", "label": "component"})
    for edges in rounds[1:-1]:
        names = names.join(_labels(edges), F.col("component") == F.col("of"), "left").select("id", F.coalesce("label", "component").alias("component"))
    return materialize(names, "names", 2 * most)
