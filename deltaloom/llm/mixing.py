"""Mixing sources to target weights (native).

Efraimidis-Spirakis sampling: each document gets the key -ln(u) / weight with u
hashed from its id and text; sorted by key within its source, sizes are summed up to the
source's token budget. Whole epochs over the source come before the fraction.

The running sum of a source, which may hold a third of all rows, is made of two
parts: the sums of SLICES ranges of the key, and a running sum inside a range.
No task holds a whole source.

Targets are worked out over one row for each source, in one task: a corpus has far
fewer sources than that bounds.

Defined results: null text has size 0; a null source is a source of its own, the
last; rows with a null or a repeated doc_id have keys by their texts, a null text's being that of none; rows of one id and text
have one key, and stand next to each other in the sum, smaller sizes first; equal ones are counted and
told apart by arithmetic only, so they may be many; texts of any length count whole; a source of size 0 has target 0; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.session import materialize

SLICES = 4096
#: Equal rows that one task spells out.
TOGETHER = 10_000
#: Of sources in order, repeating; what the targets share of all sizes, and the most of its own size a source gives.
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
SEED = 20260
#: Quality weights of documents by label: good, poor; documents without a label weigh 1.
GOOD, POOR = 2.0, 0.5


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.coalesce(F.size(words), F.lit(0)).cast("long")


def uniform(key: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the key and the text alone, so that reruns and other engines agree: the first 52 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.sha2(text, 256), F.lit(""))), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(2.0**52)


def water_fill(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) with target: share of all sizes dealt by weight, none above cap times its size.

    Dealing the excess anew by weight until none is above gives each source
    min(cap * size, level * weight) with one level for all; the level is that
    of the first source, by cap / weight, that stays below its cap (taking later
    ones as first gives lower levels).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(cap))
    all_, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", left / rest)
    s = s.withColumn("level", F.coalesce(F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(all_), F.lit(float("inf"))))
    return s.select("source", "source_size", F.when(F.col("source_size") > 0, F.least(F.col("cap"), F.col("level") * F.col("w"))).otherwise(F.lit(0.0)).alias("target"))


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, chosen, taken for each row of docs (doc_id, source, text).

    quality: (doc_id, weight) with positive weights; others weigh 1. carry: columns
    of docs that are returned too, and break what ties are left, in this order.
    """
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), *carry)
    # equal rows are one with a number, before they are shuffled
    base = base.groupBy("doc_id", "source", "size", "u", *carry).agg(F.count("*").alias("n"))
    if quality is not None:
        q = quality.groupBy("doc_id").agg(F.max("weight").alias("weight")).where("doc_id is not null")
        # rows without an id match none, and may be many: a number that no weight has deals them out
        apart = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("u"), F.lit(1000))).otherwise(F.lit(0).cast("long"))
        base = base.withColumns({"of_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "apart": apart})
        q = q.select(F.col("doc_id").cast("string").alias("of_id"), F.lit(0).cast("long").alias("apart"), "weight")
        base = base.join(q, ["of_id", "apart"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        base = base.withColumn("weight", F.lit(1.0))
    base = materialize(base.select("doc_id", "source", "size", "n", (-F.log("u") / F.col("weight")).alias("key"), *carry), "mix")
    base = base.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * SLICES).cast("int"))
    slices = base.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("n")).alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    targets = water_fill(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    per_slice = slices.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("source_"), F.col("slice").alias("slice_"), "before", "source_size", "target", "epochs", "budget"
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("inside", F.sum(F.col("size") * F.col("n")).over(inside))
    rows = rows.join(per_slice, F.col("source").eqNullSafe(F.col("source_")) & (F.col("slice") == F.col("slice_")))
    rows = rows.withColumn("start", F.col("before") + F.col("inside") - F.col("size") * F.col("n"))
    spelt = rows.where(F.col("n") <= TOGETHER).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    # many equal rows are spelt out by several tasks
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TOGETHER))
    many = rows.where(F.col("n") > TOGETHER).withColumn("part", F.explode(parts)).repartition("part", "key")
    first, last = F.col("part") * TOGETHER + 1, F.least((F.col("part") + 1) * TOGETHER, F.col("n"))
    rows = spelt.unionByName(many.withColumn("nth", F.explode(F.sequence(first, last))).drop("part"))
    end = F.col("start") + F.col("size") * F.col("nth")
    # the document at the edge is chosen if that comes nearer to the budget
    chosen = (end <= F.col("budget")) | (end - F.col("budget") < F.col("budget") - (end - F.col("size")))
    rows = rows.withColumn("chosen", chosen)
    taken = F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "chosen", taken.alias("taken"), *carry)


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) labels as weights of documents."""
    return labels.where(F.col("quality").isNotNull()).select("doc_id", F.when(F.col("quality") == 1, F.lit(GOOD)).otherwise(F.lit(POOR)).alias("weight"))
