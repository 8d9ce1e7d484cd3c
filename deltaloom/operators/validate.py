"""Rules, each as a query for what breaks it; require() turns rows into an error.

Nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.expr import PREFIX, is_missing, is_padded


class Violation(ValueError):
    """Data break a rule."""


def require(violations: DataFrame, rule: str) -> None:
    """Raise if there are any, with the first few."""
    if rows := violations.limit(3).collect():
        raise Violation(f"{rule}: {[r.asDict() for r in rows]}")


def bad_counts(counts: DataFrame, most: float | None = None) -> DataFrame:
    """(cell, gene, cnt): counts that aren't finite whole numbers of 0 or more, and cells above most in all."""
    x = F.col("cnt").cast("double")
    reason = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "finite").when(x < 0, "negative").when(x != F.floor(x), "whole")
    found = counts.select("cell", "gene", reason.alias("reason")).where("reason is not null")
    if most is None:
        return found
    totals = counts.where(~F.isnan(F.col("cnt").cast("double"))).groupBy("cell").agg(F.sum("cnt").alias("total")).where(F.col("total") > most)
    return found.unionByName(totals.select("cell", F.lit(None).cast(dict(counts.dtypes)["gene"]).alias("gene"), F.lit("total").alias("reason")))


def above_library(counts: DataFrame, slack: float = 0.0) -> DataFrame:
    """Cells whose counts sum to more than their library, or whose library isn't positive."""
    sums = counts.groupBy("cell").agg(F.sum("cnt").alias("panel"), F.first("lib").alias("lib"))
    return sums.where((F.col("panel") > F.col("lib") + slack) | ~(F.col("lib") > 0)).select("cell", "panel", "lib")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def bad_identifiers(targets: DataFrame) -> DataFrame:
    """(identifier, symbol): neither given, or an identifier of another kind."""
    missing = is_missing("identifier")
    reason = F.when(missing & is_missing("symbol"), "blank").when(~missing & ~F.col("identifier").startswith(PREFIX), "kind")
    return targets.select("identifier", "symbol", reason.alias("reason")).where("reason is not null").distinct()


def control_disagreement(targets: DataFrame, label: str) -> DataFrame:
    """Rows where only one of identifier and symbol is the control's label."""
    return targets.where((F.col("identifier") == label) != (F.col("symbol") == label))


def too_few_controls(groups: DataFrame, control: str | int, least: int) -> DataFrame:
    """Batches with cells of a line but fewer than least controls."""
    n = F.coalesce(F.sum(F.when(F.col("target") == control, F.col("n"))), F.lit(0))
    return groups.groupBy("line", "batch").agg(n.alias("n_control")).where(F.col("n_control") < least)


def bad_names(names: DataFrame, column: str, size: int | None = None, forbidden: str | None = None) -> DataFrame:
    """A list of names: nulls, repeats, padding, the forbidden one; and the wrong size, as one row."""
    c = F.col(column)
    reason = F.when(c.isNull(), "null").when(is_padded(c), "padded")
    if forbidden is not None:
        reason = reason.when(c == forbidden, "control")
    out = names.select(c.alias("name"), reason.alias("reason")).where("reason is not null")
    out = out.unionByName(repeated(names.where(c.isNotNull()), column).select(F.col(column).alias("name"), F.lit("repeated").alias("reason")))
    if size is not None:
        n = names.agg(F.count("*").alias("n")).where(F.col("n") != size)
        out = out.unionByName(n.select(F.col("n").cast("string").alias("name"), F.lit("size").alias("reason")))
    return out


def axis_difference(found: DataFrame, expected: DataFrame, name: str, index: str) -> DataFrame:
    """Places where two ordered axes differ."""
    a, b = found.select(index, F.col(name).alias("found")), expected.select(index, F.col(name).alias("expected"))
    return a.join(b, index, "full").where(~F.col("found").eqNullSafe(F.col("expected")))


def panel_difference(found: DataFrame, expected: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Groups that a prediction lacks, has beyond the panel, or has with another number of cells than size."""
    n = found.groupBy(*keys).agg(F.count("*").alias("n"))
    both = n.join(expected.select(*keys).distinct().withColumn("wanted", F.lit(True)), keys, "full")
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("n") != size, "size")
    return both.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), reason.alias("reason")).where("reason is not null")


def stored_zeros(nonzeros: DataFrame) -> DataFrame:
    return nonzeros.where("cnt = 0")


def too_many_nonzeros(nonzeros: DataFrame, most: int) -> DataFrame:
    return nonzeros.agg(F.count("*").alias("n")).where(F.col("n") > most)


def bad_controls(cells: DataFrame, label: str | int, *by: str) -> DataFrame:
    """Control files, named by the columns by, as one row each of what they should hold: cells, one context, controls only, counts."""
    found = cells.groupBy(*by).agg(
        F.count("*").alias("n_cells"), F.countDistinct("context").alias("n_contexts"), F.count(F.when(F.col("target") != label, 1)).alias("n_others"), F.coalesce(F.sum("lib"), F.lit(0.0)).alias("total")
    )
    return found.where("n_cells = 0 or n_contexts <> 1 or n_others > 0 or total <= 0")


def missing_columns(rows: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n not in rows.columns]


def require_columns(rows: DataFrame, *names: str) -> None:
    if lacking := missing_columns(rows, *names):
        raise Violation(f"columns are missing: {lacking}")


def not_finite(rows: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.where(bad)


def incomplete(long: DataFrame, rows: DataFrame, columns: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column) pairs of two axes that a long table lacks."""
    return rows.select(row).distinct().join(columns.select(column).distinct(), how="cross").join(long.select(row, column), [row, column], "left_anti")
