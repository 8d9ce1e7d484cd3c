"""Scalar expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALIZATION = 1e4
# Identifiers that mean "none", in lower case, and the prefix and length of mapped ones.
MISSING = ("", "nan", "none")
PREFIX, ID_LENGTH = "ENSG", 15
UNMAPPED = "UNMAPPED:"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, as engines differ in the last bits; never -0.0."""
    return F.round(col(c), 6) + F.lit(0.0)


def log_norm(count: Column | str, library: Column | str, scale: float = NORMALIZATION) -> Column:
    return F.log1p(col(count) * F.lit(scale) / col(library))


def is_missing(identifier: Column | str) -> Column:
    return F.coalesce(F.lower(col(identifier)).isin(*MISSING), F.lit(True))


def is_mapped(identifier: Column | str) -> Column:
    return col(identifier).startswith(PREFIX) & (F.length(col(identifier)) == ID_LENGTH)


def target_id(identifier: Column | str, symbol: Column | str) -> Column:
    """The identifier, or a sentinel with the symbol where there is none, so that such targets stay apart."""
    return F.when(is_missing(identifier), F.concat(F.lit(UNMAPPED), col(symbol))).otherwise(col(identifier))


def is_padded(text: Column | str) -> Column:
    return F.trim(col(text)) != col(text)


def last_part(text: Column | str, separator: str) -> Column:
    """What follows the last separator."""
    return F.substring_index(col(text), separator, -1)


def scaled_score(score: Column | str) -> Column:
    """Link scores are kept as single-precision thousandths."""
    return (col(score) / 1000).cast("float")


def finite_or_null(x: Column | str) -> Column:
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def missing_flag(x: Column | str) -> Column:
    return finite_or_null(x).isNull().cast("int")


def standardized(x: Column | str, median: Column | str, mean: Column | str, scale: Column | str) -> Column:
    return (F.coalesce(finite_or_null(x), col(median)) - col(mean)) / col(scale)


def damped(offset: Column, error: Column, rate: float, step: float, most: float) -> Column:
    """offset moved by a bounded share of the error, itself kept in bounds."""
    moved = offset + F.greatest(F.least(F.lit(rate) * error, F.lit(step)), F.lit(-step))
    return F.greatest(F.least(moved, F.lit(most)), F.lit(-most))


def rate(profile: Column, delta: Column) -> Column:
    """A log profile moved by delta, clipped at zero, as a rate."""
    return F.expm1(F.greatest(profile + delta, F.lit(0.0)))


def outside_mass(library: Column | str, panel_sum: Column | str, scale: float = NORMALIZATION) -> Column:
    return (col(library) - col(panel_sum)) * F.lit(scale) / col(library)


def cell_name(index: Column | str) -> Column:
    return F.format_string("pred_%09d", col(index))
