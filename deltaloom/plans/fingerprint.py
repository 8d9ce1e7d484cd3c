"""Digests of tables, whatever their files, partitions and order of rows or columns; maps inside other values keep their order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, VariantType

#: Hexadecimal digits of a row's SHA-256 that make up one of its two numbers.
DIGITS = 15


def _said(name: str, kind: DataType) -> Column:
    """A value as text, its length before it, so that no two rows are written alike; null as such."""
    c = F.col(f"`{name}`")
    if isinstance(kind, MapType):
        c = F.sort_array(F.transform(F.map_entries(c), lambda e: F.to_json(F.struct(e.alias("e")), {"ignoreNullFields": "false"})))
    if isinstance(kind, ArrayType | MapType | StructType | VariantType):
        c = F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}))
    elif isinstance(kind, BinaryType):
        c = F.hex(c)
    else:
        c = c.cast("string")
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("null"))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row, in hexadecimal; columns by name."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.sha2(F.concat_ws(",", F.lit(""), *(_said(f.name, f.dataType) for f in fields)), 256)


def digests(df: DataFrame) -> DataFrame:
    """One row: n, a and b, the sums over all rows of two numbers of a row's digest. Sums don't depend on order, and count repeated rows."""
    h = row_digest(df)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), *(F.coalesce(part(k), F.lit(0)).cast("string").alias(c) for k, c in enumerate("ab")))


def fingerprint(df: DataFrame) -> dict[str, object]:
    """Columns, rows and digest of a table: equal for equal tables, however they are stored."""
    row = digests(df).head()
    columns = {f.name: f.dataType.simpleString() for f in sorted(df.schema.fields, key=lambda f: f.name)}
    return {"columns": columns, "rows": row["n"], "digest": f"{row['a']}-{row['b']}"}


def fingerprints(tables: Mapping[str, DataFrame]) -> dict[str, dict[str, object]]:
    return {name: fingerprint(df) for name, df in tables.items()}


def manifest(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """name, rows, digest of tables, to be kept beside them."""
    rows = [(name, f["rows"], f["digest"]) for name, f in fingerprints(tables).items()]
    return spark.createDataFrame(rows, "name string, rows long, digest string")


def changed(manifest_rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """name, rows, digest, found_rows, found_digest of tables that aren't as the manifest has them, or that it hasn't."""
    found = manifest(manifest_rows.sparkSession, tables).select("name", F.col("rows").alias("found_rows"), F.col("digest").alias("found_digest"))
    same = F.col("rows").eqNullSafe(F.col("found_rows")) & F.col("digest").eqNullSafe(F.col("found_digest"))
    return found.join(manifest_rows.select("name", "rows", "digest"), "name", "left").where(~same).select("name", "rows", "digest", "found_rows", "found_digest")
