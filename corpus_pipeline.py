"""A training corpus from documents: STAGES, each one's rows written and read again by the next.

Rows keep the columns of documents until the last stage, which adds how often
and with how many words the mix takes each document, and drops those it
doesn't take. Defined results: a null text is empty; rows that repeat a doc_id
are told apart by their texts, and of those with one text or near copies of it
one stays; rows with a null doc_id have no copies; of equal rows (ties) any stays,
as they are the same; texts of any length are read whole; empty tables give no rows;
other columns are kept, whatever their names, but for mix_copies, mix_words and
mix_target, which the last stage replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm import decontaminate, jaccard_join, mixing, quality, secrets
from deltaloom.session import materialize, ship_code

#: Some stages are learned classifiers or similarity joins, which SQL doesn't express.
ORACLE_SQL: str | None = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns of a row, and of which are null, which the hash skips."""
    return F.xxhash64(F.lit(seed), *docs.columns, *(F.col(c).isNull() for c in docs.columns))


def _prefix(docs: DataFrame, start: str) -> str:
    """Where names begin that no column of docs has."""
    while any(c.lower().startswith(start) for c in docs.columns):
        start = f"x{start}"
    return start


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier rejects."""
    ship_code(spark)
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: of the smallest doc_id, and of several with this one the smallest set and hash."""
    ship_code(spark)
    near_row = _prefix(docs, "near_") + "row"
    named = docs.withColumn(near_row, _digest(docs, 0))
    found = materialize(jaccard_join.components(named.select("doc_id", "text", F.col(near_row).alias("row"))), "components")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        lost = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
        return docs.join(materialize(lost, "lost"), "doc_id", "left_anti").select(*docs.columns)
    # an id may have texts of several components, so rows decide; equal rows are one
    heads = found.where("doc_id is not null and (n_shingles = 0 or (component_id = doc_id and sid = head_sid))")
    heads = materialize(heads.groupBy("doc_id", "sid").agg(F.min("row").alias(near_row)).select("doc_id", near_row), "heads")
    known = named.where("doc_id is not null").dropDuplicates(["doc_id", near_row]).join(heads, ["doc_id", near_row], "left_semi")
    return known.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark."""
    ship_code(spark)
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    ship_code(spark)
    return secrets.redact_secrets(docs, secrets.train(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with mix_copies (how often), mix_words (in all) and mix_target (of the source)."""
    docs = docs.drop("mix_copies", "mix_words", "mix_target")
    names, p = docs.columns, _prefix(docs, "mix_")
    # ids may be null or repeat, so rows are named by what they hold; equal ones are told apart by number
    row = [f"{p}row", f"{p}row2"]
    docs = docs.withColumns({c: _digest(docs, i) for i, c in enumerate(row)})
    mixed = mixing.mix_sources(docs, mixing.quality_weights(_table(spark, sf_dir, "labels")), carry=tuple(row))
    first = (F.first(c).alias(f"{p}{c}") for c in ("size", "epochs", "target"))
    mixed = mixed.groupBy(*row).agg(*first, F.sum(F.col("chosen").cast("long")).alias(f"{p}chosen")).where(F.col(f"{p}epochs") + F.col(f"{p}chosen") > 0)
    nth = F.row_number().over(Window.partitionBy(*row).orderBy(F.lit(0)))
    taken = docs.withColumn(f"{p}nth", nth).join(mixed, row)
    copies = F.col(f"{p}epochs") + (F.col(f"{p}nth") <= F.col(f"{p}chosen")).cast("long")
    taken = taken.withColumn(f"{p}copies", copies).where(F.col(f"{p}copies") > 0)
    words = (F.col(f"{p}size") * F.col(f"{p}copies")).alias("mix_words")
    return taken.select(*names, F.col(f"{p}copies").alias("mix_copies"), words, F.col(f"{p}target").alias("mix_target"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
