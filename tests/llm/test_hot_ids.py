"""Rows without an id and rows of one id, many of them."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracles import same

from deltaloom.llm import mixing, quality, registry, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "an", "er", "on", "ing", "re"], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(0)
    rows = [(i, prose(rng, int(rng.integers(5, 60))), "en", "web", 3) for i in range(40)]
    rows += [(None, prose(rng, 8), "en", "web", 3) for _ in range(5000)] + [(7, f"row {i} of one id", "en", "web", 3) for i in range(20_000)]
    return spark.createDataFrame(rows, DOCS).repartition(6).cache()


def test_quality_learns_from_a_bounded_sample(spark, hot, monkeypatch):
    seen = []
    plain = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda text, meta, y, *a: seen.append((len(y), int((y < 0).sum()))) or plain(text, meta, y, *a))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    quality.train(hot, labels)
    # 20 labelled ids and 20 others, none of them null, each once
    assert seen == [(40, 20)]
    without = hot.where("doc_id is not null")
    models = [quality.score_quality(without.where("doc_id <> 7"), quality.train(x.repartition(n), labels)).orderBy("doc_id").collect() for x, n in ((hot, 3), (without, 5))]
    assert models[0] == models[1]


def test_toxicity_learns_from_a_bounded_sample(spark, hot):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, toxic int")
    sample = toxicity.sample_of(hot, labels, "toxic")
    assert sample.count() == 40
    again = toxicity.sample_of(hot.repartition(9), labels, "toxic")
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, again.collect()))


def test_mix_of_rows_without_ids_is_random(spark):
    rows = [(None, " ".join(["w"] * n), "a") for n in range(1, 401)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # half of the one source's size
    found = mixing.mix_sources(docs, None, (1.0,), 0.5, 2.0).collect()
    sizes = sorted(r["size"] for r in found if r["chosen"])
    target = found[0]["target"]
    assert abs(sum(sizes) - target) <= 400 and len(found) == 400
    # not the smallest ones first: about half of the short and of the long documents
    assert 60 < sum(s <= 200 for s in sizes) < 140 and 60 < sum(s > 200 for s in sizes) < 140


@pytest.mark.parametrize("together", [10_000, 7])
def test_mix_of_many_equal_rows(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(mixing, "TOGETHER", together)
    rows = [(3, "w w w", "a")] * 3000 + [(None, "x", "a")] * 3000 + [(None, None, None)] * 500 + [(i, "v " * (i % 9), "b") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0), (5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    same(spark, tmp_path, "op4_mixing", ("documents", "labels"))
    counts = Counter(r["taken"] for r in registry.op4_mixing(spark, str(tmp_path)).where("doc_id = 3").collect())
    assert sum(counts.values()) == 3001 and len(counts) <= 2


def test_dedup_of_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 50)  # many buckets, most of them empty
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, f"a b {text}")] + [(None, text)] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(docs).collect())
    assert found == {(1, 80, 0): 1, (2, 82, 80): 1, (None, 80, 0): 3000}
    sizes = [r["count"] for r in docs.withColumn("db", F.pmod(F.monotonically_increasing_id(), F.lit(10))).groupBy("db").count().collect()]
    assert max(sizes) < 1000
