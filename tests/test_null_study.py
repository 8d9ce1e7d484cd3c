import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from deltaloom.operators.validate import Violation
from deltaloom.plans import studies

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def test_null_study(spark, tmp_path):
    out = f"file:{tmp_path}/a"
    found = studies.run_null(spark, SF, out, replicates=20, depth=500)
    report = json.loads((tmp_path / "a/report.json").read_text())
    assert report["cells"] == found["cells"] and report["counts"] == 500 * found["cells"] and all(f["agrees"] for f in report["fit"])
    assert report["entries"] == pytest.approx(report["expected_entries"], rel=0.02) and report["prediction"]["rows"] == report["entries"]
    counts, cells = (spark.read.parquet(f"{out}/prediction/{x}") for x in ("counts", "cells"))
    assert cells.count() == found["cells"] and not (tmp_path / "a/prediction.partial").exists()
    assert {r["n"] for r in cells.groupBy("context", "perturbation").agg(F.count("*").alias("n")).collect()} == {20}
    with pytest.raises(FileExistsError):
        studies.run_null(spark, SF, out)
    # a prediction is refused for each rule that it breaks
    profile = counts.select("context", "gene").distinct()
    good = lambda c=counts, p=cells, most=10**9: studies.require_prediction(c, p, cells, profile, 20, 500, most)
    assert good()["entries"] == report["entries"]
    one = counts.limit(1)
    for broken, why in (
        (lambda: good(p=cells.where("cell_idx > 0")), "cells of the panel"), (lambda: good(c=counts.unionByName(one.withColumn("cnt", F.lit(0).cast("long")).withColumn("gene", F.lit("g")))), "stored zeros"),
        (lambda: good(most=10), "stored entries"), (lambda: good(c=counts.unionByName(one)), "repeated pairs"), (lambda: good(c=counts.withColumn("gene", F.concat("gene", F.lit("x")))), "genes of the panel"),
        (lambda: good(c=counts.where("cell_idx <> 3")), "depth of every cell"), (lambda: good(c=counts.withColumn("cnt", F.when(F.col("cell_idx") == 3, F.col("cnt") + 1).otherwise(F.col("cnt")))), "depth of every cell"),
    ):
        with pytest.raises(Violation, match=why):
            broken()


def test_nothing_appears_that_is_not_right(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="the cap is 5"):
        studies.run_null(spark, SF, f"{tmp_path}/b", replicates=2, depth=50, most=5)
    monkeypatch.setattr(studies.Place, "free", lambda self: 1000)
    with pytest.raises(RuntimeError, match="bytes are free"):
        studies.run_null(spark, SF, f"{tmp_path}/b", replicates=2, depth=50)
    monkeypatch.undo()
    plain = studies.generate.multinomial_null
    monkeypatch.setattr(studies.generate, "multinomial_null", lambda *a: plain(*a).where("cell_idx <> 1"))
    with pytest.raises(Violation, match="depth of every cell"):
        studies.run_null(spark, SF, f"{tmp_path}/b", replicates=2, depth=50)
    assert not (tmp_path / "b/prediction").exists() and not (tmp_path / "b/prediction.partial").exists() and not (tmp_path / "b/report.json").exists()
    # genes in other places: every cell has its depth, but not its profile
    def shifted(profile, *rest):
        genes = sorted(r.gene for r in profile.select("gene").distinct().collect())
        other = F.create_map(*(F.lit(x) for pair in zip(genes, [*genes[1:], genes[0]], strict=True) for x in pair))
        return plain(profile, *rest).withColumn("gene", other[F.col("gene")])

    monkeypatch.setattr(studies.generate, "multinomial_null", shifted)
    with pytest.raises(Violation, match="drawn from the profiles"):
        studies.run_null(spark, SF, f"{tmp_path}/b", replicates=40, depth=5000)
    monkeypatch.undo()
    assert studies.run_null(spark, SF, f"{tmp_path}/b", replicates=2, depth=50)["cells"] > 0
