import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from deltaloom.operators.validate import Violation
from deltaloom.plans import studies

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_runs(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    with pytest.raises(Violation, match="matched controls"):
        studies.run_pseudobulk(spark, SF, str(tmp_path / "no"), 1000)
    summary = studies.run_pseudobulk(spark, SF, a)
    assert set(summary) == {"shared", "unseen", "genes"} and json.loads((tmp_path / "a" / "cohorts.json").read_text()) == summary
    with pytest.raises(FileExistsError):
        studies.run_pseudobulk(spark, SF, a)
    found = studies.run_transfer(spark, a, b, [1.0, 100.0])
    assert found["selection"]["alpha"] in (1.0, 100.0) and {r["model"] for r in found["metrics"]} == {"zero_delta", "training_mean", "nearest_line", "ridge"}
    assert (tmp_path / "b" / "metrics.csv").exists() and not (tmp_path / "b.lock").exists()
    with pytest.raises(FileExistsError):
        studies.run_transfer(spark, a, b, [1.0, 100.0])
    (tmp_path / "b" / "metrics.json").unlink()
    with pytest.raises(RuntimeError, match="other inputs"):
        studies.run_transfer(spark, a, b, [1.0])
    # the same rows in other files are the same input; one changed value isn't
    again, other, moved = (str(tmp_path / x) for x in ("again", "other", "moved"))
    for root, change in ((again, 0.0), (other, 1e-9)):
        for name in ("delta", "baseline"):
            df = spark.read.parquet(f"{a}/{name}")
            one = df.orderBy("line", *(["target"] if name == "delta" else []), "gene").head()
            column = "delta_log" if name == "delta" else "mean_log"
            here = (F.col("gene") == one["gene"]) & (F.col("line") == one["line"]) & (F.lit(True) if name == "baseline" else F.col("target") == one["target"])
            df = df.withColumn(column, F.when(here & F.lit(change > 0 and name == "delta"), F.col(column) + change).otherwise(F.col(column)))
            df.select(*reversed(df.columns)).repartition(3).write.parquet(f"{root}/{name}")
    with pytest.raises(RuntimeError, match="other inputs"):
        studies.run_transfer(spark, other, b, [1.0, 100.0])
    shutil.copytree(b, moved, ignore=shutil.ignore_patterns("model", "predictions", "metrics.*"))
    assert studies.run_transfer(spark, again, moved, [1.0, 100.0])["selection"] == found["selection"]


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_models_and_rehearsal(spark, tmp_path):
    from deltaloom.operators import families, lowrank
    from deltaloom.plans import registry

    a, b, c = (str(tmp_path / x) for x in "abc")
    studies.run_pseudobulk(spark, SF, a)
    aliases, links, _ = registry._graph(spark, SF)
    settings = [families.Setting("ridge_basal", "ridge_basal_10", families.BASAL, 10.0), families.Setting("trees", "trees_3", families.GRAPH, leaves=3, rounds=3, rate=0.1, least=2)]
    found = studies.run_models(spark, a, aliases, links, b, settings, rank=3, folds=2, threshold=400)
    models = {"zero_delta", "training_mean", "ridge_basal_10", "trees_3"}
    assert {r["model"] for r in found["metrics"]} == models and {r["cohort"] for r in found["metrics"]} == {"all", "shared", "unseen"}
    assert found["graph"]["n_edges"] > 0 and found["selection"]["winner"] in models and set(found["selection"]["mse"]) <= models
    nodes = lowrank.load_trees(spark, f"{b}/trees_3")
    assert nodes.select("component").distinct().count() == 3
    with pytest.raises(FileExistsError):
        studies.run_models(spark, a, aliases, links, b, settings, rank=3, folds=2, threshold=400)
    drawn = studies.run_rehearsal(spark, SF, b, c, ("zero_delta", "trees_3"), per_cohort=1, cells=16, fit=40, score=20)
    assert len(drawn["rows"]) == 4 and all(r["within_depth"] and r["mean_log_rmse"] >= 0 for r in drawn["rows"])
    # the choice of targets is frozen with its tables; predictions that were changed since aren't taken
    (tmp_path / "c" / "metrics.json").unlink()
    again = studies.run_rehearsal(spark, SF, b, c, ("zero_delta", "trees_3"), per_cohort=1, cells=16, fit=40, score=20)
    near = lambda rows: [[pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in r.values()] for r in rows]
    assert [list(r.values()) for r in again["rows"]] == near(drawn["rows"])
    (tmp_path / "c" / "metrics.json").unlink()
    with pytest.raises(RuntimeError, match="other inputs"):
        studies.run_rehearsal(spark, SF, b, c, ("zero_delta",), per_cohort=1, cells=16, fit=40, score=20)
    shutil.copytree(b, f"{b}2", ignore=shutil.ignore_patterns("predictions"))
    spark.read.parquet(f"{b}/predictions").withColumn("p", F.col("p") + 1e-9).write.partitionBy("model").parquet(f"{b}2/predictions")
    with pytest.raises(Violation, match="predictions as written"):
        studies.run_rehearsal(spark, SF, f"{b}2", f"{c}3", ("zero_delta",), per_cohort=1, cells=16, fit=40, score=20)
    with pytest.raises(ValueError, match="too few targets"):
        studies.run_rehearsal(spark, SF, b, f"{c}2", ("zero_delta",), per_cohort=1000, cells=16)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_calibration_study(spark, tmp_path, monkeypatch):
    out = tmp_path / "a"
    found = studies.run_calibration(spark, SF, str(out), iterations=(0, 2), seeds=(1, 2))
    assert found["selection"]["candidate"] in ("legacy", "mean_calibrated_2") and len(found["audit"]) == len(found["selection"]["rows"]) == 4
    assert found["audit"] != found["selection"]["rows"]
    with pytest.raises(FileExistsError):
        studies.run_calibration(spark, SF, str(out))
    with pytest.raises(Violation, match="each batch"):
        studies.run_calibration(spark, SF, str(tmp_path / "b"), {"fit": 1000, "calibration": 4, "audit": 4})

    # a selection that changes while the audit runs is an error
    plain = studies.calibration.evaluate_candidates
    calls = []

    def meddling(*args):
        calls.append(1)
        if len(calls) == 2:
            (tmp_path / "c" / "selection.json").write_text("{}")
        return plain(*args)

    monkeypatch.setattr(studies.calibration, "evaluate_candidates", meddling)
    with pytest.raises(RuntimeError, match="changed"):
        studies.run_calibration(spark, SF, str(tmp_path / "c"), iterations=(0,), seeds=(1,))
