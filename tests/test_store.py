"""State of runs on a file system that only Spark knows."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from deltaloom.plans import stages, studies
from deltaloom.sources import sinks
from deltaloom.sources.store import Place

SF = "/root/testdata/sf0.01"


@pytest.fixture
def place(spark, tmp_path):
    return Place(spark, f"file:{tmp_path}/a b")


def test_files(place, tmp_path):
    f = place / "x" / "f.json"
    assert f.name == "f.json" and not f.exists() and not place.exists()
    with pytest.raises(FileNotFoundError):
        f.read_text()
    f.write_text("é\n")
    f.write_text("second")
    assert f.read_text() == "second" == (tmp_path / "a b/x/f.json").read_text() and os.listdir(tmp_path / "a b/x") == ["f.json"]
    with pytest.raises(FileExistsError):
        f.create_text("third")
    assert f.read_text() == "second" and f.size() == 6 and f.digest() == sinks.digest(f) == sinks.digest(tmp_path / "a b/x/f.json")
    (tmp_path / "a b/x/f.json").write_text("changed by another")
    assert f.read_text() == "changed by another"
    f.unlink()
    assert not f.exists() and (place / "x").exists()
    (place / "e").create_text("")
    assert (place / "e").read_text() == ""


def test_reports_and_stages(spark, place):
    sinks.write_report(spark.createDataFrame([(1, None), (2, "a,b")], "k long, v string").orderBy("k"), place / "r.csv")
    assert (place / "r.csv").read_text().splitlines() == ["k,v", "1,", '2,"a,b"']
    with pytest.raises(FileExistsError):
        sinks.write_report(spark.range(1), place / "r.csv")
    state, runs = stages.load_state(place / "s.json", "run"), []

    def action():
        runs.append(1)
        (place / "out").write_text("x")

    assert stages.stage(state, place / "s.json", "one", [place / "out"], action)
    assert not stages.stage(stages.load_state(place / "s.json", "run"), place / "s.json", "one", [place / "out"], action) and runs == [1]
    (place / "out").write_text("y")
    with pytest.raises(RuntimeError, match="changed"):
        stages.stage(stages.load_state(place / "s.json", "run"), place / "s.json", "one", [place / "out"], action)
    with pytest.raises(RuntimeError, match="another run"):
        stages.load_state(place / "s.json", "other")
    assert stages.frozen_selection(place / "f.json", {"c": 1}, lambda: {"a": 1}) == stages.frozen_selection(place / "f.json", {"c": 1}, lambda: {"a": 2})


def test_locks(place):
    lock = place / "l"
    with stages.locked(lock):
        assert json.loads(lock.read_text())["pid"] == os.getpid()
        with pytest.raises(RuntimeError, match="holds the lock"), stages.locked(lock):
            pass
        assert lock.exists()
    assert not lock.exists()
    # of a process that has ended; of another machine
    gone = subprocess.run([sys.executable, "-c", "import os; print(os.getpid())"], capture_output=True, text=True, check=True).stdout
    import socket

    lock.write_text(json.dumps({"host": socket.gethostname(), "pid": int(gone)}))
    with stages.locked(lock):
        pass
    lock.write_text(json.dumps({"host": "elsewhere", "pid": int(gone)}))
    with pytest.raises(RuntimeError, match="elsewhere"), stages.locked(lock):
        pass
    stages.release(lock)
    stages.release(lock)
    with stages.locked(lock):
        pass


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_a_broken_run_is_taken_up_again(spark, tmp_path, monkeypatch):
    a, b = f"file:{tmp_path}/a", f"file:{tmp_path}/b"
    studies.run_pseudobulk(spark, SF, a)
    with pytest.raises(FileExistsError):
        studies.run_pseudobulk(spark, SF, a)
    # broken off after the selection is frozen and predictions are written
    plain, chosen = studies.metrics.cohort_metrics, []

    def broken(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(studies.metrics, "cohort_metrics", broken)
    with pytest.raises(KeyboardInterrupt):
        studies.run_transfer(spark, a, b, [1.0, 100.0], folds=2)
    assert (tmp_path / "b/selection.json").exists() and not (tmp_path / "b/metrics.json").exists() and not (tmp_path / "b.lock").exists()
    monkeypatch.setattr(studies.metrics, "cohort_metrics", plain)
    monkeypatch.setattr(studies.transfer, "alpha_losses", lambda *a: chosen.append(1))
    (tmp_path / "b.lock").write_text(json.dumps({"host": "elsewhere", "pid": 1}))
    with pytest.raises(RuntimeError, match="holds the lock"):
        studies.run_transfer(spark, a, b, [1.0, 100.0], folds=2)
    stages.release(Place(spark, f"{b}.lock"))
    assert studies.run_transfer(spark, a, b, [1.0, 100.0], folds=2)["metrics"] and not chosen
    with pytest.raises(FileExistsError):
        studies.run_transfer(spark, a, b, [1.0, 100.0], folds=2)
