import gzip
import json
import sys
import time
import zipfile

import pytest

from deltaloom.plans import stages, supervise
from deltaloom.sources import files, sinks


def test_readers(spark, tmp_path):
    p = tmp_path / "genes.csv"
    p.write_text("target_gene\nA\n1\n")
    assert sorted(r[0] for r in files.string_list(spark, str(p), "target_gene").collect()) == ["1", "A"]
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write("# comment\np1\tENSG1\tx\n")
    assert files.tsv_with_comments(spark, str(tmp_path / "a.tsv.gz"), ["protein", "alias", "source"]).head().alias == "ENSG1"
    with gzip.open(tmp_path / "l.txt.gz", "wt") as f:
        f.write("protein1 protein2 combined_score\np1 p2 800\n")
    assert files.links(spark, str(tmp_path / "l.txt.gz")).head().score == 800
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("cell,n\nx,1\n")
    assert files.csv_rows(spark, str(tmp_path / "c.csv.gz")).head().n == "1"
    assert files.lines(spark, str(tmp_path / "l.txt.gz"), " ").head().fields[0] == "protein1"
    (tmp_path / "m.json").write_text('{"a": 1,\n "b": "x"}')
    assert files.json_documents(spark, str(tmp_path / "m.json")).head().b == "x" and files.read_json(tmp_path / "m.json")["a"] == 1
    with pytest.raises(ValueError, match="a is 1"):
        files.load_config(tmp_path / "m.json", {"a": 2})


def test_categories(spark):
    cats = spark.createDataFrame([(0, "x"), (1, "y")], "code int, value string")
    codes = spark.createDataFrame([(0, 1), (1, 0)], "row int, code int")
    assert [r.value for r in files.decode_categories(codes, cats).orderBy("row").collect()] == ["y", "x"]
    with pytest.raises(Exception, match="missing category"):
        files.decode_categories(spark.createDataFrame([(0, -1)], "row int, code int"), cats).collect()


def test_ranges():
    data, failed = bytes(range(256)) * 10, []

    def fetch(a, b):
        if a == 600 and len(failed) < 2:
            failed.append(a)
            raise OSError("again")
        return data[a:b]

    assert b"".join(files.ranges(len(data), fetch, block=300)) == data and len(failed) == 2
    with pytest.raises(OSError, match="never"):
        list(files.ranges(10, lambda a, b: (_ for _ in ()).throw(OSError("never"))))


def test_extract(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/x.csv", "1")
        z.writestr("b/y.csv", "2")
        z.writestr("c/y.csv", "3")
    assert files.extract_allowed(tmp_path / "z.zip", tmp_path / "o", ["x.csv"])["x.csv"].read_text() == "1"
    with pytest.raises(ValueError, match="2 times"):
        files.extract_allowed(tmp_path / "z.zip", tmp_path / "o", ["y.csv"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 2.0), ("B", 2, None)], "line string, x int, y double")
    sinks.write_table(df, str(tmp_path / "t"), "line")
    assert (tmp_path / "t" / "line=A").exists()
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_table(df, str(tmp_path / "t"), "line")
    sinks.write_report(df.orderBy("x"), tmp_path / "r.csv")
    assert (tmp_path / "r.csv").read_text().split() == ["line,x,y", "A,1,2.0", "B,2,"]
    sinks.write_json({"a": float("nan"), "b": [float("inf"), 1]}, tmp_path / "j.json")
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": None, "b": [None, 1]}
    (tmp_path / "f").write_text("hello")
    assert sinks.copy_verified(str(tmp_path / "f"), f"file://{tmp_path}/g", spark) == sinks.digest(tmp_path / "g")
    config = {"program": ["p", "prep"], "prediction": "x", "output": "o", "flags": {"--genes": "g", "--contexts": ["A", "B"], "--cells": 400}}
    want = ["p", "prep", "x", "--genes", "g", "--contexts", "A,B", "--cells", "400", "-o", "o"]
    assert sinks.package_command(config, True) == want and sinks.package_command(config) == [*want, "--dry-run"]
    nz = spark.createDataFrame([(1, 0, 2), (0, 1, 1)], "cell_idx long, gene int, cnt int")
    sinks.write_csr(nz, str(tmp_path / "csr"))
    assert spark.read.parquet(str(tmp_path / "csr")).count() == 2


def test_fetched_files_have_receipts(tmp_path, monkeypatch):
    import hashlib

    url, md5 = "http://somewhere/a", hashlib.md5(b"abc").hexdigest()
    origin = sinks.Origin(url, 3, md5)
    known = sinks.archive([b"ab", b"c"], tmp_path / "d" / "a.gz", origin)
    assert gzip.open(tmp_path / "d" / "a.gz").read() == b"abc" and known["content"]["size"] == 3 and known["verified"] == ["size", "md5"]
    assert sinks.archive(iter(()), tmp_path / "d" / "a.gz", origin) == known  # nothing is read again
    with pytest.raises(ValueError, match="elsewhere"):
        sinks.archive([], tmp_path / "d" / "a.gz", sinks.Origin("http://other/a"))
    (tmp_path / "d" / "a.gz").write_bytes(b"x")
    with pytest.raises(ValueError, match="not what its receipt"):
        sinks.archive([], tmp_path / "d" / "a.gz", origin)
    (tmp_path / "plain").write_bytes(b"x")
    with pytest.raises(ValueError, match="without a receipt"):
        sinks.fetch([b"abc"], tmp_path / "plain", origin)
    for bad in (sinks.Origin(url, 4), sinks.Origin(url, 3, "0" * 32), sinks.Origin(url, sha256="0")):
        with pytest.raises(ValueError, match="not as published"):
            sinks.fetch([b"abc"], tmp_path / "b", bad)
    with pytest.raises(OSError, match="space"):
        sinks.fetch([b"abc"], tmp_path / "b", origin, least_free=1 << 60)
    assert not list(tmp_path.glob("b*"))
    assert sinks.fetch([b"abc"], tmp_path / "b", sinks.Origin(url))["verified"] == [] and (tmp_path / "b").read_bytes() == b"abc"


def test_stored_matrices(spark, tmp_path):
    import numpy as np

    x = np.array([[0, 1, 2], [0, 0, 0], [3, 0, 0], [0, 4, 5]])
    i, j = np.nonzero(x)
    csr = {"data": np.append(x[i, j], 0), "indices": np.append(j, 2), "indptr": np.array([0, 2, 2, 3, 6])}
    for stored in (x, csr):
        for rows in (1, 3, 100):
            parts = [np.concatenate(p).tolist() for p in zip(*files.matrix_blocks(stored, rows), strict=True)]
            assert parts == [i.tolist(), j.tolist(), x[i, j].tolist()]
    for bad in ({"data": 1}, np.zeros(3)):
        with pytest.raises(ValueError, match="CSR"):
            list(files.matrix_blocks(bad))
    np.savez(tmp_path / "m.npz", w=x, v=np.array([1.5, 2.5]), s=np.array(["a"]))
    long = {(r.row, r.col): r.value for r in files.read_npz(spark, tmp_path / "m.npz", "w", list("abcd"), list("xyz")).collect()}
    assert long["d", "z"] == 5 and len(long) == 12
    assert [tuple(r) for r in files.read_npz(spark, tmp_path / "m.npz", "v").orderBy("row").collect()] == [(0, 1.5), (1, 2.5)]
    with pytest.raises(ValueError, match="numbers"):
        files.read_npz(spark, tmp_path / "m.npz", "s")


def test_stages(tmp_path):
    out, runs = tmp_path / "o", []

    def action():
        runs.append(1)
        out.write_text("x")

    state = stages.load_state(tmp_path / "s.json", "run1")
    assert stages.stage(state, tmp_path / "s.json", "one", [out], action)
    state = stages.load_state(tmp_path / "s.json", "run1")
    assert not stages.stage(state, tmp_path / "s.json", "one", [out], action) and len(runs) == 1
    out.write_text("changed")
    with pytest.raises(RuntimeError, match="changed"):
        stages.stage(state, tmp_path / "s.json", "one", [out], action)
    with pytest.raises(RuntimeError, match="did not write"):
        stages.stage(state, tmp_path / "s.json", "two", [tmp_path / "no"], lambda: None)
    with pytest.raises(RuntimeError, match="another run"):
        stages.load_state(tmp_path / "s.json", "run2")


def test_gates(tmp_path):
    calls = []
    select = lambda: calls.append(1) or {"alpha": 10}
    for _ in range(2):
        assert stages.frozen_selection(tmp_path / "f.json", {"c": 1}, select) == {"alpha": 10}
    assert len(calls) == 1
    with pytest.raises(RuntimeError, match="other inputs"):
        stages.frozen_selection(tmp_path / "f.json", {"c": 2}, select)
    with pytest.raises(FileExistsError):
        stages.require_new(tmp_path / "f.json")
    with pytest.raises(ValueError, match=r"\['b'\]"):
        stages.require_manifest({"a": 1}, {"a": 1, "b": 2}, ["a", "b"])
    with pytest.raises(RuntimeError, match="pinned"):
        stages.require_version("1", "2")
    with pytest.raises(RuntimeError, match="needs"):
        stages.require_resources(tmp_path, 1 << 60, 0)
    with stages.locked(tmp_path / "l"), pytest.raises(RuntimeError, match="lock"), stages.locked(tmp_path / "l"):
        pass
    d = stages.fingerprints([tmp_path / "f.json"])
    assert stages.verified_inputs(d, [tmp_path / "f.json"]) == d
    with pytest.raises(ValueError, match="manifest"):
        stages.verified_inputs({}, [tmp_path / "f.json"])
    assert stages.provenance(0, d)["inputs"] == d and stages.identity({"a": 1}, "c") != stages.identity({"a": 2}, "c")


def test_manifest(spark):
    m = spark.createDataFrame([("t/a.parquet", "1"), ("t/b.json", "2"), ("u/c.parquet", "3")], "path string, sha256 string")
    assert [r.path for r in stages.manifest_paths(m, "t/", ".parquet").collect()] == ["t/a.parquet"]


def test_arrays_written_and_read(spark, tmp_path):
    w = spark.createDataFrame([("a", 3, 1.5), ("b", 1, -2.0), ("a", 1, 4.0)], "row string, col int, value double")
    v = spark.createDataFrame([(2, 1.0), (1, 0.5)], "row int, value double")
    sinks.write_npz({"w": w, "v": v, "none": v.where("false")}, tmp_path / "m.npz")
    long = {(r.row, r.col): r.value for r in files.read_npz(spark, tmp_path / "m.npz", "w", ["a", "b"], [1, 3]).collect()}
    assert long == {("a", 1): 4.0, ("a", 3): 1.5, ("b", 1): -2.0, ("b", 3): 0.0}
    assert [r.value for r in files.read_npz(spark, tmp_path / "m.npz", "v_row").orderBy("row").collect()] == [1.0, 2.0]
    with pytest.raises(FileExistsError):
        sinks.write_npz({"v": v}, tmp_path / "m.npz")
    for bad, largest in ((v.union(v), 9), (w, 3), (v.union(spark.createDataFrame([(4, None)], v.schema)), 9)):
        with pytest.raises(ValueError, match="values"):
            sinks.write_npz({"x": bad}, tmp_path / "n.npz", largest)
    assert not (tmp_path / "n.npz").exists()


class Group(dict):
    """As much of an HDF5 group as is written to."""

    class Set:
        def __init__(self):
            self.x = []

        shape = property(lambda self: (len(self.x),))

        def resize(self, shape):
            self.x += [None] * (shape[0] - len(self.x))

        def __setitem__(self, at, values):
            self.x[at] = list(values)

        def __getitem__(self, at):
            return self.x[at]

    def __init__(self):
        super().__init__()
        self.attrs = {}

    def create_dataset(self, name, **_):
        self[name] = self.Set()
        return self[name]


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_csr_appended_in_blocks(block):
    import numpy as np

    x = np.array([[0, 1, 2], [0, 0, 0], [3, 0, 0], [0, 4, 5]])
    group = Group()
    assert sinks.append_csr(group, ((np.flatnonzero(r), r[r != 0]) for r in x), 3, block) == 4
    assert list(group.attrs["shape"]) == [4, 3] and group["indptr"].x == [0, 2, 2, 3, 5]
    i, j, v = (np.concatenate(p) for p in zip(*files.matrix_blocks(group, 2), strict=True))
    back = np.zeros_like(x)
    back[i, j] = v
    assert (back == x).all()
    with pytest.raises(ValueError, match="outside"):
        sinks.append_csr(Group(), [([3], [1])], 3)


def test_supervised_commands(tmp_path):
    log, seen = tmp_path / "log", []
    script = "import pathlib, sys; p = pathlib.Path(sys.argv[1]); n = len(p.read_text()) if p.exists() else 0; p.write_text('x' * (n + 1)); print('try', n); sys.exit(n < 2)"
    assert supervise.supervise([sys.executable, "-c", script, str(tmp_path / "n")], log, tries=5, export=lambda p: seen.append(p.read_text())) == 3
    assert log.read_text().split() == ["try", "0", "try", "1", "try", "2"] and seen[-1] == log.read_text()
    with pytest.raises(RuntimeError, match="exit 3"):
        supervise.supervise([sys.executable, "-c", "import sys; sys.exit(3)"], log, tries=2)
    began = time.monotonic()
    with pytest.raises(RuntimeError, match="not done"):
        supervise.supervise([sys.executable, "-c", "import time; time.sleep(60)"], log, limit=0.5, every=0.1, export=seen.append)
    assert time.monotonic() - began < 20 and seen[-1] == log


def test_backups(tmp_path):
    a, b, receipt = tmp_path / "a", tmp_path / "b", tmp_path / "r.json"
    a.write_text("one")
    b.write_text("two")
    known: dict = {}
    assert supervise.back_up([a, b], receipt, sinks.digest, known) == [a, b]
    a.write_text("new")
    assert supervise.back_up([a, b], receipt, sinks.digest, json.loads(receipt.read_text())) == [a]
    with pytest.raises(OSError, match="differs"):
        supervise.back_up([b], receipt, lambda p: "no", {})
