"""Readers of the files that studies start from."""

from __future__ import annotations

import contextlib
import gzip
import importlib
import json
import shutil
import urllib.request
import zipfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES, WORKERS, TRIES = 16 << 20, 4, 3


def string_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A one-column CSV of strings with or without its header."""
    return spark.read.schema(f"{name} string").csv(path).where(~F.col(name).eqNullSafe(F.lit(name)))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, gzipped or not; all columns are strings."""
    return spark.read.option("header", True).csv(path)


def tsv_with_comments(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, sep="\t", comment="#")


def links(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated protein1 protein2 combined_score with a header to skip."""
    return spark.read.option("header", True).schema("protein1 string, protein2 string, score int").csv(path, sep=" ")


def lines(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Lines as arrays of fields."""
    return spark.read.text(path).select(F.split("value", separator).alias("fields"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def decode_categories(codes: DataFrame, categories: DataFrame) -> DataFrame:
    """(row, code) and (code, value) to row, value; a negative code is an error when read."""
    checked = codes.withColumn("code", F.when(F.col("code") >= 0, F.col("code")).otherwise(F.raise_error(F.lit("missing category"))))
    return checked.join(F.broadcast(categories), "code", "left").select("row", "value")


def load_config(path: str | Path, required: dict[str, object] | None = None) -> dict:
    """A YAML (if its library is there) or JSON file; required keys must have the given values."""
    text = Path(path).read_text()
    if Path(path).suffix == ".json":
        config = json.loads(text)
    else:
        config = importlib.import_module("yaml").safe_load(text)
    for key, value in (required or {}).items():
        if config.get(key) != value:
            raise ValueError(f"{path}: {key} is {config.get(key)!r}, not {value!r}")
    return config


def read_npz(spark: SparkSession, path: str | Path, name: str, rows: list | None = None, columns: list | None = None) -> DataFrame:
    """An array of an NPZ file of models or samples as (row, value) or (row, col, value); rows and columns name its places."""
    np = importlib.import_module("numpy")
    with np.load(path, allow_pickle=False) as f:
        x = f[name]
    if x.ndim not in (1, 2) or not np.issubdtype(x.dtype, np.number):
        raise ValueError(f"{name} isn't a vector or matrix of numbers")
    pa = importlib.import_module("pyarrow")
    places = np.indices(x.shape).reshape(x.ndim, -1)
    named = [np.asarray(axis)[at] if axis is not None else at for axis, at in zip((rows, columns), places, strict=False)]
    return spark.createDataFrame(pa.table({k: v for k, v in zip(("row", "col"), named, strict=False)} | {"value": x.astype(float).ravel()}))


def matrix_blocks(x, rows: int = 1024) -> Iterator[tuple]:
    """(rows, columns, values) of the nonzeros of a stored matrix, rows at a time: a dense array of two axes, or a CSR group (data, indices, indptr)."""
    np = importlib.import_module("numpy")
    if hasattr(x, "keys"):
        if not {"data", "indices", "indptr"} <= set(x.keys()):
            raise ValueError("a sparse X must be CSR")
        at = np.asarray(x["indptr"][:])
        for lo in range(0, len(at) - 1, rows):
            ends = at[lo : lo + rows + 1]
            some = slice(int(ends[0]), int(ends[-1]))
            i, j, v = np.repeat(np.arange(len(ends) - 1), np.diff(ends)) + lo, np.asarray(x["indices"][some]), np.asarray(x["data"][some])
            yield i[v != 0], j[v != 0], v[v != 0]
        return
    if len(x.shape) != 2:
        raise ValueError("X must be dense with two axes, or CSR")
    for lo in range(0, x.shape[0], rows):
        part = np.asarray(x[lo : lo + rows])
        i, j = np.nonzero(part)
        yield i + lo, j, part[i, j]


def counts_of_hdf5(spark: SparkSession, path: str, target: str, rows: int = 1024) -> None:
    """The matrix X of an HDF5 or AnnData file, dense or CSR, plain or gzip, to Parquet of cell, gene_idx, cnt, rows at a time; needs h5py."""
    h5py, pa, pq = (importlib.import_module(m) for m in ("h5py", "pyarrow", "pyarrow.parquet"))
    schema = pa.schema([("cell", pa.int64()), ("gene_idx", pa.int32()), ("cnt", pa.float64())])
    with contextlib.ExitStack() as stack:
        source = stack.enter_context(gzip.open(path, "rb")) if path.endswith(".gz") else path
        f = stack.enter_context(h5py.File(source, "r"))
        out = stack.enter_context(pq.ParquetWriter(target, schema, compression="zstd"))
        for i, j, v in matrix_blocks(f["X"], rows):
            out.write_table(pa.table([pa.array(i, pa.int64()), pa.array(j.astype("int32")), pa.array(v.astype("float64"))], schema=schema))


def get_range(url: str, start: int, end: int) -> bytes:
    """Bytes start to end (exclusive); the server must answer with exactly that range."""
    request = urllib.request.Request(url, headers={"Range": f"bytes={start}-{end - 1}"})
    with urllib.request.urlopen(request, timeout=60) as r:
        said = r.headers.get("Content-Range", "")
        if r.status != 206 or not said.startswith(f"bytes {start}-{end - 1}/"):
            raise OSError(f"not the range asked for: {r.status} {said}")
        data = r.read()
    if len(data) != end - start:
        raise OSError("short range")
    return data


def ranges(size: int, fetch: Callable[[int, int], bytes], block: int = BLOCK_BYTES, workers: int = WORKERS, tries: int = TRIES) -> Iterator[bytes]:
    """Blocks of a file in order, some fetched ahead, each tried a few times."""

    def one(start: int) -> bytes:
        for k in range(tries):
            try:
                return fetch(start, min(start + block, size))
            except OSError:
                if k + 1 == tries:
                    raise
        raise AssertionError

    starts = list(range(0, size, block))
    with ThreadPoolExecutor(workers) as pool:
        ahead = [pool.submit(one, s) for s in starts[:workers]]
        for i in range(len(starts)):
            data = ahead.pop(0).result()
            if i + workers < len(starts):
                ahead.append(pool.submit(one, starts[i + workers]))
            yield data


def extract_allowed(archive: str | Path, target: str | Path, allowed: Iterable[str]) -> dict[str, Path]:
    """Files of a zip by base name; each of the allowed must be there exactly once."""
    target = Path(target)
    with zipfile.ZipFile(archive) as z:
        found: dict[str, list[str]] = {}
        for name in z.namelist():
            found.setdefault(Path(name).name, []).append(name)
        out = {}
        for name in allowed:
            if len(found.get(name, [])) != 1:
                raise ValueError(f"{name} occurs {len(found.get(name, []))} times")
            target.mkdir(parents=True, exist_ok=True)
            with z.open(found[name][0]) as src, (target / name).open("wb") as dst:
                shutil.copyfileobj(src, dst)
            out[name] = target / name
    return out
