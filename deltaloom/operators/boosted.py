"""Boosted regression trees by histograms, so that a component is fitted by all tasks.

Features are binned once. For the leaves that a split makes, tasks add up counts and gradients by component, feature
and bin; only the smaller child's are gathered, its sibling's are the parent's less these. All components grow side by side: a split of each
is one job. Gradients are whole numbers of a fixed unit, so that sums, and so trees, don't depend on partitions. The driver holds
histograms of (components x features x bins) for each leaf, whatever the number of targets.

Where a bin holds one value, trees are those of lowrank.trees_fit(), which looks at every value, a component a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.lowrank import _NODE
from deltaloom.session import materialize

#: Bins of a feature; targets whose values say where bins begin; targets of a block; rounds after which predictions so far are written.
BINS, SAMPLE, BLOCK, WRITTEN = 255, 20_000, 4096, 8
_ROWS = "x binary, z binary, p binary"
_SCHEMA = pa.schema([("x", pa.binary()), ("z", pa.binary()), ("p", pa.binary())])


def bin_edges(features: DataFrame, names: list[str], most: int = BINS) -> list[np.ndarray]:
    """The largest value of each bin but the last, by feature: each value of its own if there are few, else quantiles, over the targets with the smallest hashes."""
    rows = features.orderBy(F.xxhash64("target"), "target").limit(SAMPLE).select(*(F.col(n).cast("double") for n in names)).toPandas()
    out = []
    for n in names:
        values = np.unique(rows[n].to_numpy(float))
        if len(values) > most:
            values = np.unique(np.quantile(rows[n].to_numpy(float), np.arange(1, most + 1) / most, method="inverted_cdf"))
        out.append(values[:-1])
    return out


def _walk(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf of each row; nodes: feature (-1: a leaf), last bin of the low side, low, high."""
    at = np.zeros(len(x), np.int64)
    while (inner := nodes[at, 0] >= 0).any():
        here = nodes[at[inner]]
        at[inner] = np.where(x[inner, here[:, 0]] <= here[:, 1], here[:, 2], here[:, 3])
    return at


class _Growing:
    """A tree that is being grown."""

    def __init__(self) -> None:
        self.nodes: list[list[int]] = [[-1, 0, -1, -1]]
        self.open: dict[int, np.ndarray] = {}  # of leaves: (features, bins, count and sum)
        self.sums: dict[int, tuple[int, int]] = {}
        self.thresholds: dict[int, float] = {}
        self.splits: dict[int, tuple[float, int, int, float] | None] = {}

    def array(self) -> np.ndarray:
        return np.array(self.nodes, np.int64)


def _best_split(h: np.ndarray, unit: float, least: int, low: np.ndarray, high: np.ndarray) -> tuple[float, int, int, float] | None:
    """Gain, feature, last bin of the low side and threshold of the best split into parts of least rows each; of equal ones the first feature and bin."""
    n, s = h[0, :, 0].sum(), float(h[0, :, 1].sum()) / unit
    if n < 2 * least:
        return None
    left, g = np.cumsum(h[:, :, 0], axis=1), np.cumsum(h[:, :, 1], axis=1) / unit
    fine = (h[:, :, 0] > 0) & (left >= least) & (n - left >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fine, g**2 / left + (s - g) ** 2 / (n - left) - s**2 / n, -np.inf)
    feature, last = divmod(int(gain.argmax()), gain.shape[1])
    if not gain[feature, last] > 1e-12:
        return None
    after = last + 1 + int(np.flatnonzero(h[feature, last + 1 :, 0])[0])
    return float(gain[feature, last]), feature, last, float((high[feature, last] + low[feature, after]) / 2)


def trees_fit(features: DataFrame, scores: DataFrame, names: list[str], leaves: int, rounds: int, rate: float, least: int, bins: int = BINS) -> DataFrame:
    """Nodes as of lowrank.trees_fit(): component, tree, node, feature, threshold, low, high, value; features (target, names) must be known numbers."""
    if leaves < 2 or rounds < 1 or rate <= 0 or least < 1 or not 2 <= bins <= 255:
        raise ValueError("tree parameters out of range")
    spark = features.sparkSession
    stats = {r["component"]: r for r in scores.join(features.select("target"), "target").groupBy("component").agg(F.count("*").alias("n"), F.max(F.abs("z")).alias("most")).collect()}
    components = sorted(stats)
    if not components:
        return spark.createDataFrame([], _NODE)
    n = max(r["n"] for r in stats.values())
    if min(r["n"] for r in stats.values()) < n:
        raise ValueError("a target lacks the score of a component")
    # sums of all rows' numbers, of up to four times the largest score each, fit in 64 bits
    bits = min(45, 60 - math.ceil(math.log2(n + 1)))
    unit = [2.0**bits / (stats[c]["most"] or 1.0) for c in components]
    edges, p, k, width = bin_edges(features, names, bins), len(names), len(components), bins + 1
    at = lambda c: F.max(F.when(F.col("component") == c, F.col("z")))
    wide = scores.groupBy("target").agg(F.array(*(at(c) for c in components)).alias("z"))
    rows = features.join(wide, "target").select(F.array(*(F.col(c).cast("double") for c in names)).alias("x"), "z")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x, z = (part.column(i).flatten().to_numpy().reshape(part.num_rows, -1) for i in (0, 1))
                binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (binned, z, x)], schema=_SCHEMA)

    packed = materialize(rows.mapInArrow(pack, _ROWS), "binned")
    low, high = _ends(packed, p, width)
    start = [r["s"] for r in _starts(packed, k, unit).collect()]
    mean = np.array([s / u / n for s, u in zip(start, unit, strict=True)])
    blocks = _predicted(packed, k, p, mean, [])
    out = [[c, -1, 0, -1, 0.0, -1, -1, float(m)] for c, m in zip(components, mean, strict=True)]
    pending: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for t in range(rounds):
        if len(pending) == WRITTEN:
            blocks, pending = _predicted(blocks, k, p, None, pending), []
        trees = [_Growing() for _ in components]
        for i, h in _histograms(blocks, k, p, width, unit, pending, {i: (trees[i].array(), 0) for i in range(k)}).items():
            _opened(trees[i], 0, h, unit[i], least, low, high)
        for step in range(leaves - 1):
            asked = {}
            for i, tree in enumerate(trees):
                found = [(s[0], -node) for node, s in tree.splits.items() if s]
                if not found:
                    continue
                node = -max(found)[1]
                _, feature, last, threshold = tree.splits.pop(node)
                parent, a, b = tree.open.pop(node), len(tree.nodes), len(tree.nodes) + 1
                tree.nodes[node], tree.thresholds[node] = [feature, last, a, b], threshold
                tree.nodes += [[-1, 0, -1, -1], [-1, 0, -1, -1]]
                own = parent[feature, : last + 1].sum(axis=0)
                whole = parent[0].sum(axis=0)
                tree.sums[a], tree.sums[b] = tuple(map(int, own)), tuple(map(int, whole - own))
                if step < leaves - 2:
                    small, other = (a, b) if own[0] * 2 <= whole[0] else (b, a)
                    asked[i] = (small, other, parent)
            if not asked:
                continue
            for i, h in _histograms(blocks, k, p, width, unit, pending, {i: (trees[i].array(), small) for i, (small, *_) in asked.items()}).items():
                small, other, parent = asked[i]
                _opened(trees[i], small, h, unit[i], least, low, high)
                _opened(trees[i], other, parent - h, unit[i], least, low, high)
        grown = []
        for i, (c, tree) in enumerate(zip(components, trees, strict=True)):
            values = np.zeros(len(tree.nodes))
            for node, (feature, _, a, b) in enumerate(tree.nodes):
                if feature < 0:
                    count, s = tree.sums[node]
                    values[node] = rate * (s / unit[i] / count)
                out.append([c, t, node, feature, tree.thresholds.get(node, 0.0), a, b, float(values[node])])
            grown.append((tree.array(), values))
        pending.append(grown)
    return spark.createDataFrame([tuple(r) for r in out], _NODE)


def _opened(tree: _Growing, node: int, h: np.ndarray, unit: float, least: int, low: np.ndarray, high: np.ndarray) -> None:
    tree.open[node], tree.sums[node] = h, tuple(map(int, h[0].sum(axis=0)))
    tree.splits[node] = _best_split(h, unit, least, low, high)


def _ends(packed: DataFrame, p: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest value of each bin, by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(p * width, np.inf), np.full(p * width, -np.inf)
        for batch in batches:
            for b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = np.frombuffer(b, np.uint8).reshape(-1, p) + np.arange(p) * width
                values = np.frombuffer(v, float).reshape(-1, p)
                np.minimum.at(low, place.ravel(), values.ravel())
                np.maximum.at(high, place.ravel(), values.ravel())
        some = np.flatnonzero(low < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(low[some]), pa.array(high[some])], names=["place", "low", "high"])

    low, high = np.full(p * width, np.inf), np.full(p * width, -np.inf)
    for r in packed.select("x", "p").mapInArrow(run, "place long, low double, high double").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["place"]], high[r["place"]] = r["low"], r["high"]
    return low.reshape(p, width), high.reshape(p, width)


def _starts(packed: DataFrame, k: int, unit: list[float]) -> DataFrame:
    """Sums of scores in units, a row for each component, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k, np.int64)
        for batch in batches:
            for z in batch.column(0).to_pylist():
                total += np.rint(np.frombuffer(z, float).reshape(-1, k) * unit).astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], names=["i", "s"])

    return packed.select("z").mapInArrow(run, "i long, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i")


def _so_far(x: np.ndarray, p: np.ndarray, pending: list) -> np.ndarray:
    p = p.copy()
    for grown in pending:
        for i, (nodes, values) in enumerate(grown):
            p[:, i] += values[_walk(nodes, x)]
    return p


def _predicted(blocks: DataFrame, k: int, features: int, mean: np.ndarray | None, pending: list) -> DataFrame:
    """Blocks with what is predicted so far: the means, or what they have and the pending trees; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, z, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                binned = np.frombuffer(x, np.uint8).reshape(-1, features)
                new = np.tile(mean, (len(binned), 1)) if mean is not None else _so_far(binned, np.frombuffer(p, float).reshape(-1, k), pending)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (x, z, new.tobytes())], schema=_SCHEMA)

    return materialize(blocks.select("x", "z", "p").mapInArrow(run, _ROWS), "boosted")


_HALF = 26


def _histograms(blocks: DataFrame, k: int, p: int, width: int, unit: list[float], pending: list, asked: dict[int, tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Counts and sums of gradients by feature and bin, of one node of each component's tree that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros((p * width, 2), np.int64) for i in asked}
        for batch in batches:
            for x, z, done in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                binned = np.frombuffer(x, np.uint8).reshape(-1, p)
                off = np.frombuffer(z, float).reshape(-1, k) - _so_far(binned, np.frombuffer(done, float).reshape(-1, k), pending)
                place = binned + np.arange(p) * width
                for i, (nodes, node) in asked.items():
                    mine = np.flatnonzero(_walk(nodes, binned) == node)
                    g, to = np.rint(off[mine, i] * unit[i]).astype(np.int64), place[mine].ravel()
                    # sums of halves are exact as floats
                    count, upper, lower = (np.bincount(to, None if w is None else np.repeat(w.astype(float), p), p * width).astype(np.int64) for w in (None, g >> _HALF, g & ((1 << _HALF) - 1)))
                    total[i][:, 0] += count
                    total[i][:, 1] += (upper << _HALF) + lower
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["i", "h"])

    def add(table: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(h, np.int64) for h in table.column("h").to_pylist()], axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "h": pa.array([s.tobytes()], pa.binary())})

    found = blocks.select("x", "z", "p").mapInArrow(run, "i long, h binary").groupBy("i").applyInArrow(add, "i long, h binary").collect()
    return {r["i"]: np.frombuffer(r["h"], np.int64).reshape(p, width, 2) for r in found}
