"""Exact k-means on whole numbers, by kd-trees that centroids are filtered through.

Vectors are packed once into kd-trees, a row of a written table each: every node has its
vectors' count, integer sums and box. In a round all nodes of a level are looked
at together: of the centroids left to a node one is nearest to the middle of its box, and
those that are strictly farther than it from every point of the box are dropped. A node with one left is
assigned whole, by its count and sums; leaves with several are resolved vector by vector. Tasks hand on
k sums each; centroids (k x dimensions) are what the driver and the broadcast hold.

Defined results: vectors that are null, have another number of components, or hold
null or non-finite ones take no part; scaled components beyond 2**62 count as that; arithmetic
is exact at any size, but that distances and inertias beyond 64 bits are returned as the largest that fits; ties
go to the smaller centroid; rows with a null vec_id are assigned but start no centroid; repeated rows count each, and of
starts with one hash the smaller vector comes first; with fewer vectors than k there are fewer
centroids; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.session import materialize

K, ROUNDS, SCALE, DIMENSIONS = 16, 3, 64.0, 64
#: Vectors of a tree at most, and of a leaf.
TREE, LEAF = 8192, 32
_MOST = 2**63 - 1
_FARTHEST = 2.0**62
#: Up to this magnitude distances and a tree's sums are exact in 64 bits.
_SAFE = 1 << 25


def whole_numbers(vectors: DataFrame, scale: float, dimensions: int) -> DataFrame:
    """vec_id, v: the vectors that take part, their components as floor(scale * x)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-_FARTHEST), F.least(F.lit(_FARTHEST), x * F.lit(scale)))))
    return v.where(fine).select("vec_id", scaled.alias("v"))


_TREES = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("v", pa.binary()), ("nodes", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("sums", pa.binary())])
_TREE_ROWS = "n int, ids array<long>, v binary, nodes binary, low binary, high binary, sums binary"


def build(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the vectors, and of each node its begin, end and children (-1: a leaf), its box's low and high side.

    A node is cut at the median of the widest side of its box; nodes lie level by level.
    """
    order = np.arange(len(v))
    nodes, boxes = [[0, len(v), -1, -1]], []
    at = 0
    while at < len(nodes):
        lo, hi, *_ = nodes[at]
        own = v[order[lo:hi]]
        low, high = own.min(axis=0), own.max(axis=0)
        boxes.append((low, high))
        # sides as floats, as the difference of two numbers may not fit
        side = high.astype(float) - low
        if hi - lo > LEAF and side.max() > 0:
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, int(side.argmax())], mid)]
            nodes[at][2:] = len(nodes), len(nodes) + 1
            nodes += [[lo, lo + mid, -1, -1], [lo + mid, hi, -1, -1]]
        at += 1
    return order, np.array(nodes, np.int64), np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])


def _exact(*arrays: np.ndarray) -> bool:
    """Whether 64 bits hold all that is computed from these."""
    return all(len(a) == 0 or max(int(a.max()), -int(a.min())) <= _SAFE for a in arrays)


def _sums(v: np.ndarray) -> np.ndarray:
    """Running sums of the vectors, so that a node's are a difference of two."""
    return np.vstack([np.zeros((1, v.shape[1]), v.dtype), np.cumsum(v, axis=0)])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    held: list[np.ndarray] = []

    def tree() -> pa.RecordBatch:
        v = np.concatenate(held)
        order, nodes, low, high = build(v)
        v = v[order]
        # sums beyond 64 bits are made again from the vectors where they are needed
        own = _sums(v)[nodes[:, 1]] - _sums(v)[nodes[:, 0]] if _exact(v) else np.zeros((0, v.shape[1]), np.int64)
        kind = np.int16 if _exact(v) and max(int(high.max()), -int(low.min())) <= np.iinfo(np.int16).max else np.int64
        keys = np.array(ids, object)[order].tolist()
        row = {"n": len(v), "ids": keys, "v": v.astype(kind).tobytes(), "nodes": nodes.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "sums": own.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=_TREES)

    size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, TREE):
            part = batch.slice(lo, TREE)
            v = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
            while part.num_rows:
                some = min(TREE - size, part.num_rows)
                ids += part.column(0).slice(0, some).to_pylist()
                held.append(v[:some])
                size += some
                part, v = part.slice(some), v[some:]
                if size == TREE:
                    yield tree()
                    ids, held, size = [], [], 0
    if size:
        yield tree()


class _Tree:
    def __init__(self, row: dict, d: int) -> None:
        n = row["n"]
        self.v = np.frombuffer(row["v"], np.int16 if len(row["v"]) == 2 * n * d else np.int64).reshape(n, d).astype(np.int64)
        self.nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 4)
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(-1, d) for c in ("low", "high"))
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, d)


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, vectors by centroids, in the numbers' own kind."""
    return (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]


def filtered(tree: _Tree, c: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | int]]:
    """node, begin, end and the centroid of all its vectors, or for leaves one for each vector."""
    v, low, high, nodes = tree.v, tree.low, tree.high, tree.nodes
    if not _exact(v, low, high, c):
        v, low, high, c = (x.astype(object) for x in (v, low, high, c))
    level, left = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    while len(level):
        lo, hi = low[level], high[level]
        # twice the middle, so that it is whole; what is dropped doesn't depend on which is taken for nearest
        middle = np.where(left, _squares(lo + hi, 2 * c), np.inf if v.dtype != object else 1 << 200)
        best = middle.argmin(axis=1)
        near = c[best]
        # the corner of the box that is farthest in the direction of the other centroid
        corner = np.where(c[None, :, :] > near[:, None, :], hi[:, None, :], lo[:, None, :])
        gain = ((c[None] - corner) ** 2 - (near[:, None, :] - corner) ** 2).sum(axis=2)
        left &= (gain <= 0) | (np.arange(len(c)) == best[:, None])
        one = left.sum(axis=1) == 1
        for i in np.flatnonzero(one):
            yield int(level[i]), int(nodes[level[i], 0]), int(nodes[level[i], 1]), int(best[i])
        leaf = nodes[level, 2] < 0
        for i in np.flatnonzero(leaf & ~one):
            begin, end = nodes[level[i], :2]
            some = np.flatnonzero(left[i])
            yield int(level[i]), int(begin), int(end), some[_squares(v[begin:end], c[some]).argmin(axis=1)]
        inner = ~leaf & ~one
        level, left = nodes[level[inner], 2:].ravel(), np.repeat(left[inner], 2, axis=0)


_HALF = 31
_PARTIAL = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])


def _count(k: int, d: int, sent):
    """Of each task the count and sums of every centroid's vectors; a sum in two halves, so that sums of sums fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n, total = sent.value, np.zeros(k, np.int64), np.zeros((k, d), object)
        for batch in batches:
            for row in batch.to_pylist():
                tree = _Tree(row, d)
                own = np.zeros((k, d), np.int64 if len(tree.sums) else object)
                for node, begin, end, to in filtered(tree, c):
                    if isinstance(to, int) and len(tree.sums):
                        own[to] += tree.sums[node]
                    elif len(tree.sums):
                        np.add.at(own, to, tree.v[begin:end])
                    else:
                        np.add.at(own, to, tree.v[begin:end].astype(object)) if not isinstance(to, int) else own.__setitem__(to, own[to] + tree.v[begin:end].astype(object).sum(axis=0))
                    n += np.bincount(to, minlength=k) if not isinstance(to, int) else (np.arange(k) == to) * (end - begin)
                total += own.astype(object)
        some = np.flatnonzero(n)
        low = [(total[j] & ((1 << _HALF) - 1)).tolist() for j in some]
        high = [(total[j] >> _HALF).tolist() for j in some]
        yield pa.RecordBatch.from_pylist([{"cluster": int(j), "n": int(n[j]), "low": a, "high": b} for j, a, b in zip(some, low, high, strict=True)], schema=_PARTIAL)

    return run


def moved(trees: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the exact means; those without vectors stay."""
    k, d = c.shape
    sent = trees.sparkSession.sparkContext.broadcast(c)
    found = trees.mapInArrow(_count(k, d, sent), "cluster int, n long, low array<long>, high array<long>")
    parts = found.select("cluster", "n", F.posexplode(F.arrays_zip("low", "high")).alias("j", "s"))
    wide = "decimal(38,0)"
    rows = parts.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s.low").cast(wide)).alias("low"), F.sum(F.col("s.high").cast(wide)).alias("high")).collect()  # k x d
    out = c.copy()
    for r in rows:
        out[r["cluster"], r["j"]] = ((int(r["high"]) << _HALF) + int(r["low"])) // r["n"]
    return out


_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _assign(d: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                tree, to = _Tree(row, d), np.zeros(row["n"], np.int32)
                for _, begin, end, own in filtered(tree, c):
                    to[begin:end] = own
                off = tree.v - c[to] if _exact(tree.v, c) else tree.v.astype(object) - c[to].astype(object)
                far = (off * off).sum(axis=1)
                far = far if far.dtype == np.int64 else np.minimum(far, _MOST).astype(np.int64)
                for i in range(0, row["n"], 1000):
                    part = slice(i, i + 1000)
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"][part], pa.int64()), pa.array(to[part]), pa.array(far[part])], schema=_ASSIGNED)

    return run


def starts(numbers: DataFrame, k: int, prefix: str = "1:") -> np.ndarray:
    """The k vectors whose id has the smallest SHA-256, in its order."""
    key = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    rows = numbers.where("vec_id is not null").orderBy(key, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: float = SCALE, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of vectors (vec_id, embedding), written, and the final centroids."""
    if k < 1 or rounds < 0 or dimensions < 1:
        raise ValueError("centroid parameters out of range")
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors, scale, dimensions)
    c = starts(numbers, k)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    trees = materialize(numbers.mapInArrow(_pack, _TREE_ROWS), "trees")
    for _ in range(rounds):
        c = moved(trees, c)
    return materialize(trees.mapInArrow(_assign(dimensions, spark.sparkContext.broadcast(c)), "vec_id long, cluster int, distance long"), "assigned"), c


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster()'s rows with cluster_inertia, inertia and centroid_sha256."""
    spark = assigned.sparkSession
    by = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    inertia = {r["cluster"]: int(r["s"]) for r in by}
    said = [(j, min(inertia[j], _MOST), min(sum(inertia.values()), _MOST), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j in sorted(inertia)]
    table = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
