"""Low-rank response models: a basis by randomised SVD, multi-feature ridge and boosted trees on its scores.

The response matrix and all that is as long as an axis stay on the executors;
only matrices as long and as wide as there are components or features reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.operators import tall
from deltaloom.operators.cohorts import with_index
from deltaloom.session import materialize, small

EXTRA, POWERS = 8, 2


def _matrix(y: DataFrame) -> tuple[tall.Tiles, DataFrame]:
    """Centred responses in tiles, targets by genes, and the genes' axis (gene, idx, mean)."""
    genes = materialize(with_index(y, "gene", "idx").join(y.groupBy("gene").agg(F.avg("y").alias("mean")), "gene"), "genes")
    targets = materialize(with_index(y, "target", "row"), "targets")
    n_genes, n_targets = genes.count(), targets.count()
    e = y.join(small(genes, n_genes), "gene").join(small(targets, n_targets), "target")
    return tall.tiled(e.select("row", F.col("idx").alias("column"), (F.col("y") - F.col("mean")).alias("e")), n_targets, n_genes), genes


def response_basis(y: DataFrame, rank: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(target, gene, y) to mean (gene, mean) and basis (component, gene, v): orthonormal rows, written.

    Centre, sketch by a Gaussian matrix, POWERS power iterations with QR, then an
    SVD of the small side. Matrices as long as an axis stay on the executors (tall.py); components of no length are left out.
    Targets and genes are of any type; their ids stay what they are.
    """
    spark = y.sparkSession
    a, genes = _matrix(y)
    mean = genes.select("gene", "mean")
    width = min(rank + EXTRA, a.rows, a.columns)
    if not width:
        return mean, genes.select(F.lit(0).alias("component"), "gene", F.lit(0.0).alias("v")).limit(0)
    thin = lambda x: tall.after(x, tall.directions(tall.triangle(x)))
    q = tall.times(a, tall.gaussian(spark, a.columns, width, seed))
    for _ in range(POWERS):
        z = tall.times(a, thin(q), transposed=True)
        q = tall.times(a, thin(z))
    q = tall.orthonormal(q)
    if not q.width:
        return mean, genes.select(F.lit(0).alias("component"), "gene", F.lit(0.0).alias("v")).limit(0)
    # of the small side only the genes' directions are asked for, longest first
    v = tall.orthonormal(tall.times(a, q, transposed=True))
    width, rank = v.width, min(rank, v.width)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = np.frombuffer(m, float).reshape(tall.SIDE, width)[:, :rank]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i * tall.SIDE, (i + 1) * tall.SIDE)), pa.array(list(block), pa.list_(pa.float64()))], names=["idx", "vs"])

    wide = materialize(v.blocks.mapInArrow(rows, "idx long, vs array<double>"), "directions")
    # signs are arbitrary; fix them so that reruns agree: the largest value, of equal ones the first, is positive
    largest = lambda c: F.max(F.struct(F.round(F.abs(F.col("vs")[c]), 9), -F.col("idx"), F.signum(F.col("vs")[c]).alias("sign")))["sign"].alias(f"s{c}")
    signs = wide.agg(*(largest(c) for c in range(rank))).head()
    turned = F.array(*(F.col("vs")[c] * F.lit(float(signs[c] or 1.0)) for c in range(rank)))
    basis = genes.join(wide.select("idx", turned.alias("vs")), "idx").select(F.posexplode("vs").alias("component", "v"), "gene")
    return mean, materialize(basis.select("component", "gene", "v"), "basis")


def _wide(mean: DataFrame, basis: DataFrame) -> tuple[DataFrame, int]:
    """gene, mean, vs (values by component), to be joined by gene; the number of components."""
    vs = basis.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("component", "v"))).alias("c")).select("gene", F.col("c.v").alias("vs"))
    rank = basis.agg(F.coalesce(F.max("component") + 1, F.lit(0))).head()[0]
    return small(mean.join(vs, "gene")), rank


def project(y: DataFrame, mean: DataFrame, basis: DataFrame) -> DataFrame:
    """target, component, z: centred responses on the basis."""
    wide, rank = _wide(mean, basis)
    e = F.col("y") - F.col("mean")
    sums = y.join(wide, "gene").groupBy("target").agg(*(F.sum(e * F.col("vs")[c]).alias(f"z{c}") for c in range(rank)))
    return sums.select("target", F.posexplode(F.array(*(f"z{c}" for c in range(rank)))).alias("component", "z"))


def reconstruct(scores: DataFrame, mean: DataFrame, basis: DataFrame) -> DataFrame:
    """target, gene, p from scores (target, component, z): every target meets every gene, which is the result."""
    wide, rank = _wide(mean, basis)
    z = scores.groupBy("target").agg(*(F.sum(F.when(F.col("component") == c, F.col("z"))).alias(f"z{c}") for c in range(rank)))
    p = F.col("mean")
    for c in range(rank):
        p = p + F.coalesce(F.col(f"z{c}"), F.lit(0.0)) * F.col("vs")[c]
    return z.join(wide, how="cross").select("target", "gene", p.alias("p"))


#: Targets up to which exact_tail() takes their products with each other.
EXACT = 4096


def exact_tail(y: DataFrame, rank: int) -> tuple[float, float]:
    """What the best basis of a rank leaves of the centred responses' sum of squares, and the whole sum; from the targets' matrix of products.

    For acceptance of a basis that was found otherwise: the matrix, EXACT x EXACT at most, is the driver's. What is absent counts as 0.
    """
    targets = materialize(with_index(y, "target", "row"), "targets")
    n = targets.count()
    if n > EXACT:
        raise ValueError(f"{n} targets; products are taken of {EXACT} at most")
    mean = y.groupBy("gene").agg(F.avg("y").alias("mean"))
    rows = y.join(mean, "gene").join(small(targets, n), "target").groupBy("gene").agg(F.collect_list(F.struct("row", (F.col("y") - F.col("mean")).alias("e"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            own = np.zeros((batch.num_rows, n))
            for g, (at, e) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                own[g, at.values.to_numpy()] = e.values.to_numpy()
            total += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"m": pa.array([np.sum([np.frombuffer(m, float) for m in table.column("m").to_pylist()], axis=0).tobytes()], pa.binary())})

    found = rows.select("x.row", "x.e").mapInArrow(run, "m binary").groupBy().applyInArrow(add, "m binary").head()
    values = np.linalg.eigvalsh(np.frombuffer(found[0], float).reshape(n, n)) if found else np.zeros(1)
    return float(np.maximum(values, 0)[: max(0, len(values) - rank)].sum()), float(values.sum())


def basis_report(y: DataFrame, mean: DataFrame, basis: DataFrame) -> DataFrame:
    """One row: components, how far the basis is from orthonormal, what it leaves of the centred responses' sum of squares, and the whole sum."""
    wide, rank = _wide(mean, basis)
    pairs = [(a, b) for a in range(rank) for b in range(a, rank)]
    off = wide.agg(*(F.abs(F.sum(F.col("vs")[a] * F.col("vs")[b]) - F.lit(float(a == b))).alias(f"o{a}_{b}") for a, b in pairs)) if pairs else wide.agg(F.lit(0.0).alias("o"), F.lit(0.0).alias("p"))
    off = off.select(F.array_max(F.array(*off.columns)).alias("off"))
    p = reconstruct(project(y, mean, basis), mean, basis)
    e, m = F.col("y") - F.col("p"), F.col("y") - F.col("mean")
    left = y.join(p, ["target", "gene"]).join(small(mean), "gene").agg(F.sum(e * e).alias("left"), F.sum(m * m).alias("whole"))
    return off.join(left, how="cross").select(F.lit(rank).alias("components"), "off", "left", "whole")  # single rows


def ridge_sums(features: DataFrame, scores: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The Gram matrix of an intercept and the features (target, names), and their products with scores (target, component, z): two aggregates."""
    if not names:
        raise ValueError("ridge needs features")
    x = [F.lit(1.0), *(F.col(n) for n in names)]
    p = len(x)
    gram = features.agg(*(F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p))).head()
    a = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = gram[f"g{i}_{j}"]
    right = scores.join(features, "target").groupBy("component").agg(*(F.sum(x[i] * F.col("z")).alias(f"r{i}") for i in range(p))).orderBy("component").collect()
    return a, np.array([[r[f"r{i}"] for i in range(p)] for r in right]).T


def ridge_solve(sums: tuple[np.ndarray, np.ndarray], alpha: float) -> np.ndarray:
    """Coefficients (intercept first, unpenalised) x components; the small system is solved on the driver."""
    if alpha < 0:
        raise ValueError("the penalty is negative")
    gram, right = sums
    return np.linalg.solve(gram + np.diag([0.0] + [float(alpha)] * (len(gram) - 1)), right)


def ridge_fit(features: DataFrame, scores: DataFrame, names: list[str], alpha: float) -> np.ndarray:
    return ridge_solve(ridge_sums(features, scores, names), alpha)


def ridge_predict(features: DataFrame, names: list[str], w: np.ndarray) -> DataFrame:
    """target, component, z, by ridge_fit()'s coefficients."""
    parts = []
    for c in range(w.shape[1]):
        z = F.lit(float(w[0, c]))
        for i, n in enumerate(names):
            z = z + F.col(n) * F.lit(float(w[i + 1, c]))
        parts.append(F.struct(F.lit(c).alias("component"), z.alias("z")))
    return features.select("target", F.inline(F.array(*parts)))


_NODE = "component int, tree int, node int, feature int, threshold double, low int, high int, value double"


def _best_split(x: np.ndarray, g: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """Gain in squared error, feature and threshold of the best split into parts of least rows each."""
    n = len(g)
    if n < 2 * least:
        return None
    order = np.argsort(x, axis=0, kind="stable")
    values, left = np.take_along_axis(x, order, 0), np.cumsum(g[order], axis=0)[:-1]
    k = np.arange(1, n)[:, None]
    total = g.sum()
    gain = left**2 / k + (total - left) ** 2 / (n - k) - total**2 / n
    gain[(values[1:] <= values[:-1]) | (k < least) | (n - k < least)] = -np.inf
    feature, at = divmod(int(gain.T.argmax()), n - 1)
    best = float(gain[at, feature])
    return (best, feature, float((values[at, feature] + values[at + 1, feature]) / 2)) if best > 1e-12 else None


def grow_tree(x: np.ndarray, g: np.ndarray, leaves: int, least: int) -> list[list]:
    """[feature (-1: leaf), threshold, low, high, value] of each node: the leaf whose split gains most is split, until there are so many leaves."""
    nodes, rows = [[-1, 0.0, -1, -1, float(g.mean())]], {0: np.arange(len(g))}
    splits = {0: _best_split(x, g, least)}
    for _ in range(leaves - 1):
        open_ = [(s[0], -i) for i, s in splits.items() if s]
        if not open_:
            break
        i = -max(open_)[1]
        _, feature, threshold = splits.pop(i)
        own = rows.pop(i)
        below = x[own, feature] <= threshold
        nodes[i] = [feature, threshold, len(nodes), len(nodes) + 1, 0.0]
        for part in (own[below], own[~below]):
            rows[len(nodes)], splits[len(nodes)] = part, _best_split(x[part], g[part], least)
            nodes.append([-1, 0.0, -1, -1, float(g[part].mean())])
    return nodes


def _walk(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row comes to."""
    at = np.zeros(len(x), int)
    while (inner := nodes[at, 0] >= 0).any():
        here = nodes[at[inner]]
        low = x[inner, here[:, 0].astype(int)] <= here[:, 1]
        at[inner] = np.where(low, here[:, 2], here[:, 3]).astype(int)
    return nodes[at, 4]


def trees_fit(features: DataFrame, scores: DataFrame, names: list[str], leaves: int, rounds: int, rate: float, least: int) -> DataFrame:
    """Boosted regression trees for each component, as nodes: component, tree, node, feature, threshold, low, high, value.

    Squared error, trees grown leaf by leaf up to a number of leaves, no leaf
    of fewer than least targets. Tree -1 is the mean. Components are fitted side by side;
    one has a row for each target, as long as that axis.
    """
    if leaves < 2 or rounds < 1 or rate <= 0 or least < 1:
        raise ValueError("tree parameters out of range")

    def fit(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("target")
        x, z = table[names].to_numpy(float), table["z"].to_numpy(float)
        p = np.full(len(z), z.mean())
        out = [[-1, 0, -1, 0.0, -1, -1, p[0]]]
        for t in range(rounds):
            nodes = grow_tree(x, z - p, leaves, least)
            for n in nodes:
                n[4] *= rate
            p = p + _walk(np.array(nodes, float), x)
            out += [[t, i, *n] for i, n in enumerate(nodes)]
        found = pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "low", "high", "value"])
        found.insert(0, "component", key[0])
        return found

    return scores.join(features, "target").select("target", "component", "z", *names).groupBy("component").applyInPandas(fit, _NODE)


def trees_predict(model: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """target, component, z. The nodes, bounded by the settings they were fitted with, are sent to every task."""
    found = model.toPandas().sort_values(["component", "tree", "node"])
    parts = [(int(c), [t[["feature", "threshold", "low", "high", "value"]].to_numpy(float) for _, t in own.groupby("tree")]) for c, own in found.groupby("component")]
    sent = features.sparkSession.sparkContext.broadcast(parts)

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            x = table[names].to_numpy(float)
            for c, trees in sent.value:
                yield pd.DataFrame({"target": table["target"], "component": c, "z": sum(_walk(t, x) for t in trees)})

    kind = features.schema["target"].dataType.simpleString()
    return features.select("target", *names).mapInPandas(run, f"target {kind}, component int, z double")


def save_trees(model: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The nodes as one table, a folder for each component."""
    model.write.mode(mode).partitionBy("component").parquet(path)


def load_trees(spark, path: str) -> DataFrame:
    return spark.read.schema(_NODE).parquet(path)
