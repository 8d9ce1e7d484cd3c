"""Exact top-k search by inner product: columnar branch and bound.

Vectors lie in vertical layout (one row of a block holds one dimension of many
vectors). Scores are accumulated dimension block by dimension block; by Cauchy
and Schwarz what the remaining dimensions can add is at most the product of the
remaining lengths, so pairs that cannot reach the query's k-th best score are
dropped and the survivors compacted.

Blocks of queries meet blocks of candidates in partitions by a group of GROUP
query blocks and a salt, in one table, sorted so that a group's queries come first: candidates
are sent once for each group, query blocks once for each salt, as the smallest integers that
hold them. Nothing is collected or broadcast; in a join Spark would broadcast the queries'
copies for every salt where it takes the queries to be few.

Defined results: vectors that are null, or hold null or non-finite components,
take no part, nor do rows with a null vec_id; shorter vectors, empty ones too, count as
filled up with zeros; scaled components beyond 2**62 count as that, and scores beyond 64
bits as the nearest that fit; ties go to the smaller vec_id; a query does not
meet rows with its own id; repeated candidate rows count each; of several vectors with
a query's id the smallest, by component, is the query; fewer than k candidates: all; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024.0
QUERIES, CANDIDATES, DIMENSIONS = 512, 2048, 16
#: Query blocks that a task searches for at a time.
GROUP = 64
_MOST = 2.0**62
_PACKED = "part int, n int, d int, ids binary, m binary"


def _vertical(ids: list[int], vectors: list[np.ndarray]) -> dict:
    d = max(len(v) for v in vectors)
    if all(len(v) == d for v in vectors):
        m = np.ascontiguousarray(np.stack(vectors, axis=1))
    else:
        m = np.zeros((d, len(vectors)), dtype=np.int64)
        for j, v in enumerate(vectors):
            m[: len(v), j] = v
    top = int(max(m.max(initial=0), -1 - m.min(initial=0)))
    kind = next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
    return {"n": len(vectors), "d": d, "ids": np.asarray(ids, np.int64).tobytes(), "m": m.astype(kind).tobytes()}


def _matrix(m: bytes, d: int, n: int) -> np.ndarray:
    """A block as _vertical() packs it."""
    kind = {2: np.int16, 4: np.int32}.get(len(m) // max(1, d * n), np.int64)
    return np.frombuffer(m, kind).reshape(d, n)


def _scaled(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v * SCALE), -_MOST, _MOST).astype(np.int64)


def _valid(batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
    """Ids and scaled integer vectors of the rows that take part."""
    ids, out = [], []
    column = batch.column(1)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)  # nulls become NaN
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if len(column) and not column.null_count and not batch.column(0).null_count and (lengths == lengths[0]).all() and lengths[0]:
        m = values.reshape(len(column), -1)
        fine = np.isfinite(m).all(axis=1)
        return batch.column(0).to_numpy()[fine].tolist(), list(_scaled(m[fine]))
    at = 0
    for i, key in enumerate(batch.column(0).to_pylist()):
        if not column[i].is_valid:
            continue
        v = values[at : at + int(lengths[i])]
        at += int(lengths[i])
        if key is not None and np.isfinite(v).all():
            ids.append(key)
            out.append(_scaled(v))
    return ids, out


def _pack(size: int, salts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                ids, vectors = _valid(batch.slice(lo, size))
                if ids:
                    # a block's salt depends on what it holds, not on the task that packs it
                    row = {"part": (ids[0] * 31 + k) % salts, **_vertical(ids, vectors)}
                    k += 1
                    yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    return pack


_SCHEMA = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("d", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())])


def _pack_group(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    rows = []
    for batch in table.select(["vec_id", "v"]).combine_chunks().to_batches(max_chunksize=QUERIES):
        ids, vectors = _valid(batch)
        if ids:
            rows.append({"part": part, **_vertical(ids, vectors)})
    return pa.Table.from_pylist(rows, schema=_SCHEMA)


class _Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, k: int) -> None:
        self.ids, self.m, self.k = ids, m, k
        self.scores = np.full((len(ids), 0), 0, np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.rest = _rest(m)

    def floor(self) -> np.ndarray | None:
        return self.scores[:, -1] if self.scores.shape[1] == self.k else None

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """q: the queries' rows, of the same length as ids and scores."""
        old = self.scores.shape[1]
        allq = np.concatenate([np.repeat(np.arange(len(self.ids)), old), q])
        alls, alli = np.concatenate([self.scores.ravel(), scores]), np.concatenate([self.found.ravel(), ids])
        order = np.lexsort((alli, -alls, allq))
        allq, alls, alli = allq[order], alls[order], alli[order]
        first = np.searchsorted(allq, np.arange(len(self.ids)))
        rank = np.arange(len(allq)) - first[allq]
        keep = rank < self.k
        width = int(rank[keep].max(initial=-1)) + 1
        # queries with fewer are filled with a mark
        s, i = np.full((len(self.ids), width), np.iinfo(np.int64).min), np.full((len(self.ids), width), -1)
        s[allq[keep], rank[keep]], i[allq[keep], rank[keep]] = alls[keep], alli[keep]
        self.scores, self.found = s, i


def _rest(m: np.ndarray) -> np.ndarray:
    """Lengths of what is left of each vector before each block of dimensions, rounded up."""
    squares = (m.astype(np.float64) ** 2)[::-1].cumsum(axis=0)[::-1]
    return np.vstack([np.sqrt(squares[::DIMENSIONS]) * (1 + 1e-9), np.zeros((1, m.shape[1]))])


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All scores where 64 bits may not hold them, by whole numbers of any size."""
    most, shared = np.iinfo(np.int64).max, min(len(q), len(c))
    exact = q[:shared].T.astype(object) @ c[:shared].astype(object) if shared else np.zeros((q.shape[1], c.shape[1]), object)
    return np.clip(exact, -most, most).astype(np.int64)


def _search(best: _Best, ids: np.ndarray, m: np.ndarray) -> None:
    d = max(len(m), len(best.m))
    if float(np.abs(m.astype(float)).max(initial=0)) * float(np.abs(best.m.astype(float)).max(initial=0)) * d >= 2.0**52:
        scores = _products(best.m, m)
        q, c = np.nonzero(best.ids[:, None] != ids[None, :])
        best.add(q, ids[c], scores[q, c])
        return
    qm, cm = best.m.astype(np.float64), m.astype(np.float64)  # whole numbers below 2**53 are exact in float64
    low, qrest, crest = best.floor(), best.rest, _rest(m)
    nq, nc = len(best.ids), len(ids)
    score = np.zeros((nq, nc), qm.dtype)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    steps = (min(len(m), len(best.m)) + DIMENSIONS - 1) // DIMENSIONS
    for b in range(steps):
        part = slice(b * DIMENSIONS, min((b + 1) * DIMENSIONS, len(m), len(best.m)))
        if pairs is None:
            score = score + qm[part].T @ cm[part]
        else:
            q, c = pairs
            score = score + (qm[part][:, q] * cm[part][:, c]).sum(axis=0)
        if low is None or b + 1 >= steps:
            continue
        if pairs is None:
            alive = score + qrest[b + 1][:, None] * crest[b + 1][None, :] + 1 >= low[:, None]
            if alive.mean() < 0.2:
                pairs = np.nonzero(alive)
                score = score[pairs]
            elif not (some := alive.any(axis=0)).all():  # candidates that no query can use
                ids, cm, crest, score = ids[some], cm[:, some], crest[:, some], score[:, some]
        else:
            q, c = pairs
            alive = score + qrest[b + 1][q] * crest[b + 1][c] + 1 >= low[q]
            pairs, score = (q[alive], c[alive]), score[alive]
    if pairs is None:
        if low is None and score.shape[1] > best.k:
            own = best.ids[:, None] == ids[None, :]  # any number of rows may have the query's id
            others = np.where(own, -np.inf, score)
            at = -np.partition(-others, best.k - 1, axis=1)[:, best.k - 1]
            pairs = np.nonzero((score >= at[:, None]) & ~own)
        else:
            pairs = np.nonzero(score >= low[:, None]) if low is not None else tuple(x.ravel() for x in np.indices(score.shape))
        score = score[pairs]
    elif low is not None:
        keep = score >= low[pairs[0]]
        pairs, score = (pairs[0][keep], pairs[1][keep]), score[keep]
    q, c = pairs
    other = ids[c] != best.ids[q]
    best.add(q[other], ids[c[other]], score[other].astype(np.int64))


def _search_blocks(k: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def rows(best: _Best) -> pa.RecordBatch:
        full = (best.scores != np.iinfo(np.int64).min).ravel()
        q = np.repeat(best.ids, best.scores.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(x[full]) for x in (q, best.found.ravel(), best.scores.ravel())], schema=out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: dict[bytes, _Best] = {}
        group = None
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time, as a batch holds many blocks
                r = batch.slice(i, 1).to_pylist()[0]
                if r["group"] != group:  # the final ranking merges what is handed on early
                    for best in bests.values():
                        yield rows(best)
                    bests, group = {}, r["group"]
                ids, m = np.frombuffer(r["ids"], np.int64), _matrix(r["m"], r["d"], r["n"])
                if r["candidate"]:
                    for best in bests.values():
                        _search(best, ids, m)
                elif r["ids"] not in bests:  # else known from another salt
                    bests[r["ids"]] = _Best(ids, m, k)
        for best in bests.values():
            yield rows(best)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score over vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    queries = v.where(is_query & F.col("vec_id").isNotNull() & finite).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // QUERIES))
    groups, salts = -(-blocks // GROUP), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a task for each block, as each becomes a copy for every salt; Spark would join the small partitions to one
    packed = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("part"), "vec_id", "v").repartition(blocks, "part").groupBy("part").applyInArrow(_pack_group, _PACKED)
    block = ("n", "d", "ids", "m")
    q = packed.select((F.col("part") / GROUP).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("candidate"), *block)
    c = v.mapInArrow(_pack(CANDIDATES, salts), _PACKED)
    c = c.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.col("part").alias("salt"), F.lit(True).alias("candidate"), *block)
    both = q.unionByName(c).repartition("group", "salt").sortWithinPartitions("group", "salt", "candidate")
    found = both.drop("salt").mapInArrow(_search_blocks(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
