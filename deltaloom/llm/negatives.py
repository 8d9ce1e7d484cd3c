"""Hard negatives of labelled vectors: for each anchor and each of its positives, the best rows of other labels within a band of scores.

Blocks of anchors meet blocks of candidates in partitions by a group of anchors and a salt, twice. Both are one table, sorted
so that a group's anchors come first and each block is sent once: a join would send a pair of blocks for each meeting.
First each anchor's nearest rows of its own label are found. Then, for the candidates that a task has in hand, every anchor's
scores are computed as whole numbers and sorted in full, by score and id; a positive's upper limit is found by binary
search, and from there the first k entries down to its lower limit are read. What tasks hand on, k rows at most for each
positive, is ranked once more. Nothing is collected or broadcast, and no label's rows meet in one place. (Anchors have a copy
for every salt. Spark would broadcast them all, as its estimate leaves the copies out, hence no join there and merges elsewhere.)

Defined results: rows with a null vec_id, label or vector, or null or non-finite components
take no part; shorter vectors count as filled up with zeros; scaled components beyond
2**62 count as that, and scores beyond 64 bits as the nearest that fit; ties go to the smaller vec_id; an anchor
doesn't meet rows with its own id; of several rows with an anchor's id the one with the smallest label and
vector is the anchor; repeated rows count each, also as positives; limits are exact fractions; anchors without positives, and
positives without rows in their band, give no rows; an empty table gives none; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.session import materialize

SCALE, POSITIVES, NEGATIVES = 256.0, 5, 10
#: Percent of the positive's score that a negative's has at least and at most.
LOW, HIGH = 30, 90
ANCHORS, CANDIDATES = 256, 4096
#: Blocks of anchors that a task searches for at a time.
GROUP = 32
_FARTHEST = 2.0**62
_MOST = 2**63 - 1


def labelled_numbers(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, v: the rows that take part, their components as floor(scale * x)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-_FARTHEST), F.least(F.lit(_FARTHEST), x * F.lit(scale)))))
    return v.where(fine).select("vec_id", "label", scaled.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of vectors, the shorter ones filled up with zeros."""
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    d = int(sizes.max(initial=0))
    if len(values) == len(sizes) * d:
        return values.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d)[None, :] < sizes[:, None]] = values
    return out


def _narrow(m: np.ndarray) -> bytes:
    top = max(int(m.max(initial=0)), -1 - int(m.min(initial=0)))
    return m.astype(next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)).tobytes()


def _wide(m: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(m, {2: np.int16, 4: np.int32}.get(len(m) // max(1, n * d), np.int64)).reshape(n, d).astype(np.int64)


_BLOCK = pa.schema([("salt", pa.int32()), ("n", pa.int32()), ("d", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("m", pa.binary())])
_BLOCK_ROWS = "salt int, n int, d int, ids binary, labels binary, m binary"


def _pack(salts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, 0

        def block() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks()
            ids, m = own.column("vec_id").to_numpy(), _matrix(own.column("v").combine_chunks())
            # a block's salt depends on what it holds, not on the task that packs it
            row = {"salt": (int(ids[0]) * 31 + done) % salts, "n": len(ids), "d": m.shape[1], "ids": ids.tobytes(), "labels": own.column("label").to_numpy().tobytes(), "m": _narrow(m)}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, CANDIDATES - size)
                held.append(part)
                size += part.num_rows
                batch = batch.slice(part.num_rows)
                if size == CANDIDATES:
                    yield block()
                    held, size, done = [], 0, done + 1
        if size:
            yield block()

    return pack


_ANCHORS = pa.schema([("part", pa.int32()), *(f for f in _BLOCK if f.name != "salt"), ("scores", pa.binary())])
_ANCHOR_ROWS = "part int, n int, d int, ids binary, labels binary, m binary, scores binary"
_NONE = -(2**63)


def _pack_anchors(table: pa.Table) -> Iterator[pa.RecordBatch]:
    part = table.column("part")[0].as_py()
    rows = []
    for batch in table.combine_chunks().to_batches(max_chunksize=ANCHORS):
        m = _matrix(batch.column("v"))
        row = {"part": part, "n": batch.num_rows, "d": m.shape[1], "ids": batch.column("vec_id").to_numpy().tobytes(), "labels": batch.column("label").to_numpy().tobytes(), "m": _narrow(m)}
        if "scores" in table.column_names:
            scores = np.array([s + [_NONE] * (POSITIVES - len(s)) for s in batch.column("scores").to_pylist()], np.int64)
            row["scores"] = scores.tobytes()
        rows.append(row)
    return pa.Table.from_pylist(rows, schema=_ANCHORS)


def _scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly; what 64 bits don't hold is cut."""
    d = min(a.shape[1], c.shape[1])
    a, c = a[:, :d], c[:, :d]
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * d
    if most < 2.0**52:  # whole numbers below 2**53 are exact in float64
        return (a.astype(float) @ c.T.astype(float)).astype(np.int64)
    return np.clip(a.astype(object) @ c.T.astype(object), -_MOST, _MOST).astype(np.int64) if d else np.zeros((len(a), len(c)), np.int64)


_FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_ROWS = "anchor_id long, place int, vec_id long, score long"


class _Anchors:
    """A block of anchors and what has been found for each so far: candidates' scores and ids, best first."""

    def __init__(self, row: dict) -> None:
        n, d = row["n"], row["d"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.m = _wide(row["m"], n, d)
        positives = row["scores"]
        #: The positives' scores, a row for each anchor; without them rows of the own label are looked for.
        self.positives = np.frombuffer(positives, np.int64).reshape(n, POSITIVES) if positives else None
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def meet(self, row: dict, k: int) -> None:
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        scores = _scores(self.m, _wide(row["m"], row["n"], row["d"]))
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)  # all scores of each anchor
        for i in range(len(self.ids)):
            by = order[i]
            same = labels[by] == self.labels[i]
            by = by[(same if self.positives is None else ~same) & (ids[by] != self.ids[i])]
            down, own = -scores[i, by], ids[by]
            if self.positives is None:
                self._keep((i, 0), down[:k], own[:k], k)
                continue
            for place, p in enumerate(self.positives[i].tolist()):
                if p == _NONE or p < 0:  # of a negative score the limits cross
                    continue
                first = int(np.searchsorted(down, -(HIGH * p // 100)))
                last = min(first + k, int(np.searchsorted(down, (-LOW * p) // 100, "right")))
                if last > first:
                    self._keep((i, place), down[first:last], own[first:last], k)

    def _keep(self, key: tuple[int, int], down: np.ndarray, ids: np.ndarray, k: int) -> None:
        if key in self.held:
            down, ids = (np.concatenate(x) for x in zip(self.held[key], (down, ids), strict=True))
            best = np.lexsort((ids, down))[:k]
            down, ids = down[best], ids[best]
        self.held[key] = down, ids

    def rows(self) -> pa.RecordBatch:
        parts = [(np.full(len(ids), self.ids[i]), np.full(len(ids), place, np.int32), ids, -down) for (i, place), (down, ids) in self.held.items() if len(ids)]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 2]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_FOUND)


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[bytes, _Anchors] = {}
        group = None
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time, as a batch holds many blocks
                row = batch.slice(i, 1).to_pylist()[0]
                if row["group"] != group:  # the final ranking merges what is handed on early
                    for block in blocks.values():
                        yield block.rows()
                    blocks, group = {}, row["group"]
                if row["candidate"]:
                    for block in blocks.values():
                        block.meet(row, k)
                elif row["ids"] not in blocks:  # else known from another salt
                    blocks[row["ids"]] = _Anchors(row)
        for block in blocks.values():
            yield block.rows()

    return search


def _meet(anchors: DataFrame, candidates: DataFrame, blocks: int, salts: int, k: int) -> DataFrame:
    """The k first rows of each anchor and place over all candidates: anchor_id, place, rank, vec_id, score."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("part")
    # a task for each block, as each becomes a copy for every salt; Spark would join the small partitions to one
    packed = anchors.select(part, *anchors.columns).repartition(blocks, "part").groupBy("part").applyInArrow(_pack_anchors, _ANCHOR_ROWS)
    a = packed.withColumn("group", (F.col("part") / GROUP).cast("int")).drop("part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("candidate", F.lit(False))
    c = candidates.withColumns({"group": F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // GROUP))), "candidate": F.lit(True), "scores": F.lit(None).cast("binary")})
    both = a.unionByName(c).repartition("group", "salt").sortWithinPartitions("group", "salt", "candidate")
    found = both.drop("salt").mapInArrow(_search(k), _FOUND_ROWS)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: float = SCALE, k: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank over vectors (vec_id, embedding, label)."""
    salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = labelled_numbers(vectors, scale)
    anchors = numbers.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v")
    anchors = materialize(anchors, "anchors")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    candidates = materialize(numbers.mapInArrow(_pack(salts), _BLOCK_ROWS), "candidates")
    salts = min(salts, max(1, candidates.count()))  # more would be copies of anchors that meet nothing
    candidates = candidates.withColumn("salt", F.pmod("salt", F.lit(salts)))
    positives = materialize(_meet(anchors, candidates, blocks, salts, POSITIVES).select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    found = _meet(anchors.hint("merge").join(scores, "vec_id"), candidates, blocks, salts, k)
    found = found.select("anchor_id", (F.col("place") + 1).alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.hint("merge").join(positives, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
