"""A matrix in tiles, and tall thin matrices in blocks of rows: products, and QR by a tree of blocks.

All lie on the executors as tables: tiles (i, j, m) and blocks (i, m) of float64 in row order. The driver gets
triangles of width x width only, whatever the lengths of the axes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.session import materialize, small

#: Rows and columns of a tile; bytes of blocks that may be broadcast; blocks that a task adds up at a time; triangles joined at a time.
SIDE, BROADCAST, HELD, FAN = 128, 64 << 20, 256, 64
#: Directions shorter than this part of the longest count as nothing.
NOTHING = 1e-12
_BLOCK = pa.schema([("i", pa.int64()), ("m", pa.binary())])


@dataclass(frozen=True)
class Tall:
    """blocks: i (number of the block of SIDE rows), m; length rows in all, width columns."""

    blocks: DataFrame
    length: int
    width: int

    def written(self) -> Tall:
        return Tall(materialize(self.blocks, "blocks"), self.length, self.width)


@dataclass(frozen=True)
class Tiles:
    """tiles: i, j, m of a matrix of so many rows and columns; what no tile has is 0."""

    tiles: DataFrame
    rows: int
    columns: int


def tiled(entries: DataFrame, rows: int, columns: int) -> Tiles:
    """entries (row, column, e) as written tiles; equal places add up."""
    at = lambda c: (F.floor(F.col(c) / SIDE).cast("long"), F.pmod(F.col(c), F.lit(SIDE)).cast("int"))
    (i, r), (j, c) = at("row"), at("column")
    own = entries.select(i.alias("i"), j.alias("j"), r.alias("r"), c.alias("c"), F.col("e").cast("double").alias("e"))

    def pack(table: pa.Table) -> pa.Table:
        m = np.zeros((SIDE, SIDE))
        np.add.at(m, (table.column("r").to_numpy(), table.column("c").to_numpy()), table.column("e").to_numpy())
        return pa.table({"i": table.column("i").slice(0, 1), "j": table.column("j").slice(0, 1), "m": pa.array([m.tobytes()], pa.binary())})

    return Tiles(materialize(own.groupBy("i", "j").applyInArrow(pack, "i long, j long, m binary"), "tiles"), rows, columns)


def gaussian(spark: SparkSession, length: int, width: int, seed: int) -> Tall:
    """A random matrix; each block has a generator of its own."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.random.default_rng([seed, i]).standard_normal((SIDE, width)).tobytes() for i in ids], pa.binary())], schema=_BLOCK)

    return Tall(spark.range(-(-length // SIDE)).withColumnRenamed("id", "i").mapInArrow(draw, "i long, m binary"), length, width)


def times(a: Tiles, x: Tall, transposed: bool = False) -> Tall:
    """a times x, or a transposed times x, written: tasks add up what they have of each block, groups of as many rows as tasks add up these."""
    width = x.width
    mine, other = ("j", "i") if transposed else ("i", "j")
    length = a.columns if transposed else a.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], schema=_BLOCK)

        for batch in batches:
            for i, m, z in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                tile = np.frombuffer(m.as_buffer(), float).reshape(SIDE, SIDE)
                part = (tile.T if transposed else tile) @ np.frombuffer(z.as_buffer(), float).reshape(SIDE, width)
                if i in held:
                    held[i] += part
                else:
                    if len(held) >= HELD:
                        yield out()
                        held = {}
                    held[i] = part
        if held:
            yield out()

    def add(table: pa.Table) -> pa.Table:
        # in an order of their own, so that reruns add up alike
        s = np.sum([np.frombuffer(m, float) for m in sorted(table.column("m").to_pylist())], axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "m": pa.array([s.tobytes()], pa.binary())})

    side = x.blocks.select(F.col("i").alias(other), F.col("m").alias("z"))
    both = a.tiles.join(small(side, -(-x.length // SIDE), BROADCAST // (SIDE * width * 8)), other).select(F.col(mine).alias("i"), "m", "z")
    return Tall(both.mapInArrow(run, "i long, m binary").groupBy("i").applyInArrow(add, "i long, m binary"), length, width).written()


def after(x: Tall, *steps: np.ndarray) -> Tall:
    """x times small matrices, one after the other."""
    width = x.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.column(1):
                block = np.frombuffer(m.as_buffer(), float).reshape(SIDE, width)
                for s in steps:
                    block = block @ s
                out.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=_BLOCK)

    return Tall(x.blocks.select("i", "m").mapInArrow(run, "i long, m binary"), x.length, steps[-1].shape[1])


def triangle(x: Tall) -> np.ndarray:
    """The triangle R of the QR of x: each task's of its blocks, then of FAN triangles at a time, then of what is left."""
    width = x.width

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        r = np.linalg.qr(np.vstack(parts), mode="r")
        return np.vstack([r, np.zeros((width - len(r), width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            parts += [np.frombuffer(m.as_buffer(), float).reshape(SIDE, width) for m in batch.column(1)]
            if len(parts) > FAN:
                parts = [joined(parts)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN], pa.int64()), pa.array([joined(parts).tobytes()], pa.binary())], schema=_BLOCK)

    def join(table: pa.Table) -> pa.Table:
        r = joined([np.frombuffer(m, float).reshape(width, width) for m in sorted(table.column("m").to_pylist())])
        return pa.table({"i": table.column("i").slice(0, 1), "m": pa.array([r.tobytes()], pa.binary())})

    found = x.blocks.select("i", "m").mapInArrow(run, "i long, m binary").groupBy("i").applyInArrow(join, "i long, m binary").collect()
    return joined([np.frombuffer(r["m"], float).reshape(width, width) for r in sorted(found)]) if found else np.zeros((width, width))


def directions(r: np.ndarray) -> np.ndarray:
    """A small matrix after which the columns of what has the triangle r are orthonormal, longest first; those of no length go."""
    _, s, vt = np.linalg.svd(r)
    known = s > NOTHING * max(s.max(initial=0), np.finfo(float).tiny)
    return vt[known].T / s[known]


def orthonormal(x: Tall) -> Tall:
    """The columns' span on an orthonormal basis, once more after a first time, as rounding leaves angles; x is a written one."""
    first = directions(triangle(x))
    if not first.shape[1]:
        return Tall(x.blocks.limit(0), x.length, 0)
    again = triangle(after(x, first))
    return after(x, first, np.linalg.inv(again))
