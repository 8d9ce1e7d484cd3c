"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training: of a bounded sample of labelled texts, documents that hold an n-gram
are counted by class; the ratio of an n-gram is the log of its smoothed share
among toxic documents over that among others. The FEATURES n-grams that tell
the classes apart best (by chi-squared) are kept, and a logistic regression is
fitted to presence times ratio. All texts are then scored whole.

Characters are code points, lower-cased (ASCII and Latin-1), white space as one
kind; n-grams are hashed to 2**BITS. Only the text is an input. Defined results: null
text is empty; an empty text has no n-grams, so its score is that of the
intercept; without labels of both classes every score is 0 or 1, the share of
label 1 (0 if there are none); of n-grams that tell the classes apart equally well
(ties) the smaller hashes are kept; each of several equal rows has its score; texts
of any length are read whole; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.words import columns, mix

LENGTHS, BITS = (4, 5), 20
#: Labelled documents that the model learns from, about, at most; n-grams kept; smoothing of counts.
SAMPLE, FEATURES, SMOOTHING = 12_000, 512, 1.0
_CHUNK = 1 << 20


def _characters(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, code points, where each text begins), some texts at a time."""
    data, offsets = columns(array)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        first = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # bytes that begin a character
        c = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        upper = ((c >= 65) & (c <= 90)) | ((c >= 192) & (c <= 222) & (c != 215))
        c = np.where(upper, c + 32, c)
        c = np.where((c <= 32) | (c == 160), 32, c).astype(np.uint64)
        yield lo, hi, c, first[offsets[lo : hi + 1] - offsets[lo]]
        lo = hi


def _ngrams(c: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of the n-grams of a chunk, none across texts."""
    for n in LENGTHS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x2545F4914F6CDD1D) + c[j : len(c) - n + 1 + j]
        inside = np.ones(len(c), bool)
        for j in range(1, n):
            inside[np.maximum(at[1:] - j, 0)[at[1:] >= j]] = False
        place = np.flatnonzero(inside[: len(h)])
        yield (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)[place], place


def _present(c: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) once each; only wanted n-grams, if given as a table."""
    keys = []
    for h, place in _ngrams(c, at):
        if wanted is not None:
            some = wanted[h]
            h, place = h[some], place[some]
        keys.append((np.searchsorted(at, place, "right") - 1 << BITS) + h)
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the n-grams present)))."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, array: pa.Array) -> np.ndarray:
        slot = np.zeros(1 << BITS, bool)
        slot[self.features] = True
        weight = np.zeros(1 << BITS)
        weight[self.features] = self.weights
        out = np.full(len(array), self.bias)
        for lo, hi, c, at in _characters(array):
            text, gram = _present(c, at, slot)
            out[lo:hi] += np.bincount(text, weights=weight[gram], minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


_COUNTS = pa.schema([("label", pa.int32()), ("gram", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        labels = batch.column(0).to_numpy()
        for lo, _, c, at in _characters(batch.column(1)):
            text, gram = _present(c, at)
            for y in (0, 1):
                total[y] += np.bincount(gram[labels[lo + text] == y], minlength=1 << BITS)
    label, gram = np.nonzero(total)
    for i in range(0, len(label), 200_000):
        part = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(label[part].astype(np.int32)), pa.array(gram[part].astype(np.int32)), pa.array(total[label[part], gram[part]])], schema=_COUNTS)


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent, deterministic."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    # the largest curvature, by power iteration
    v = np.ones(x1.shape[1], x1.dtype)
    for _ in range(30):
        v = x1.T @ (x1 @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / (0.25 * float(np.linalg.norm(x1 @ v) ** 2) / len(x) * 1.1 + l2)
    w = np.zeros(x1.shape[1])
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    u, old = w.copy(), w.copy()
    penalty = np.full(len(w), l2)
    penalty[-1] = 0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x1 @ u.astype(x1.dtype), -30, 30)))
        w = u - step * (x1.T @ (p - y) / len(y) + penalty * u)
        u = w + t / (t + 3) * (w - old)
        old = w
    return w[:-1], float(w[-1])


def train(labelled: DataFrame) -> Model:
    """labelled: (label 0 or 1, text), a bounded sample."""
    labelled = labelled.select(F.col("label").cast("int").alias("label"), "text")
    size = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    size = np.array([size.get(0, 0), size.get(1, 0)])
    if not size.all():
        share = float(size[1] > 0)
        return Model(np.zeros(0, np.int64), np.zeros(0), 500.0 if share else -500.0)
    summed = labelled.mapInArrow(_count, "label int, gram int, n long").groupBy("gram").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("n1")
    )
    # chi-squared of presence and class, on the executors; FEATURES rows reach the driver
    n, n0, n1 = float(size.sum()), F.col("n0"), F.col("n1")
    held = n0 + n1
    off = n1 * float(size[0]) - n0 * float(size[1])
    chi = n * off * off / (held * (n - held + 1) * float(size[0]) * float(size[1]))
    top = summed.where(held >= 3).orderBy(chi.desc(), "gram").limit(FEATURES).select("gram", "n0", "n1").collect()
    grams, counts = np.array([r["gram"] for r in top], np.int64), np.array([(r["n0"], r["n1"]) for r in top], float).reshape(-1, 2)
    if not len(grams):
        share = size[1] / size.sum()
        return Model(grams, np.zeros(0), float(np.log(share / (1 - share))))
    ratio = np.log((counts[:, 1] + SMOOTHING) / (size[1] + 2 * SMOOTHING)) - np.log((counts[:, 0] + SMOOTHING) / (size[0] + 2 * SMOOTHING))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[grams] = np.arange(len(grams))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, c, at in _characters(batch.column(1)):
                text, gram = _present(c, at, slot >= 0)
                x = np.zeros((hi - lo, len(grams)), bool)
                x[text, slot[gram]] = True
                packed = np.packbits(x, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in packed], pa.binary())], names=["label", "x"])

    found = sorted(labelled.mapInArrow(rows, "label int, x binary").collect(), key=lambda r: (r["label"], bytes(r["x"])))  # in one order, whatever the tasks
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.uint8).reshape(len(found), -1), axis=1)[:, : len(grams)]
    y = np.array([r["label"] for r in found], np.float64)
    w, bias = _fit(x.astype(np.float32) * ratio.astype(np.float32), y)
    return Model(grams, w * ratio, bias)


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample_of(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """(label, text) of about most labelled documents at most, chosen by a hash of their ids.

    A document labelled more than once counts with its largest label; of rows that repeat an id
    the one with the smallest text is learned from, so that the sample is bounded by its ids.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    parts = -(-known.count() // most)
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(max(1, parts))) == 0)
    # most rows at about 20 bytes: a bounded broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct("text")).alias("t")).select("label", "t.text")


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
