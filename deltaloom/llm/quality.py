"""Quality classifier by co-training.

Two views of a document, text content and page metadata, have a classifier each.
In every round each classifier labels the unlabelled documents it is confident
about, and these join the other's training set. The views are then calibrated
on labelled documents set aside, combined, and used to score every document.

Text content: numbers and shares of kinds of characters and of words, and repetition.
Metadata: what is stated beside the text, not read from it: source, language and
length. Both are cut into bins; a classifier is a logistic regression over them.

The models learn from about SAMPLE labelled and SAMPLE unlabelled documents,
chosen by a hash of their ids; scoring covers every document. Defined results:
null text is empty; null or absent metadata is a value of its own; a document labelled
more than once has its smallest label; rows with a null doc_id are scored, but
not learned from; each of several equal rows has its score; texts of any length are read
whole; without labels of both classes all documents are kept, with score 1; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.words import split

SAMPLE, ROUNDS, CONFIDENT, PER_ROUND, BINS = 6_000, 4, 0.97, 600, 12
#: Documents with a score below are rejected.
KEEP = 0.3
META = ("lang", "source", "n_chars")

_KINDS = np.zeros((256, 6), bool)
_KINDS[ord("A") : ord("Z") + 1, 0] = True
_KINDS[ord("a") : ord("z") + 1, 1] = True
_KINDS[ord("0") : ord("9") + 1, 2] = True
_KINDS[[*b".,;:'\"()-?"], 3] = True
_KINDS[[*b"!#$%&*+/<=>@[\\]^_`{|}~"], 4] = True
_KINDS[128:, 5] = True


def text_features(array: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    out = []
    for w in split(array):
        n = w.hi - w.lo
        sums = [np.concatenate([[0], np.cumsum(_KINDS[w.data, k])])[w.text_at] for k in range(6)]
        size = np.maximum(np.diff(w.text_at), 1)
        kinds = np.stack([np.diff(s) / size for s in sums], axis=1)
        words = np.maximum(w.counts(), 1)
        of, hashes = w.text_of(), w.hashes(lower=True)
        length = w.ends - w.starts
        order = np.lexsort((hashes, of))
        h, o = hashes[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        begin = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, o[begin], np.diff(np.append(begin, len(h))))
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        last = w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
        share = lambda flag: np.bincount(of[flag], minlength=n) / words  # noqa: B023, E731
        rows = [
            np.log1p(w.counts()), np.bincount(of, weights=length, minlength=n) / words, np.bincount(o[begin], minlength=n) / words, most / words,
            share(again), share(length == 1), share(length > 20), share(_KINDS[last, 4]), share(_KINDS[last, 3]), share(_KINDS[w.data[w.starts], 0]) if len(w.starts) else np.zeros(n),
        ]
        out.append(np.hstack([kinds, np.stack(rows, axis=1)]))
    return np.vstack(out) if out else np.zeros((0, 16))


def meta_features(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Two columns of hashed values, and numbers, for each row."""

    def value(name: str) -> np.ndarray:
        if name not in names:
            return np.zeros(batch.num_rows)
        values = batch.column(names.index(name)).to_pylist()
        return np.array([0 if v is None else 1 + sum((i + 1) * b for i, b in enumerate(str(v).encode())) % 63 for v in values], float)

    n_chars = pc.fill_null(batch.column(names.index("n_chars")).cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False) if "n_chars" in names else np.full(batch.num_rows, -1.0)
    return np.stack([value("lang"), value("source"), np.log1p(np.maximum(n_chars, -0.5))], axis=1)


@dataclass
class View:
    """Logistic regression over binned features; codes: how many leading-code columns are values, not numbers."""

    codes: list[int] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def bins(self, x: np.ndarray) -> np.ndarray:
        out, base = [], 0
        for j, cut in enumerate(self.cuts):
            b = x[:, j].astype(int) if j in self.codes else np.searchsorted(cut, x[:, j], "right")
            out.append(base + b)
            base += 64 if j in self.codes else len(cut) + 1
        return np.stack(out, axis=1)

    def prepare(self, x: np.ndarray) -> View:
        self.cuts = [np.zeros(0) if j in self.codes else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        b = self.bins(x)
        size = sum(64 if j in self.codes else len(c) + 1 for j, c in enumerate(self.cuts)) + 1
        dense = np.zeros((len(b), size))
        dense[np.arange(len(b))[:, None], b] = 1
        dense[:, -1] = 1
        self.weights = logistic(dense, y)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1) + self.weights[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    text: View
    meta: View
    text_scale: np.ndarray  # of the calibrated view: logit = scale * z + shift
    meta_scale: np.ndarray
    mixed: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale[0] * self.text.logits(text) + self.text_scale[1]
        b = self.meta_scale[0] * self.meta.logits(meta) + self.meta_scale[1]
        return sigmoid(a), sigmoid(b), sigmoid(self.mixed[0] * a + self.mixed[1] * b + self.mixed[2])


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """y: 1, 0, or -1 for unlabelled. None if the labelled part doesn't have both classes on both its sides."""
    known = np.flatnonzero(y >= 0)
    aside, own = known[::4], np.setdiff1d(known, known[::4])
    if min(len(set(y[aside])), len(set(y[own]))) < 2:
        aside = own = known
        if len(set(y[known])) < 2:
            return None
    views = [View().prepare(text), View(codes=[0, 1]).prepare(meta)]
    data = [text, meta]
    labels = [{int(i): float(y[i]) for i in own} for _ in views]

    def scale(k: int) -> np.ndarray:
        z = views[k].logits(data[k][aside])
        return logistic(np.stack([z, np.ones(len(z))], axis=1), y[aside].astype(float), 1e-2)

    def fit(k: int) -> None:
        i = np.array(sorted(labels[k]))
        views[k].fit(data[k][i], np.array([labels[k][int(j)] for j in i]))

    for k in (0, 1):
        fit(k)
    for _ in range(rounds):
        added = 0
        for k in (0, 1):
            free = np.array([i for i in np.flatnonzero(y < 0) if int(i) not in labels[1 - k]], int)
            if not len(free):
                continue
            s, t = scale(k)
            p = sigmoid(s * views[k].logits(data[k][free]) + t)
            sure = np.maximum(p, 1 - p)
            for j in np.argsort(-sure, kind="stable")[:PER_ROUND]:
                if sure[j] >= CONFIDENT:
                    labels[1 - k][int(free[j])] = float(p[j] >= 0.5)
                    added += 1
        if not added:
            break
        for k in (0, 1):
            fit(k)
    sa, sb = scale(0), scale(1)
    a, b = (s[0] * v.logits(x[aside]) + s[1] for v, x, s in zip(views, data, (sa, sb), strict=True))
    mixed = logistic(np.stack([a, b, np.ones(len(a))], axis=1), y[aside].astype(float), 1e-2)
    return Model(views[0], views[1], sa, sb, mixed)


def _inputs(docs: DataFrame) -> list[str]:
    """Columns that the views read: text first, then the metadata there is."""
    return ["text", *(c for c in META if c in docs.columns)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """labels: (doc_id, quality 0 or 1). Only feature rows of the sample reach the driver: of rows that repeat an id one, of those without an id none."""
    names = _inputs(docs)
    docs = docs.select("doc_id", *names).where("doc_id is not null")
    labels = labels.where("doc_id is not null")
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    hashed = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    n_docs, n_known = docs.agg(F.approx_count_distinct("doc_id")).head()[0], known.count()  # ids, however many rows have them; the estimate doesn't depend on their order
    # twice as many candidates as wanted, labelled or not, then each part to its own share
    known = known.where(hashed < min(1.0, sample / max(1, n_known)))
    known = docs.join(F.broadcast(known), "doc_id").select(F.col("doc_id").alias("k"), "y", *names)
    last = hashed >= 1 - min(1.0, sample / max(1, n_docs, n_known))  # as few ids of labels as of documents
    rest = docs.where(last).join(F.broadcast(labels.where(last).select("doc_id").distinct()), "doc_id", "left_anti")
    rest = rest.select(F.col("doc_id").alias("k"), F.lit(-1.0).alias("y"), *names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(list(range(2, batch.num_columns)))
            x = np.hstack([text_features(own.column(0)), meta_features(own, names)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "y", "x"])

    # an id's rows become one where they are made, so that the sample is bounded by its ids
    one = known.union(rest).mapInArrow(rows, "k long, y double, x array<double>").groupBy("k").agg(F.min(F.struct("y", "x")).alias("r"))
    found = one.select("k", "r.y", "r.x").toArrow().sort_by([("k", "ascending")])
    if not found.num_rows:
        return None
    x = np.array(found.column("x").to_pylist())
    return co_train(x[:, :16], x[:, 16:], found.column("y").to_numpy().astype(int))


def _scores(model: Model | None, batch: pa.RecordBatch, names: list[str], text: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model is None:
        return (np.ones(batch.num_rows),) * 3
    return model.scores(text_features(batch.column(text)), meta_features(batch, names))


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep for each row of docs (doc_id, text and metadata)."""
    names = _inputs(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(list(range(1, batch.num_columns)))
            a, b, s = _scores(model, own, names, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(s), pa.array(s >= KEEP)], names=["doc_id", "text_score", "meta_score", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *names).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs, all columns, without the rows that the model rejects."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch, names, at)[2] >= KEEP))

    return docs.mapInArrow(run, docs.schema)
