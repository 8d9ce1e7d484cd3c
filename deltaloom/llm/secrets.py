"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

One model is trained on random strings, one on ordinary words and identifiers,
from labelled samples: what the patterns capture in a sample of documents, and
random strings drawn here, against the other words of that sample with
identifiers made of them, and names that programs have. A run of characters is a secret if its mean
log-likelihood ratio for each character reaches MEAN. Of a run that doesn't, as
an ordinary name joined to a secret, those fields between '=' are secrets that
do, and in other fields the best stretches of whole pieces between '/' and '_'.

Defined results: null text is empty; spans are in code points, end exclusive, and come
by start, those with one start (ties) by kind; a run inside a span found by pattern isn't
reported again; each of several equal rows has its spans; texts of any length are read
whole; an empty table gives no rows, models of what is drawn and named here, and no
crash; other columns are not read, whatever their names.
"""

from __future__ import annotations

import importlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.words import split

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Every match of ASSIGN holds one of these, in lower case.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Runs of at least so many characters are scored; the ratio at which one is a secret; documents the models learn from, about.
RUN, MEAN, SAMPLE = 16, 0.3, 4000
#: No pair of characters counts for more.
LIMIT = 3.0

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
#: What joins a name and a secret in one run.
_JOINT = np.zeros(256, bool)
_JOINT[[*b"=/_"]] = True
_N = 68
#: Bytes as states; 0 is before the first.
_STATE = np.zeros(256, np.int64)
_STATE[np.flatnonzero(_RUN)] = np.arange(1, _RUN.sum() + 1)


def _runs(data: np.ndarray, text_at: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of the table's bytes, none across texts."""
    mark = np.zeros(len(data) + 2, np.int8)
    mark[1:-1] = table[data]
    change = np.diff(mark)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cut = text_at[1:-1]
    cut = cut[(mark[cut] == 1) & (mark[np.minimum(cut + 1, len(mark) - 1)] == 1)]
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, tuple[int, int]]]:
    """(start, kind, end, captured) in bytes. runs: of hex digits in this text."""
    low = raw.lower()
    out = []
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end(), m.span(2)) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.span()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LEAST]
    return sorted(out + [(a, 2, b, (a, b)) for a, b in runs])


def _pairs(strings: list[bytes]) -> np.ndarray:
    """Counts of successive states, each string after state 0."""
    data = _STATE[np.frombuffer(b"\0" + b"\0".join(strings) + b"\0", np.uint8)]
    return np.bincount(data[:-1] * _N + data[1:], minlength=_N * _N).reshape(_N, _N)


@dataclass
class Markov:
    """Log-likelihood ratios of each character after another: random strings against ordinary ones."""

    ratio: np.ndarray

    @classmethod
    def fit(cls, secret: list[np.ndarray], plain: list[np.ndarray], weight: float = 3.0) -> Markov:
        """From counts of pairs; the samples of a side have equal say, whatever their sizes."""

        def logs(samples: list[np.ndarray]) -> np.ndarray:
            parts = []
            for n in samples:
                n = n.astype(float)
                n[:, 0] = 0  # ends don't count
                parts.append((n + weight / (_N - 1)) / (n.sum(axis=1, keepdims=True) + weight))
            return np.log(np.mean(parts, axis=0))

        return cls(np.clip(logs(secret) - logs(plain), -LIMIT, LIMIT))

    def sums(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of ratios where runs begin at starts, and ratios of characters that begin a run."""
        state = _STATE[data]
        before = np.concatenate([[0], state[:-1]]) if len(state) else state
        r, first = self.ratio[before, state], self.ratio[0, state]
        r[starts] = first[starts]
        return np.concatenate([[0], np.cumsum(r)]), first

    def mean(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums, _ = self.sums(data, starts)
        return (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)

    def secrets(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the secrets in runs, in order."""
        sums, first = self.sums(data, starts)
        high = (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1) >= MEAN
        joints = np.concatenate([[0], np.cumsum(_JOINT[data])])
        found = [np.stack([starts[high], ends[high]], axis=1)]
        # by how much a stretch exceeds MEAN is over[end] - under[start]
        over = sums - MEAN * np.arange(len(sums))
        under = over[1:] - first + MEAN
        for i in np.flatnonzero(~high & (joints[ends] > joints[starts])):
            fields = _cut(data, int(starts[i]), int(ends[i]), b"=")
            for a, b in fields[fields[:, 1] - fields[:, 0] >= RUN].tolist():
                if over[b] >= under[a]:
                    found.append(np.array([[a, b]]))
                elif joints[b] > joints[a]:
                    found += _stretches(over, under, _cut(data, a, b, b"/_"))
        both = np.concatenate(found)
        return tuple(both[np.argsort(both[:, 0], kind="stable")].T)


def _cut(data: np.ndarray, a: int, b: int, at: bytes) -> np.ndarray:
    """(start, end) of the pieces of data[a:b] between any of the bytes at."""
    cuts = a + np.flatnonzero(np.isin(data[a:b], np.frombuffer(at, np.uint8)))
    return np.stack([np.concatenate([[a], cuts + 1]), np.concatenate([cuts, [b]])], axis=1)


def _stretches(over: np.ndarray, under: np.ndarray, pieces: np.ndarray) -> list[np.ndarray]:
    """The stretch of successive pieces, RUN characters or more, that exceeds MEAN by most, and those beside it."""
    found, left = [], [pieces[pieces[:, 0] < pieces[:, 1]]]
    while left:
        p = left.pop()
        if not len(p) or p[-1, 1] - p[0, 0] < RUN:
            continue
        low = under[p[:, 0]]
        least = np.minimum.accumulate(low)
        last = np.searchsorted(p[:, 0], p[:, 1] - RUN, "right") - 1  # the last piece that may begin a stretch to this end
        gain = np.where(last >= 0, over[p[:, 1]] - least[last], -np.inf)
        j = int(gain.argmax())
        if gain[j] < 0:
            continue
        i = int(low[: last[j] + 1].argmin())
        found.append(np.array([[p[i, 0], p[j, 1]]]))
        left += [p[:i], p[j + 1 :]]
    return found


def drawn_secrets(seed: int = 7, each: int = 500) -> list[bytes]:
    """Random strings of the alphabets that keys are written in."""
    rng = np.random.default_rng(seed)
    alphabets = (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", bytes(np.flatnonzero(_RUN)).replace(b"=", b""))
    return [bytes(rng.choice(np.frombuffer(a, np.uint8), rng.integers(RUN, 48))) for a in alphabets for _ in range(each)]


def ordinary_names() -> list[bytes]:
    """Identifiers, constants, paths, dates and numbers as programs have them, by rule from Python's own modules."""
    modules = ("argparse", "asyncio", "builtins", "collections", "datetime", "decimal", "email", "errno", "http.client", "inspect", "json", "logging", "os", "pathlib", "signal", "socket", "sqlite3", "ssl", "stat", "string", "subprocess", "tarfile", "tempfile", "threading", "token", "types", "typing", "unittest", "urllib.request", "zipfile")
    found = set(sys.stdlib_module_names)
    for m in modules:
        module = importlib.import_module(m)
        found |= {n for n in dir(module)} | {n for c in vars(module).values() if isinstance(c, type) for n in dir(c)}
    names = sorted(found)
    joined = ["_".join(x.strip("_") for x in names[i : i + 3]) for i in range(0, len(names), 3)] + ["/".join(names[i : i + 4]) for i in range(0, len(names), 5)]
    camel = ["".join(x.strip("_").capitalize() for x in names[i : i + 3]) for i in range(0, len(names), 4)]
    web = [f"https/www-{n}-{end}/index-html" for n in names[::20] for end in ("com", "org", "net")]
    dates = [f"{y}-{m:02}-{d:02}" for y in range(1990, 2031, 2) for m in range(1, 13) for d in (1, 15, 28)] + [f"{y}{m:02}{d:02}_report-v{m}" for y in range(2000, 2030, 3) for m in range(1, 13) for d in (3, 21)]
    numbers = [str(k * k * 7919) for k in range(1, 2000, 3)] + ["0" * k for k in range(2, 40)] + ["-" * 40, "=" * 40, "_" * 40, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"] * 5
    return [x.encode() for x in [*names, *(n.upper() for n in names[::2]), *joined, *camel, *web, *dates, *numbers] if x.isascii()]


_COUNTS = pa.schema([("kind", pa.int32()), ("pair", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, _N * _N), np.int64)
    for batch in batches:
        for w in split(batch.column(0)):
            for i, raw, runs in _texts(w):
                found = base_spans(raw, runs)
                total[1] += _pairs([raw[a:b] for *_, (a, b) in found]).ravel()
                blank = bytearray(raw)
                for a, _, b, _ in found:
                    blank[a:b] = b" " * (b - a)
                # long words of letters and digits may be secrets that no pattern knows: they have no label
                words = [x for x in re.findall(rb"[A-Za-z0-9]+", bytes(blank)) if len(x) < 8 or x.isalpha() or x.isdigit()]
                made = [b"_".join(words[j : j + 3]) for j in range(0, len(words) - 2, 9)] + [b"".join(x.capitalize() for x in words[j : j + 3]) for j in range(3, len(words) - 2, 9)]
                total[0] += _pairs(words + made).ravel()
    kind, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[kind, pair])], schema=_COUNTS)


def _texts(w) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    starts, ends = _runs(w.data, w.text_at, _HEX, HEX_LEAST)
    of = np.searchsorted(w.text_at, starts, "right") - 1
    for i in range(w.hi - w.lo):
        a, b = np.searchsorted(of, i), np.searchsorted(of, i, "right")
        at = w.text_at[i]
        yield i, w.bytes_of(i), [(int(s - at), int(e - at)) for s, e in zip(starts[a:b], ends[a:b], strict=True)]


def train(docs: DataFrame, sample: int = SAMPLE) -> Markov:
    """Models from about sample documents, chosen by a hash of their ids; only counts of character pairs reach the driver."""
    parts = max(1, docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(parts)) == 0).select("text")
    total = np.zeros((2, _N * _N), np.int64)
    for r in some.mapInArrow(_count, "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        total[r["kind"], r["pair"]] = r["n"]
    return Markov.fit([total[1].reshape(_N, _N), _pairs(drawn_secrets())], [total[0].reshape(_N, _N), _pairs(ordinary_names())])


def find(w, model: Markov) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """(text, its bytes, spans) for each text of a chunk; spans (start, kind, end) in bytes, in order."""
    starts, ends = _runs(w.data, w.text_at, _RUN, RUN)
    starts, ends = model.secrets(w.data, starts, ends)
    of = np.searchsorted(w.text_at, starts, "right") - 1
    for i, raw, runs in _texts(w):
        spans = [s[:3] for s in base_spans(raw, runs)]
        a, b = np.searchsorted(of, i), np.searchsorted(of, i, "right")
        own = np.stack([starts[a:b], ends[a:b]], axis=1) - w.text_at[i]
        if spans and len(own):
            far = np.maximum.accumulate([y for *_, y in spans])  # how far spans reach that begin there or before
            at = np.searchsorted([x for x, *_ in spans], own[:, 0], "right") - 1
            own = own[(at < 0) | (far[np.maximum(at, 0)] < own[:, 1])]
        yield i, raw, sorted(spans + [(int(s), 3, int(e)) for s, e in own])


def scan_secrets(docs: DataFrame, model: Markov) -> DataFrame:
    """doc_id and spans (kind, start, end: code points) for each row of docs (doc_id, text)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in split(batch.column(1)):
                rows = []
                points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before each byte
                for i, _, spans in find(w, model):
                    at = w.text_at[i]
                    rows.append([{"kind": KINDS[k], "start": int(points[at + s] - points[at]), "end": int(points[at + e] - points[at])} for s, k, e in spans])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(rows, kind)], names=["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame, model: Markov, mark: str = "[REDACTED]") -> DataFrame:
    """docs, all columns, with secrets in text replaced by mark, and n_chars, if there, of the new text."""
    at = docs.columns.index("text")
    sign = mark.encode()

    def clean(raw: bytes, spans: list[tuple[int, int, int]]) -> bytes:
        out, end = [], 0
        for s, _, e in spans:
            if s >= end:
                out += [raw[end:s], sign]
            end = max(end, e)
        return b"".join([*out, raw[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[int, str] = {}
            for w in split(batch.column(at)):
                new |= {w.lo + i: clean(raw, spans).decode("utf-8", "replace") for i, raw, spans in find(w, model) if spans}
            if new:
                texts = batch.column(at).to_pylist()
                for i, text in new.items():
                    texts[i] = text
                arrays = list(batch.columns)
                arrays[at] = pa.array(texts, batch.schema.field(at).type)
                if "n_chars" in batch.schema.names:
                    j = batch.schema.names.index("n_chars")
                    sizes = batch.column(j).to_pylist()
                    for i, text in new.items():
                        sizes[i] = len(text)
                    arrays[j] = pa.array(sizes, batch.schema.field(j).type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
