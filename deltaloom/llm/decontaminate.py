"""Benchmark decontamination by SimHash of windows as long as the items.

Words are lower-cased (A-Z) and parted by white space and ASCII punctuation; a
shingle is five of them, and weighs as many bytes as it has. Each window of a
document that is as long as an item gets a 128-bit SimHash of its weighted
distinct shingles. A multi-index of 8 blocks of 16 bits finds every item of that length
within RADIUS: fingerprints that differ in 31 bits or fewer differ in 3 at most
in one block at least, so each block of a window is looked up with up to 3 bits
flipped. Candidates are verified by the exact weighted Jaccard similarity of their
distinct shingles.

Fingerprints are made only for windows of the weight of whose distinct shingles
THRESHOLD or more lies on shingles that some item has: others can't be that similar to any item.

Items of fewer than five words are one shingle; a document shorter than an item
is one window. Items are handled ITEMS or ITEM_BYTES at a time, so what is sent to the
executors is bounded. Defined results: null or empty texts match nothing, on either
side; null item ids are skipped; equal items match each; rows with a null or a repeated
doc_id are searched each; of windows equally similar to an item (ties) the first is
given; texts of any length are searched whole; without documents or items there are no
rows, and no document is dropped; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.words import PLAIN, Words, grams, mix, split

SHINGLE, THRESHOLD = 5, 0.8
RADIUS = 31
ITEMS, ITEM_BYTES = 20_000, 32 << 20
_BITS, _BLOCK = 128, 16
_BLOCKS, _NEAR = _BITS // _BLOCK, RADIUS // (_BITS // _BLOCK)
#: Windows fingerprinted at a time.
_SPAN = 4096


def _weights(w: Words, k: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    return sums[k:] - sums[:-k]


def _signs(h: np.ndarray) -> np.ndarray:
    """Shingle hashes as 128 signs each."""
    both = np.stack([h, mix(h + np.uint64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(h), _BITS // 8), axis=1).astype(np.int32) * 2 - 1


def _again(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of shingles that were there before, and the place before each."""
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    return order[same + 1], order[same]


def _distinct_sums(value: np.ndarray, again: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Sums of value over the distinct shingles of each window of size shingles."""
    sums = np.zeros((len(value) + 1, *value.shape[1:]), np.int64)
    np.cumsum(value, axis=0, out=sums[1:])
    out = sums[size:] - sums[:-size]
    at, before = again
    near = at - before < size
    if near.any():
        # the later of two equal shingles doesn't count in the windows that hold both
        at, before = at[near], before[near]
        extra = np.zeros((len(value) + 1, *value.shape[1:]), np.int64)
        np.add.at(extra, np.maximum(at - size + 1, 0), value[at])
        np.subtract.at(extra, before + 1, value[at])
        out -= np.cumsum(extra, axis=0)[: len(out)]
    return out


def fingerprints(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes (16 bytes each) of windows of size shingles."""
    return np.packbits(_distinct_sums(_signs(h) * weight[:, None], _again(h), size)[starts] >= 0, axis=1)


def _flips() -> np.ndarray:
    """What differs in _NEAR bits of a block at most."""
    return np.array([sum(1 << b for b in bits) for n in range(_NEAR + 1) for bits in combinations(range(_BLOCK), n)], np.uint16)


def _distinct(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, at = np.unique(h, return_index=True)
    return h, weight[at]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of distinct shingles (sorted hashes, weights)."""
    place = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = int(b[1][a[0][place] == b[0]].sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


class Index:
    """Benchmark items with their multi-index: for each shingle length, fingerprints of items of all lengths."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.sets: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids: list[int] = []
        of: dict[int, list[int]] = {}
        sizes: dict[int, list[int]] = {}
        prints: dict[int, list[np.ndarray]] = {}
        known: dict[int, list[np.ndarray]] = {}
        for w in split(pa.array([t for _, t in items], pa.string()), PLAIN):
            hashes = w.hashes(lower=True)
            for i in range(w.hi - w.lo):
                lo, hi = w.word_at[i], w.word_at[i + 1]
                k = min(SHINGLE, int(hi - lo))
                if not k:
                    continue
                h, weight = grams(hashes[lo:hi], k), _weights(w, k)[lo : hi - k + 1]
                of.setdefault(k, []).append(len(self.ids))
                sizes.setdefault(k, []).append(int(hi - lo))
                known.setdefault(k, []).append(h)
                prints.setdefault(k, []).append(fingerprints(h, weight, np.zeros(1, int), len(h))[0])
                self.sets.append(_distinct(h, weight))
                self.ids.append(items[w.lo + i][0])
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.of, self.sizes, self.prints = ({k: np.array(v) for k, v in x.items()} for x in (of, sizes, prints))
        self.flips = _flips()
        # for each block: its values among the items in order, the place of each value, the items that have each
        self.blocks = {k: [self._block(v) for v in p.view(np.uint16).T] for k, p in self.prints.items()}

    @staticmethod
    def _block(of_items: np.ndarray) -> tuple[np.ndarray, ...]:
        values, which = np.unique(of_items, return_inverse=True)
        place = np.full(1 << _BLOCK, -1, np.int32)
        place[values] = np.arange(len(values))
        return values, place, np.argsort(which, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(which))])

    def has(self, k: int, h: np.ndarray) -> np.ndarray:
        known = self.known[k]
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h

    def near(self, k: int, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS, of items as long as the window is (in words)."""
        n_items = len(self.of[k])
        pairs = []
        for (values, place, items, at), mine in zip(self.blocks[k], np.ascontiguousarray(prints).view(np.uint16).T, strict=True):
            asked, who = np.unique(mine, return_inverse=True)
            if len(values) < len(self.flips):  # the same values, from the side that has fewer
                a, v = np.nonzero(np.bitwise_count(asked[:, None] ^ values[None, :]) <= _NEAR)
            else:
                found = place[asked[:, None] ^ self.flips[None, :]]
                a, f = np.nonzero(found >= 0)
                v = found[a, f]
            # every window that asked for a value, with every item that has one near it
            order, first = np.argsort(who, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(asked)))])
            n_w, n_i = first[a + 1] - first[a], at[v + 1] - at[v]
            n = n_w * n_i
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            each = np.repeat(n_i, n)
            w, i = order[np.repeat(first[a], n) + j // each], items[np.repeat(at[v], n) + j % each]
            same = sizes[w] == self.sizes[k][i]
            pairs.append(w[same] * n_items + i[same])
        w, i = np.divmod(np.unique(np.concatenate(pairs)), n_items)
        far = np.bitwise_count(prints[w] ^ self.prints[k][i]).sum(axis=1)
        return w[far <= RADIUS], self.of[k][i[far <= RADIUS]]

    def matches(self, w: Words) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity) of each pair's best window."""
        hashes = w.hashes(lower=True)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k in self.known:
            if len(hashes) < k:
                continue
            h = grams(hashes, k)
            inside = w.room()[: len(h)] >= k
            hit = self.has(k, h) & inside
            if not hit.any():
                continue
            texts = np.unique(np.searchsorted(w.word_at, np.flatnonzero(hit), "right") - 1)
            weight = _weights(w, k)
            for t in texts:
                lo, hi = int(w.word_at[t]), int(w.word_at[t + 1]) - k + 1
                self._search(t, k, h[lo:hi], weight[lo:hi], hit[lo:hi], best)
        for (t, i), (s, start, n) in sorted(best.items()):
            yield t, i, start, n, s

    def _search(self, t: int, k: int, h: np.ndarray, weight: np.ndarray, hit: np.ndarray, best: dict) -> None:
        again = _again(h)
        prints, windows, lengths = [], [], []
        held = 0
        for words in np.unique(self.sizes[k]):
            size = min(int(words) - k + 1, len(h))
            starts = np.flatnonzero(_distinct_sums(weight * hit, again, size) >= THRESHOLD * _distinct_sums(weight, again, size))
            for part in np.split(starts, np.flatnonzero(np.diff(starts // _SPAN)) + 1):
                if not len(part):
                    continue
                a, b = part[0], part[-1] + size
                prints.append(fingerprints(h[a:b], weight[a:b], part - a, size))
                windows.append(part)
                lengths.append(np.full(len(part), words))
                held += len(part)
                if held > _SPAN:
                    self._verify(t, k, h, weight, prints, windows, lengths, best)
                    prints, windows, lengths, held = [], [], [], 0
        if held:
            self._verify(t, k, h, weight, prints, windows, lengths, best)

    def _verify(self, t: int, k: int, h: np.ndarray, weight: np.ndarray, prints: list, windows: list, lengths: list, best: dict) -> None:
        """Candidates of the fingerprints by exact similarity; of equal ones the first window stays."""
        starts, words = np.concatenate(windows), np.concatenate(lengths)
        found, items = self.near(k, np.concatenate(prints), words)
        for j, i in zip(found, items, strict=True):
            s, size = starts[j], min(int(words[j]) - k + 1, len(h))
            how = similarity(self.sets[i], _distinct(h[s : s + size], weight[s : s + size]))
            if how >= THRESHOLD and how > best.get((t, i), (0.0,))[0]:
                best[t, i] = (how, int(s), size + k - 1)


def _slices(benchmark: DataFrame) -> Iterator[Index]:
    b = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    rows, size = b.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    n = max(-(-rows // ITEMS), -(-size // ITEM_BYTES))
    for i in range(n):
        part = b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield Index([(r[0], r[1]) for r in part.collect()])


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64())])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start and words (of the best window), similarity; only documents that hold an item."""
    spark, out = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in _slices(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[w.lo + t], sent.value.ids[i], start, n, s) for w in split(batch.column(1), PLAIN) for t, i, start, n, s in sent.value.matches(w)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_FOUND)], schema=_FOUND)

        found = docs.mapInArrow(run, "doc_id long, item_id long, start long, words long, similarity double")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, start long, words long, similarity double")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose text holds an item."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for index in _slices(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for w in split(batch.column(at), PLAIN):
                    keep[[w.lo + t for t, *_ in sent.value.matches(w)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
