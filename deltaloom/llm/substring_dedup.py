"""Substring dedup by windows of WINDOW words, with a count-min prefilter.

Every window has an anchor: the smallest hash among the GRAM-word sequences in
it. Equal windows have equal anchors, so the number of documents with an anchor is
never below that of documents with a window that holds it: counts of anchors
overestimate counts of windows, in about a twentieth of the cells. Each task
counts its anchors in a count-min sketch; the sketches are merged block by block,
and kept as one bit for each cell: two or more. A second pass hashes the windows
whose anchor is estimated repeated (128 bits), and groups them exactly. None is
lost; the sketch only decides how many windows that are not repeated are grouped in vain.

What is broadcast is bounded, by 2 * 2**MAX_CELLS bits: where the input needs more
cells, anchors are dealt out by hash over several passes with a sketch each. Within a
task only the rows of the smallest document of each window are sent on, so that a
very common window costs one row for each task.

A word is removed if it is covered by a window that also starts in a document
with a smaller id. Defined results: null or empty text has no words; rows with a null
doc_id lose nothing and take nothing from others; rows that share a doc_id don't
take from each other; texts of fewer than WINDOW words stay whole; of texts of any
length every window counts; equal windows of several documents (ties) stay in the
smallest id; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.words import Words, grams, split
from deltaloom.session import materialize

WINDOW, GRAM = 50, 10
ROWS, BLOCK, MIN_CELLS, MAX_CELLS = 2, 16, 16, 29
#: Bytes of text for each cell of a sketch, at least, and at most before there is another pass.
CELL_BYTES, FULL_BYTES = 24, 48
#: Windows that a bucket of the exact grouping holds about; and that a task keeps before it hands them on.
BUCKET, HELD = 500_000, 1_000_000
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def _anchors(w: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows, and the anchor of each."""
    g = grams(hashes, gram)
    span, low, size = window - gram + 1, g, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:]) if len(low) > size else low[:0]
        size *= 2
    more = span - size
    low = np.minimum(low[: len(low) - more], low[more:]) if len(low) > more else low[:0]
    at = np.flatnonzero(w.room() >= window)
    return at, low[at]


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (anchors * np.uint64(_ODD[row])) >> np.uint64(64 - bits)


def _sketch(bits: int, passes: int, turn: int, window: int, gram: int):
    schema = pa.schema([("r", pa.int32()), ("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchors = np.concatenate(held)
        for r in range(ROWS):
            cells, counts = np.unique(_cells(anchors, r, bits), return_counts=True)
            blocks, at = np.unique(cells >> np.uint64(BLOCK), return_index=True)
            low, counts = (cells & np.uint64((1 << BLOCK) - 1)).astype(np.uint16), np.minimum(counts, 2).astype(np.uint8)
            ends = [*at[1:], len(cells)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), r, np.int32)), pa.array(blocks.astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())],
                schema=schema,
            )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for w in split(batch.column(0)):
                at, anchor = _anchors(w, w.hashes(), window, gram)
                mine = anchor % np.uint64(passes) == turn if passes > 1 else slice(None)
                at, anchor = at[mine], anchor[mine]
                if not len(at):
                    continue
                text = w.text_of()[at]
                new = np.empty(len(at), bool)
                new[0] = True
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                anchor, text = anchor[new], text[new]
                order = np.lexsort((anchor, text))
                anchor, text = anchor[order], text[order]
                first = np.ones(len(anchor), bool)  # once for each text
                first[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                held.append(anchor[first])
                size += len(held[-1])
            if size > HELD:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return sketch


def _merge(table: pa.Table) -> pa.Table:
    """The bits of a block: cells counted twice or more."""
    cells = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("cells").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
    total = np.bincount(cells, weights=counts, minlength=1 << BLOCK)
    bits = np.packbits(total >= 2, bitorder="little").tobytes()
    return pa.table({"r": table.column("r").slice(0, 1).cast(pa.int32()), "block": table.column("block").slice(0, 1).cast(pa.int32()), "bits": pa.array([bits], pa.binary())})


def _seen(repeated: list[np.ndarray], anchors: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch estimates two or more."""
    out = np.ones(len(anchors), bool)
    for r in range(ROWS):
        c = _cells(anchors, r, bits)
        out &= (repeated[r][c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


_GROUPED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("h1", "h2", "doc", "fp", "pos", "db", "r_doc", "r_fp", "r_pos", "r_db"))])
_TYPES = {"h1": np.uint64, "h2": np.uint64, "doc": np.int64, "fp": np.uint32, "pos": np.int32, "db": np.int32}
_PLACE = ("doc", "fp", "pos", "db")


def _taken(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """x sorted by window and document; whether each has a smaller document before it."""
    order = np.lexsort((x["doc"], x["h2"], x["h1"]))
    x = {k: v[order] for k, v in x.items()}
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])
    first = x["doc"][np.flatnonzero(new)]
    return x, x["doc"] > np.repeat(first, np.diff(np.append(np.flatnonzero(new), n)))


def _windows(bits: int, passes: int, turn: int, repeated, buckets: int, window: int, gram: int):
    def flush(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x, taken = _taken({k: np.concatenate([h[k] for h in held]) for k in _TYPES})
        kept, gone = {k: v[~taken] for k, v in x.items()}, {k: x[k][taken] for k in _PLACE}
        bucket = ((kept["h1"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # in order, since h1 is
        present, lo = np.unique(bucket, return_index=True)
        lo = np.append(lo, len(bucket)).tolist()
        cut = np.linspace(0, len(gone["doc"]), len(present) + 1).astype(int).tolist()  # what is decided here travels along
        rows = [
            {"bucket": b} | {k: v[lo[i] : lo[i + 1]].tobytes() for k, v in kept.items()} | {f"r_{k}": v[cut[i] : cut[i + 1]].tobytes() for k, v in gone.items()}
            for i, b in enumerate(present.tolist())
        ]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[i : i + 64], schema=_GROUPED)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = [np.frombuffer(x, np.uint8) for x in repeated.value]
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            known, db = batch.column(0).is_valid().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for w in split(batch.column(1)):
                hashes = w.hashes()
                at, anchor = _anchors(w, hashes, window, gram)
                mine = anchor % np.uint64(passes) == turn if passes > 1 else slice(None)
                at, anchor = at[mine], anchor[mine]
                if not len(at):
                    continue
                text = w.text_of()[at]
                new = np.ones(len(at), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                runs = np.flatnonzero(new)
                some = np.repeat(_seen(bitmap, anchor[runs], bits), np.diff(np.append(runs, len(at)))) & known[w.lo + text]
                at, text = at[some], text[some]
                if not len(at):
                    continue
                fp = np.zeros(w.hi - w.lo, np.uint32)
                for i in np.unique(text):
                    fp[i] = zlib.crc32(w.data[w.text_at[i] : w.text_at[i + 1]])
                held.append({
                    "h1": grams(hashes, window)[at], "h2": grams(w.hashes(1), window, 1)[at], "doc": ids[w.lo + text], "fp": fp[text],
                    "pos": (at - w.word_at[text]).astype(np.int32), "db": db[w.lo + text].astype(np.int32),
                })
                size += len(at)
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return windows


_REMOVED = pa.schema([("db", pa.int32()), ("doc", pa.binary()), ("fp", pa.binary()), ("pos", pa.binary())])


def _group(table: pa.Table) -> pa.Table:
    """One bucket of windows: the places that a smaller document takes, by document bucket."""
    read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
    x, taken = _taken({k: read(k, kind) for k, kind in _TYPES.items()})
    gone = {k: np.concatenate([x[k][taken], read(f"r_{k}", _TYPES[k])]) for k in _PLACE}
    order = np.argsort(gone["db"], kind="stable")
    gone = {k: v[order] for k, v in gone.items()}
    dbs, at = np.unique(gone["db"], return_index=True)
    ends = [*at[1:], len(order)][: len(at)]  # none where nothing is taken
    cut = lambda k: pa.array([gone[k][a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())
    return pa.Table.from_arrays([pa.array(dbs, pa.int32()), cut("doc"), cut("fp"), cut("pos")], schema=_REMOVED)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(window: int):
    def cut(docs: pa.Table, removed: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in removed.column(c).to_pylist())])
        doc, fp, pos = read("doc", np.int64), read("fp", np.uint32), read("pos", np.int32)
        order = np.lexsort((fp, doc))
        doc, fp, pos = doc[order], fp[order], pos[order]
        out: list[tuple] = []
        for batch in docs.select(["doc_id", "text"]).combine_chunks().to_batches():
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            data = texts.cast(pa.binary()).to_pylist()
            for key, raw in zip(ids, data, strict=True):
                raw = raw or b""
                found = raw.split()  # ASCII white space: 0x20, 0x09-0x0D
                lo, hi = (np.searchsorted(doc, key), np.searchsorted(doc, key, "right")) if key is not None else (0, 0)
                gone = 0
                if lo < hi:
                    mine = pos[lo:hi][fp[lo:hi] == zlib.crc32(raw)]
                    begun = np.zeros(len(found) + 1, np.int64)
                    np.add.at(begun, mine, 1)
                    np.add.at(begun, np.minimum(mine + window, len(found)), -1)
                    stay = np.cumsum(begun[:-1]) == 0
                    gone = len(found) - int(stay.sum())
                    kept = list(compress(found, stay))
                else:
                    kept = found
                out.append((key, len(found), gone, b" ".join(kept).decode("utf-8", "replace")))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_KEPT)], schema=_KEPT)

    return cut


def _repeated(docs: DataFrame, bits: int, passes: int, turn: int, window: int, gram: int) -> list[bytes]:
    """The merged sketch of one pass, as bits; bounded, as the sketch is."""
    partial = docs.select("text").mapInArrow(_sketch(bits, passes, turn, window, gram), "r int, block int, cells binary, counts binary")
    merged = partial.groupBy("r", "block").applyInArrow(_merge, "r int, block int, bits binary")
    bitmap = [bytearray(1 << (bits - 3)) for _ in range(ROWS)]
    for row in merged.collect():
        at = row["block"] << (BLOCK - 3)
        bitmap[row["r"]][at : at + (1 << (BLOCK - 3))] = row["bits"]
    return [bytes(x) for x in bitmap]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    bits = min(MAX_CELLS, max(MIN_CELLS, int(size // CELL_BYTES).bit_length()))
    passes = int(size // (FULL_BYTES * 2**bits) + 1)
    buckets = int(max(1, size // 6 // BUCKET + 1))
    # documents without an id lose nothing, and may be many: they go anywhere
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id"))
    keyed = docs.withColumn("db", F.pmod(place, F.lit(buckets)).cast("int"))
    removed = None
    for turn in range(passes):
        repeated = spark.sparkContext.broadcast(_repeated(docs, bits, passes, turn, window, gram))
        grouped = keyed.mapInArrow(_windows(bits, passes, turn, repeated, buckets, window, gram), "bucket int, " + ", ".join(f"{f.name} binary" for f in list(_GROUPED)[1:]))
        own = grouped.groupBy("bucket").applyInArrow(_group, "db int, doc binary, fp binary, pos binary")
        if passes > 1:  # written, so that one sketch at a time is held
            own = materialize(own, "removed")
            repeated.destroy()
        removed = own if removed is None else removed.union(own)
    return keyed.groupBy("db").cogroup(removed.groupBy("db")).applyInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")
