"""Token ids of a corpus in a binary format: frequency-ranked, in byte-aligned variable-length code.

Texts are encoded once and their ids written; ids are then ranked by how often
the corpus has them, rows are range-partitioned by document, and each partition
writes its documents in order as blocks. An id is kept as its rank, in as few whole bytes
as that takes; two bits of a control byte say how many, four ids to a control byte,
and control bytes lie apart from the data. A reader turns each control byte into the places of its
ids' bytes by a table of 256 entries, and ranks into ids by the table of ranks.

The format, a folder: blocks/ (Parquet as the container, uncompressed, a file for each
shard: shard, start in the shard, and for successive whole documents doc_ids, lengths, controls, data), ranks/
(rank, id, n) and shards/ (shard, start, n). It is written by Spark's committers only,
so lost executors leave no part of a file.

A tokenizer that drops white space is asked for each new piece of a word, not for each text: texts are
parted in numpy, some at a time, equal pieces become one in Arrow, and those met are remembered, within bounds. Words
of other letters than those of Western Europe are one piece each. Any other tokenizer gets whole texts.

Defined results: a null or empty text has the end id alone; documents are in ascending doc_id,
null last; rows of one doc_id each count, in order of a hash of their ids; texts of any length are encoded whole;
an empty table gives no rows; strings of special tokens inside a text are what the tokenizer says they are
(its setting encode_special_tokens is left as it is); other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm.words import give_back
from deltaloom.session import materialize, reserve, small

END = 2
#: Ids in a block, but that a longer document is a block of its own; ids in a shard, about.
BLOCK, SHARD = 1 << 17, 1 << 24
#: Bytes of texts parted at a time; words of a task and pieces of a worker that are remembered, those met once apart; bytes of the longest.
CHUNK, WORDS, PIECES, ONCE, LONG = 1 << 21, 300_000, 450_000, 200_000, 64

#: How the tokenizer that drops white space parts text, as its file says.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE = re.compile(rb"[\x09-\x0d\x20]")
#: Kinds of bytes. Plain words are of ASCII and of the letters from U+00C0 to U+00FF: these have no other normal form, and case is by character.
_GAP, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[9, 10, 11, 12, 13, 32]] = _GAP
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
#: Second bytes of two that aren't letters: of the signs U+00D7 and U+00F7, and all that are no second bytes.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[0x80:0xC0] = False
_NO_LETTER[[0x97, 0xB7]] = True
#: Lower case of a plain word's bytes.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(65, 91), *range(0x80, 0x9F)]] += 32


def word_bpe() -> str:
    """The default tokenizer's file."""
    return public_tokenizers.path("word_bpe_49k.json")


def drops_space(spec: dict) -> bool:
    """Whether the tokenizer of this file encodes a text as it does its words, one after the other."""
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers") or [{}]
    return bool(spec["model"].get("end_of_word_suffix")) and spec.get("normalizer") == _NORMALIZER and parts[0].get("pattern") == {"Regex": _PATTERN} and parts[0].get("invert") is True and parts[0].get("behavior") == "Removed"


class Coder:
    """Ids of texts, as bytes of whole numbers of a kind."""

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_str(spec)
        self.by_words = drops_space(json.loads(spec))
        self.kind = np.dtype("<u2" if self.full.get_vocab_size() < 0xFF00 else "<u4")
        self.special = [t.content.encode() for t in self.full.get_added_tokens_decoder().values()]
        # the same model without the steps that pieces have behind them; ASCII is its own byte alphabet
        self.ascii, self.bare = Tokenizer(self.full.model), Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        if self.by_words:
            for token, i in self.full.get_vocab().items():
                self.ends[i] = token.endswith(self.full.model.end_of_word_suffix)
        #: Words that aren't plain; pieces of the others met in more than one chunk of texts, and those met in one so far.
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}

    def whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.full.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self.whole(texts)
        out, lo, size = [], 0, 0
        for hi, text in enumerate(texts):
            if size + len(text) > CHUNK:
                out += self._texts(texts[lo:hi])
                lo, size = hi, 0
            if len(text) > CHUNK:
                out.append(b"".join(x for part in _parts(text) for x in self._texts([part])))
                lo = hi + 1
            else:
                size += len(text)
        return out + self._texts(texts[lo:])

    def _texts(self, texts: list[bytes]) -> list[bytes]:
        for name, most in (("words", WORDS), ("pieces", PIECES), ("once", ONCE)):
            if len(getattr(self, name)) > most:
                setattr(self, name, {})
        joined = b" ".join([*texts, b"  "])
        first, starts, packed, others = _cut(joined, self.special)
        if not len(first):
            return [b""] * len(texts)
        offsets = pa.py_buffer(np.append(starts, len(packed)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, offsets, pa.py_buffer(packed)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        other = np.zeros(len(distinct), bool)
        other[pieces.indices.to_numpy()[others]] = True
        ids = pa.array(self._ids(distinct, other.tolist()), pa.large_binary()).take(pieces.indices)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(first, begins)].tolist()
        data = ids.buffers()[2].to_pybytes()
        return [data[a:b] for a, b in pairwise(ends)]

    def _ids(self, distinct: list[bytes], other: list[bool]) -> list[bytes]:
        """Ids of each piece of plain words, or, where other is true, of a whole word."""
        ids = list(map(self.pieces.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None]
        words = [w for i in missing if other[i] and (w := distinct[i]) not in self.words]
        unknown = []
        for p in (distinct[i] for i in missing if not other[i]):
            if p in self.once:
                self.pieces[p] = self.once.pop(p)
            else:
                unknown.append(p)
        new = dict(zip(words, self.whole(words), strict=True)) if words else {}
        self.words.update((w, x) for w, x in new.items() if len(w) <= LONG)
        parts = [p for p in unknown if p.isascii()]
        fresh = self._encode_pieces(self.ascii, parts)
        if len(parts) < len(unknown):
            fresh |= self._encode_pieces(self.bare, [p for p in unknown if not p.isascii()])
        self.once |= fresh if max(map(len, fresh), default=0) <= LONG else {p: x for p, x in fresh.items() if len(p) <= LONG}
        for i in missing:
            p = distinct[i]
            for known in (new, self.words) if other[i] else (fresh, self.pieces):
                if p in known:
                    ids[i] = known[p]
                    break
        return ids

    def _encode_pieces(self, tokenizer: object, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces, all in one request: each piece's last id, and no other, is of a token that ends a word."""
        if not parts:
            return {}
        found = tokenizer.encode_batch_fast([b"\n".join(parts).decode().split("\n")], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found[0].ids, self.kind)
        at = [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()]
        data = ids.tobytes()
        return dict(zip(parts, map(data.__getitem__, map(slice, at[:-1], at[1:])), strict=True))


def _cut(joined: bytes, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, with two spaces at least at their end, in pieces: where they start; where they do without white space; these bytes; which pieces are words that aren't plain.

    Pieces are those of _PATTERN, in lower case; words that aren't plain, or hold a special token, are left as they are.
    """
    data = np.frombuffer(joined, np.uint8)
    kind, low = _KIND[data], _LOWER[data]
    start = kind == _DIGIT
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    # 's, 't, 'm, 'd, 're, 've and 'll are pieces where no other sign stands before them
    marks = np.flatnonzero(low == 39)
    marks = marks[start[marks]]
    one, two = low[marks + 1], low[marks + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    start[marks[short | long] + 1] = False
    start[marks[short] + 2] = True
    start[marks[long] + 3] = True
    odd = kind == _OTHER
    if not joined.isascii():
        high = np.flatnonzero(data >= 0x80)
        odd[high[np.where(data[high] == 0xC3, _NO_LETTER[data[high + 1]], data[high - 1] != 0xC3)]] = True
    for s in special:
        odd[[m.start() for m in re.finditer(re.escape(s), joined)]] = True
    begin = np.zeros(0, np.int64)
    if odd.any():
        end = np.flatnonzero(kind == _GAP)
        begin = np.append(0, end[:-1] + 1)
        some = np.logical_or.reduceat(odd, begin)
        begin, end = begin[some], end[some]
        inside = np.zeros(len(data), np.int8)
        inside[begin] = 1
        inside[end] = -1
        inside = np.cumsum(inside, dtype=np.int8).view(bool)
        low[inside] = data[inside]
        start[inside] = False
        start[begin] = True
    keep = kind != _GAP
    starts, packed = np.flatnonzero(start[keep]), low[keep]
    first = np.flatnonzero(start & keep)
    return first, starts, packed, np.searchsorted(first, begin)


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text cut at white space."""
    lo = 0
    while lo < len(text):
        gap = _SPACE.search(text, min(lo + CHUNK, len(text)))
        hi = gap.start() if gap else len(text)
        yield text[lo:hi]
        lo = hi


#: By tokenizer; workers serve many tasks.
_CODERS: dict[int, Coder] = {}


def _coder(key: int, spec: str) -> Coder:
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(spec)
    return _CODERS[key]


_TOKENS = pa.schema([("counts", pa.bool_()), ("doc_id", pa.int64()), ("nth", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])
_TOKEN_ROWS = "counts boolean, doc_id long, nth int, n long, ids binary"


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """doc_id, nth (in the task), n, ids of docs (doc_id, text), written; ids are 16-bit or, for large vocabularies, 32-bit whole numbers.

    Besides, where counts is true, a row of each task with how often it has each id, from 0 on, as 64-bit numbers.
    """
    with open(tokenizer or word_bpe(), encoding="utf-8") as f:
        spec = f.read()
    sent, key = docs.sparkSession.sparkContext.broadcast(spec), hash(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done = _coder(key, sent.value), 0
        last = np.array([end], coder.kind).tobytes()
        total = np.zeros(coder.full.get_vocab_size(), np.int64)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            ids = [x + last for x in coder.encode(texts)]
            n = np.array(list(map(len, ids)), np.int64) // coder.kind.itemsize
            for lo in range(0, len(ids), 100):
                own = np.bincount(np.frombuffer(b"".join(ids[lo : lo + 100]), coder.kind), minlength=len(total))
                own[: len(total)] += total
                total = own
            nth = pa.array(np.arange(done, done + len(ids)) & 0x7FFFFFFF, pa.int32())
            done += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), bool)), batch.column(0), nth, pa.array(n), pa.array(ids, pa.binary())], schema=_TOKENS)
        if done:
            yield pa.RecordBatch.from_pylist([{"counts": True, "n": done, "ids": total.tobytes()}], schema=_TOKENS)
        coder.words = {}
        give_back()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(own.mapInArrow(run, _TOKEN_ROWS), "tokens")


def _kind(ids: bytes, n: int) -> np.dtype:
    return np.dtype("<u2" if len(ids) == 2 * n else "<u4")


def rank_ids(tokens: DataFrame) -> DataFrame:
    """rank (from 0, the most frequent id; ties: the smaller), id, n. It has no more rows than the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                own = np.frombuffer(counts, np.int64)
                total = own + total if len(total) else own
        known = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total[known])], names=["id", "n"])

    counts = tokens.where("counts").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "id")) - 1  # one task for as many rows as the vocabulary has
    return materialize(counts.select(place.cast("long").alias("rank"), "id", "n"), "ranks", 1)


_PLACES = np.arange(4)
_CODES = (np.arange(256)[:, None] >> (2 * _PLACES)) & 3
#: For each control byte the most bytes that one of its four ids has, and, by that, which of so many bytes each id has.
_MOST = _CODES.max(axis=1).astype(np.uint8) + 1
_TABLE = {width: np.arange(width)[None, None, :] <= _CODES[:, :, None] for width in (1, 2, 3, 4)}


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more, top = np.zeros(-(-len(ranks) // 4) * 4, np.uint8), int(ranks.max(initial=0))
    width = 1
    for bits in (8, 16, 24):
        if top >> bits:
            more[: len(ranks)] += ranks >= 1 << bits
            width += 1
    controls = more[::4] | more[1::4] << 2 | more[2::4] << 4 | more[3::4] << 6
    places = np.arange(width, dtype=np.uint8) <= more[: len(ranks), None]
    return controls.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[:, :width][places].tobytes()


def unpack(controls: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers: each control byte's entry of the table says where its ids' bytes go."""
    controls = np.frombuffer(controls, np.uint8)
    width = int(_MOST[controls].max(initial=1))
    out = np.zeros((n, width), np.uint8)
    out[_TABLE[width][controls].reshape(-1, width)[:n]] = np.frombuffer(data, np.uint8)
    if width in (1, 2, 4):
        return out.view(f"<u{width}").ravel()
    return np.pad(out, ((0, 0), (0, 1))).view("<u4").ravel()


_BLOCKS = pa.schema([("shard", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("controls", pa.binary()), ("data", pa.binary())])
_BLOCK_ROWS = "shard int, start long, doc_ids array<long>, lengths array<long>, controls binary, data binary"


def write_ids(tokens: DataFrame, path: str) -> None:
    """Write encode_documents()'s rows as files in ascending doc_id."""
    spark = tokens.sparkSession
    ranks = rank_ids(tokens)
    ranks.write.parquet(f"{path}/ranks")
    rows = ranks.orderBy("rank").select("id", "n").toPandas()  # as long as the vocabulary at most
    place = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.uint32)
    place[rows["id"].to_numpy(np.int64)] = np.arange(len(rows), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(place)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows["n"].sum()) // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(x, _kind(x, n)) for _, n, x in held])
            row = {"shard": shard, "start": start, "doc_ids": [k for k, _, _ in held], "lengths": [n for _, n, _ in held]}
            row["controls"], row["data"] = pack(sent.value[ids])
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size + row[1] > BLOCK:
                    yield block()
                    start, held, size = start + size, [], 0
                held.append(row)
                size += row[1]
        if held:
            yield block()

    # rows of one doc_id, and those without, may be many: their hash and number part them too
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("ids"), F.col("nth")]
    dealt = tokens.where("not counts").repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    dealt.mapInArrow(run, _BLOCK_ROWS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    own = spark.read.schema(_BLOCK_ROWS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum(ids).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    own.select("shard", before.alias("start"), "n").coalesce(1).write.parquet(f"{path}/shards")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (32-bit, little endian) from files of write_ids()."""
    by_rank = spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()["id"].to_numpy("<u4")
    sent = spark.sparkContext.broadcast(by_rank)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, keys, lengths, controls, data in zip(*(batch.column(c) for c in ("start", "doc_ids", "lengths", "controls", "data")), strict=True):
                n = lengths.values.to_numpy()
                ends = np.cumsum(n)
                ids = sent.value[unpack(controls.as_buffer(), data.as_buffer(), int(n.sum()))]
                # a column of bytes over the decoded ids, of which only the offsets are made
                offsets = np.concatenate([[0], ends]) * 4
                binary = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
                for i in range(0, len(n), 1000):
                    yield pa.RecordBatch.from_arrays([keys.values[i : i + 1000], pa.array(start.as_py() + (ends - n)[i : i + 1000]), pa.array(n[i : i + 1000]), binary[i : i + 1000].cast(pa.binary())], schema=out)

    blocks = spark.read.schema(_BLOCK_ROWS).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, start long, n long").parquet(f"{path}/shards").select("shard", F.col("start").alias("before"))
    placed = blocks.join(small(shards), "shard").withColumn("start", F.col("start") + F.col("before"))
    return placed.select("start", "doc_ids", "lengths", "controls", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_ids(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """What read_ids() gives of docs (doc_id, text), written in the shared folder."""
    path = reserve(docs.sparkSession, "token-ids")
    write_ids(encode_documents(docs, tokenizer, end), path)
    return read_ids(docs.sparkSession, path)
