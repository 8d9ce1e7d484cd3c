"""N-gram Jaccard self-join of documents at 0.8 or more, by parity sketches.

A document's set holds its distinct 5-word shingles. Two sets of sizes a and b
with Jaccard similarity of 0.8 or more differ in at most D = (a + b) / 9 shingles.
A parity sketch flips one bit for each shingle, so the Hamming distance of two
sketches is at most the number of shingles that differ.

Pigeonhole join: for each band of sizes the sketch is cut into more than D
blocks; sets within D differ in at most D blocks, so they agree in one at least. The
sketch is wide (2**64 places in a block), and a block that holds few odd bits
is kept as the exclusive or of their places' hashes. Blocks without shingles are
not sent: a set with so many of them that the equal blocks might all be empty is
"thin", and goes on to another partition of the shingles as well; two sets meet
in the first partition in which one of them isn't thin. After LEVELS partitions
thin sets meet by single shingles. So no pair is lost.

Candidates: in each group of sets with an equal block every set is first held
against the most connected one. Exact verification compares whole shingle sets.
Then groups whose sets are not yet in one component give the remaining pairs
between components which a second, packed sketch of 512 bits and the sizes don't
rule out: first each set's nearest, then those still between components that a
sketch of 4096 bits doesn't rule out either. After these are verified, each pair
of every group is linked, proved unlinked, or joined through others. Sets are
64-bit fingerprints in all this; documents with equal sets are one.

Defined results: documents with fewer words than five have their whole sequence
as the only shingle; those without words or text have n_shingles 0 and stay
alone, as do rows with a null doc_id (component_id null); rows that repeat a doc_id
each have their own set, and all of them the component of the smallest id their
links reach; equal sets are linked, so ties need no rule; texts of any length are
compared whole; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.components import connected_components
from deltaloom.llm.words import Words, grams, mix, split
from deltaloom.session import materialize

SHINGLE = 5
LEVELS = 12
#: Block keys in a bucket of the grouping, about; and kept by a task before it hands them on.
BUCKET, HELD = 500_000, 1_000_000
#: Members verified against one copy of their leader; members of a group that a task holds against the whole group.
CHUNK_MEMBERS, TOGETHER = 256, 2000
_SKETCH = 512
#: Logarithms of the bits of the wide sketch, of the largest filter of wanted documents and of a block of it; bits for each of these.
WIDE, FILTER, FILTER_BLOCK, FILTER_BITS = 12, 29, 16, 16
_WORDS = _SKETCH // 64


def _bands(top: int = 1 << 40) -> list[int]:
    """Where bands of sizes begin; sizes below the first can only be linked with equal sets."""
    out = [4]
    while out[-1] < top:
        out.append(-(-out[-1] * 3 // 2))
    return out


BANDS = _bands()
#: In band g the smaller set of a pair has up to BANDS[g + 1] - 1 shingles, the larger up to 5/4 of that.
REACH = [(b - 1) * 5 // 4 for b in BANDS[1:]]
DIFFER = [(b - 1 + r) // 9 for b, r in zip(BANDS[1:], REACH, strict=True)]
BLOCKS = [d + 1 + max(2, d // 6) for d in DIFFER]


def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the chunk's texts, sorted in each, and where each text's begin."""
    hashes = w.hashes(lower=True)
    g = grams(hashes, k)
    at = np.flatnonzero(w.room()[: len(g)] >= k)
    text, g = w.text_of()[at], g[at]
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):  # the whole sequence, told apart by its length
        whole = np.array([grams(hashes[w.word_at[i] : w.word_at[i + 1]], counts[i])[0] for i in short], np.uint64)
        text, g = np.concatenate([text, short]), np.concatenate([g, mix(whole + counts[short].astype(np.uint64))])
    order = np.lexsort((g, text))
    text, g = text[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    text, g = text[new], g[new]
    return g, np.searchsorted(text, np.arange(w.hi - w.lo + 1))


def _sums(values: np.ndarray, at: np.ndarray, how: np.ufunc) -> np.ndarray:
    """how over values[at[i]:at[i + 1]], 0 where that is empty."""
    out = np.zeros(len(at) - 1, values.dtype)
    full = np.flatnonzero(at[:-1] < at[1:])
    if len(full):
        out[full] = how.reduceat(values, at[:-1][full])
    return out


def set_ids(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    return mix(_sums(mix(g + np.uint64(1)), at, np.add) ^ (np.diff(at).astype(np.uint64) << np.uint64(40)))


_PROFILE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), *((f"x{i}", pa.int64()) for i in range(_WORDS))])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in split(batch.column(1)):
            g, at = shingle_sets(w)
            n = np.diff(at)
            bit = (g >> np.uint64(55)).astype(np.int64)
            parity = np.bincount(np.repeat(np.arange(len(n)), n) * _SKETCH + bit, minlength=len(n) * _SKETCH).astype(np.uint8) & 1
            packed = np.packbits(parity.reshape(len(n), _SKETCH), axis=1).view(np.int64)
            ids = set_ids(g, at).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(w.lo, w.hi - w.lo) for c in (0, 2)), pa.array(n), pa.array(ids), *(pa.array(packed[:, i]) for i in range(_WORDS))], schema=_PROFILE)


def _block_keys(g: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, numbers of their sets): the sketch blocks of sets in all bands they belong to."""
    n = np.diff(at)
    band = np.searchsorted(BANDS, n, "right") - 1
    for below in (0, 1):
        sets = np.flatnonzero((band >= below) & ((below == 0) | (n <= np.asarray(REACH)[np.maximum(band - 1, 0)])))
        for level in range(LEVELS + 1):
            if not len(sets):
                break
            groups = band[sets] - below
            size = n[sets]
            first = np.concatenate([[0], np.cumsum(size)])
            index = np.arange(first[-1]) - np.repeat(first[:-1] - at[:-1][sets], size)
            own, place = np.repeat(np.arange(len(sets)), size), mix(g[index] + np.uint64(0x9E37 * (level + 1)))
            tag = (np.uint64(level) << np.uint64(56)) + (groups.astype(np.uint64) << np.uint64(48))
            if level == LEVELS:
                yield mix(place ^ mix(tag[own])), sets[own]
                break
            blocks = np.asarray(BLOCKS)[groups]
            block = ((place >> np.uint64(32)) * blocks[own].astype(np.uint64)) >> np.uint64(32)
            base = np.concatenate([[0], np.cumsum(blocks)])
            cell = base[own] + block.astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            parity = np.bitwise_xor.reduceat(mix(place[order]), begin)
            cell = cell[begin]
            of = np.searchsorted(base, cell, "right") - 1
            yield mix(parity ^ mix(tag[of] + (cell - base[of]).astype(np.uint64))), sets[of]
            empty = blocks - np.bincount(of, minlength=len(sets))
            sets = sets[empty >= blocks - np.asarray(DIFFER)[groups]]  # thin


_PACKED = pa.schema([("bucket", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("sids", pa.binary())])


def _keys(buckets: int):
    def flush(keys: list[np.ndarray], sids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, sid = np.concatenate(keys), np.concatenate(sids)
        order = np.argsort(key)
        key, sid = key[order], sid[order]
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        # 48 bits of the key tell its groups apart in a bucket; verification sees to the rest
        high, low = (key >> np.uint64(32)).astype(np.uint32), (key >> np.uint64(16)).astype(np.uint16)
        for lo in range(0, buckets, 64):
            some = [b for b in range(lo, min(lo + 64, buckets)) if at[b] < at[b + 1]]
            if some:
                cut = lambda x: pa.array([x[at[b] : at[b + 1]].tobytes() for b in some], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), cut(high), cut(low), cut(sid)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sids: list[np.ndarray] = []
        size, seen = 0, set()
        for batch in batches:
            for w in split(batch.column(0)):
                g, at = shingle_sets(w)
                ids = set_ids(g, at)
                new = np.zeros(len(ids), bool)  # equal sets once for each task
                for i in np.flatnonzero(np.diff(at) >= BANDS[0]):
                    if (key := int(ids[i])) not in seen:
                        seen.add(key)
                        new[i] = True
                n = np.diff(at)
                g = g[np.repeat(new, n)]
                at, ids = np.concatenate([[0], np.cumsum(n[new])]), ids[new]
                for key, of in _block_keys(g, at):
                    keys.append(key)
                    sids.append(ids[of])
                    size += len(key)
            if size > HELD:
                yield from flush(keys, sids)
                keys, sids, size = [], [], 0
                seen.clear()
        if size:
            yield from flush(keys, sids)

    return run


_GROUPS = pa.schema([("keys", pa.binary()), ("sids", pa.binary()), ("shared", pa.binary())])


def _group(table: pa.Table) -> pa.Table:
    """A bucket's groups of two sets or more; groups of the same sets are one, with the number of their keys.

    A group is named by its sets, so that equal groups of other buckets join it.
    """
    read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
    key = (read("high", np.uint32).astype(np.uint64) << np.uint64(16)) | read("low", np.uint16)
    sid = read("sids", np.uint64)
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, sid = key[new], sid[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    name = mix(np.add.reduceat(mix(sid + np.uint64(3)), begin) + size.astype(np.uint64))
    name, first, count = np.unique(np.where(size > 1, name, np.uint64(0)), return_index=True, return_counts=True)
    some = size[first] > 1
    name, first, count = name[some], first[some], count[some]
    size, begin = size[first], begin[first]
    index = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, int)
    return pa.Table.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (np.repeat(name, size), sid[index], np.repeat(count, size).astype(np.int32))], schema=_GROUPS)


def _unpack(names: tuple[str, ...], kinds: tuple[type, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = [np.frombuffer(batch.column(j)[i].as_py(), kind) for j, kind in enumerate(kinds)]
                for lo in range(0, len(values[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 100_000].astype(np.int64)) for v in values], names=list(names))

    return run


_VERIFY = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, the leader before its members: the pairs that are linked."""
    leader, tokens = None, np.zeros(0, np.uint64)
    for batch in batches:
        lead, salt, own = (batch.column(i).to_numpy() for i in range(3))
        a, b = [], []
        for w in split(batch.column(3)):
            g, at = shingle_sets(w)
            for i in range(w.hi - w.lo):
                mine, row = g[at[i] : at[i + 1]], w.lo + i
                if own[row] == lead[row]:
                    leader, tokens = (lead[row], salt[row]), mine
                elif leader == (lead[row], salt[row]) and len(tokens):
                    place = np.searchsorted(tokens, mine)
                    same = int((tokens[np.minimum(place, len(tokens) - 1)] == mine).sum())
                    if 100 * same >= 80 * (len(tokens) + len(mine) - same):
                        a.append(lead[row])
                        b.append(own[row])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_VERIFY)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is 0.8 or more, by comparing whole sets; texts: (sid, text).

    Each leader a is sent once for CHUNK_MEMBERS of its members.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK_MEMBERS).cast("int").alias("chunks"))
    chunks = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("salt"), F.col("b").alias("own"))
    chunks = chunks.union(chunks.select("a", "salt", F.col("a").alias("own")).distinct())
    rows = chunks.hint("merge").join(texts, F.col("own") == F.col("sid")).select("a", "salt", "own", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("own") != F.col("a"))
    return materialize(rows.mapInArrow(_verify, "a long, b long"), "linked")


def _bits(table: pa.Table) -> pa.Table:
    """The packed bits of a block of cells."""
    bits = np.zeros(1 << FILTER_BLOCK, bool)
    bits[table.column("low").to_numpy()] = True
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text, wide sketch) of the wanted sets.

    A bitmap tells the scan which documents may be wanted, without a shuffle of
    texts; it lets others through now and then, which then go unused. Where there
    are more of them than 2**FILTER bits keep apart, texts are joined by id instead.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    owners = materialize(sets.join(wanted, "sid", "left_semi").select("owner"), "owners")
    bits = max(FILTER_BLOCK, (owners.count() * FILTER_BITS).bit_length())
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int")
    sent = None
    if bits > FILTER:
        bits = FILTER
        docs = docs.join(owners.distinct().hint("merge"), F.col("doc_id") == F.col("owner"), "left_semi")
    else:
        cells = owners.select(F.shiftright(cell("owner"), FILTER_BLOCK).alias("block"), cell("owner").bitwiseAND((1 << FILTER_BLOCK) - 1).alias("low"))
        blocks = bytearray(1 << (bits - 3))
        size = 1 << (FILTER_BLOCK - 3)
        for row in cells.groupBy("block").applyInArrow(_bits, "block int, bits binary").collect():
            blocks[row["block"] * size : (row["block"] + 1) * size] = row["bits"]
        sent = spark.sparkContext.broadcast(bytes(blocks))
    fields = [("doc_id", pa.int64()), ("sid", pa.int64()), ("text", pa.string()), ("wide", pa.binary())]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch
            if sent is not None:
                wanted, c = np.frombuffer(sent.value, np.uint8), batch.column(2).to_numpy()
                some = batch.filter(pa.array((wanted[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1))
            for w in split(some.column(1)):
                g, at = shingle_sets(w)
                sid = pa.array(set_ids(g, at).view(np.int64))
                wide = pa.array([np.packbits(np.bincount((g[a:b] >> np.uint64(64 - WIDE)).astype(int), minlength=1 << WIDE).astype(np.uint8) & 1).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0).slice(w.lo, w.hi - w.lo), sid, some.column(1).slice(w.lo, w.hi - w.lo).cast(pa.string()), wide], schema=pa.schema(fields))

    return materialize(docs.withColumn("cell", cell("doc_id")).mapInArrow(pick, "doc_id long, sid long, text string, wide binary"), "texts")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that the wide sketches don't rule out."""
    for batch in batches:
        both = np.stack([np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (3, 4)]) if batch.num_rows else np.zeros((2, 0, 1), np.uint8)
        far = np.bitwise_count(both[0] ^ both[1]).sum(axis=1)
        yield batch.select([0, 1]).filter(pa.array(9 * far <= batch.column(2).to_numpy()))


def _differ(a: str, b: str) -> Column:
    """Hamming distance of the packed sketches of a and b."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.x{i}").bitwiseXOR(F.col(f"{b}.x{i}"))) for i in range(_WORDS)))


def _possible(a: str, b: str) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * _differ(a, b) <= na + nb)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    return components(docs.select("doc_id", "text", F.lit(0).alias("row"))).select("doc_id", "n_shingles", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """The same and row for each row of docs (doc_id, text, row: a number), with the row's set sid and head_sid.

    head_sid is the set of the component's smallest doc_id, of several its smallest set; null where there is no set.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("row").cast("long").alias("row"))
    profile = materialize(docs.mapInArrow(_profiles, "doc_id long, row long, n long, sid long, " + ", ".join(f"x{i} long" for i in range(_WORDS))), "profiles")
    sets = profile.where("doc_id is not null and n > 0").groupBy("sid").agg(F.min("doc_id").alias("owner"), F.first("n").alias("n"), *(F.first(f"x{i}").alias(f"x{i}") for i in range(_WORDS)))
    sets = materialize(sets, "sets", profile.count())
    docs = docs.select("doc_id", "text")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    buckets = int(total // 2 // BUCKET + 1)
    packed = docs.where("doc_id is not null").select("text").mapInArrow(_keys(buckets), "bucket int, high binary, low binary, sids binary")
    groups = packed.groupBy("bucket").applyInArrow(_group, "keys binary, sids binary, shared binary")
    members = groups.mapInArrow(_unpack(("key", "sid", "shared"), (np.uint64, np.uint64, np.int32)), "key long, sid long, shared long")
    members = materialize(members.groupBy("key", "sid").agg(F.sum("shared").alias("shared")), "members")
    n_sets, n_members = sets.count(), members.count()

    # each set against the most connected set of its groups: of several, the one it shares most with
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    degrees = members.join(sizes, "key").groupBy("sid").agg(F.sum(F.col("shared") * (F.col("size") - 1)).alias("degree"))
    members = materialize(members.join(degrees, "sid"), "members", n_members)
    leaders = members.groupBy("key").agg(F.max(F.struct("degree", "sid")).alias("top")).select("key", F.col("top.sid").alias("a"))
    stars = members.join(leaders, "key").where("sid != a").groupBy("a", F.col("sid").alias("b")).agg(F.sum("shared").alias("shared"))
    stars = stars.join(sets.alias("s"), F.col("a") == F.col("s.sid")).join(sets.alias("t"), F.col("b") == F.col("t.sid")).where(_possible("s", "t")).select("a", "b", "shared")
    best = materialize(stars.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"), "best", n_sets)
    texts = _texts(docs, sets, best.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    links = _linked(best, texts)
    names = connected_components(links, n_sets)

    # what may still join components: every pair of a group in two of them
    named = members.join(names, F.col("sid") == F.col("id"), "left").select("key", "sid", F.coalesce("component", "sid").alias("component"))
    named = materialize(named, "named", n_members)
    torn = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts")).where("lo < hi").select("key", "salts")
    named = named.join(torn, "key").join(sets.drop("owner"), "sid")
    # a large group is dealt out: one side by salt, the other to all of its salts
    one = named.withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int"))
    every = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rest = one.alias("s").join(every.alias("t"), (F.col("s.key") == F.col("t.key")) & (F.col("s.salt") == F.col("t.salt")) & (F.col("s.component") < F.col("t.component")) & _possible("s", "t"))
    rest = rest.select(F.least("s.sid", "t.sid").alias("a"), F.greatest("s.sid", "t.sid").alias("b"), (F.col("s.n") + F.col("t.n")).alias("total"), _differ("s", "t").alias("far")).dropDuplicates(["a", "b"])
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    n_rest = rest.count()
    if n_rest:
        texts = _texts(docs, sets, rest.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
        # first each set's nearest, then all that are left
        both = rest.select(F.col("a").alias("sid"), F.struct("far", "a", "b").alias("pair")).union(rest.select(F.col("b"), F.struct("far", "a", "b")))
        nearest = materialize(both.groupBy("sid").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct(), "nearest", n_rest)
        links = links.union(_linked(nearest, texts))
        names = connected_components(links, n_sets + n_rest)
        label = lambda c: names.select(F.col("id").alias(f"id_{c}"), F.col("component").alias(f"in_{c}"))
        wide = texts.select("sid", "wide")
        open_ = rest.join(nearest, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            open_ = open_.join(label(end), F.col(end) == F.col(f"id_{end}"), "left").withColumn(f"in_{end}", F.coalesce(f"in_{end}", end))
        open_ = open_.where("in_a != in_b").select("a", "b", "total")
        for end in ("a", "b"):
            open_ = open_.join(wide.select(F.col("sid").alias(f"sid_{end}"), F.col("wide").alias(f"wide_{end}")), F.col(end) == F.col(f"sid_{end}")).drop(f"sid_{end}")
        open_ = materialize(open_.select("a", "b", "total", "wide_a", "wide_b").mapInArrow(_near, "a long, b long").distinct(), "open", n_rest)
        if not open_.isEmpty():
            links = links.union(_linked(open_, texts))
            names = connected_components(links, n_sets + n_rest)

    owned = sets.join(names, F.col("sid") == F.col("id"), "left").select("sid", "owner", F.coalesce("component", "sid").alias("component"))
    heads = owned.groupBy("component").agg(F.min(F.struct("owner", "sid")).alias("head"))
    owned = owned.join(heads, "component").select(F.col("sid").alias("of"), F.col("head.owner").alias("head"), F.col("head.sid").alias("head_sid"))
    found = profile.select("doc_id", "row", "n", "sid").join(owned, F.col("sid") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("head"))
    return found.select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), "sid", "head_sid")
