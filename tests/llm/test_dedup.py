"""Substring dedup and the Jaccard join against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import components, jaccard_join, registry, substring_dedup, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def write(spark, rows, root):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("sid", F.lit(0)).repartition(5).write.parquet(f"{root}/documents.parquet")


def brute_substring(rows, window=50):
    first, out = {}, []
    split = [(k, WORD.findall(t or "")) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - window + 1 if k is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, k), k)
    for k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if k is not None else 0):
            if first[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def prose(rng, n):
    return [f"w{x}" for x in rng.integers(0, 400, n)]


def corpus(seed):
    rng = np.random.default_rng(seed)
    shared, long = prose(rng, 70), prose(rng, 6000)
    rows = []
    for i in range(120):
        own = prose(rng, int(rng.integers(0, 150)))
        if i % 3 == 0:  # a third of all rows hold one passage
            at = int(rng.integers(0, len(own) + 1))
            own = own[:at] + shared[: int(rng.integers(48, 71))] + own[at:]
        rows.append((i, " ".join(own)))
    rows += [(200, " ".join(long)), (201, "x " + "\t".join(long[1000:3000]) + "\nend"), (202, "be " * 500), (203, "be " * 80), (204, None), (205, ""), (206, " \t\r\n\x0b\x0c "), (207, "ü x ñ " * 60)]
    rows += [(208, rows[0][1]), (7, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (-5, rows[6][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_op2(spark, tmp_path, seed):
    rows = corpus(seed)
    write(spark, rows, tmp_path)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in registry.op2_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_substring(rows)


def test_op2_with_a_full_sketch(spark, tmp_path, monkeypatch):
    """A sketch in which every cell is taken changes nothing; nor do many buckets."""
    for name, value in (("MIN_CELLS", 16), ("MAX_CELLS", 16), ("BUCKET", 40)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = corpus(3)
    write(spark, rows, tmp_path)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in registry.op2_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_substring(rows)


def test_op2_in_several_passes(spark, tmp_path, monkeypatch):
    """Anchors dealt out over sketches of their own."""
    monkeypatch.setattr(substring_dedup, "MAX_CELLS", 16)
    monkeypatch.setattr(substring_dedup, "FULL_BYTES", 0.5)
    rows = corpus(4)
    write(spark, rows, tmp_path)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in registry.op2_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_substring(rows)


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("size", [1 << 10, 1 << 12, 1 << 16])
def test_words_that_collide_by_construction_elsewhere(spark, tmp_path, size):
    """Thue-Morse strings have equal polynomial hashes modulo 2**64, whatever the base."""
    pairs = [(thue_morse(size, x), thue_morse(size, x[::-1])) for x in ("ab", "xy", "01", "AB", "éo")]
    (w,) = words.split(pa.array([" ".join(a for a, _ in pairs) + " " + " ".join(b for _, b in pairs)], pa.string()))
    for family in (0, 1):
        assert len(set(w.hashes(family).tolist())) == 10
    some = pairs if size < 1 << 16 else pairs[:1]
    rows = [(1, " ".join(some[i % len(some)][0] for i in range(50))), (2, " ".join(some[i % len(some)][1] for i in range(50))), (3, "a b c d e f g " + some[0][0]), (4, "a b c d e f g " + some[0][1])]
    write(spark, rows, tmp_path)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in registry.op2_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_substring(rows) and all(r[2] == 0 for r in got)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in registry.op10_jaccard_join(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_join(rows)


def test_word_hashes_tell_all_lengths_apart():
    rng = np.random.default_rng(3)
    letters = np.array(list("abAB01é"))
    some = sorted({"".join(rng.choice(letters, n)) for n in [*range(1, 80), *range(60, 70), 500, 5000] for _ in range(12)} | {"a" * n for n in range(1, 200)})
    (w,) = words.split(pa.array([" ".join(some)]))
    assert len(set(w.hashes().tolist())) == len(some) and len(set(w.hashes(lower=True).tolist())) == len({"".join(c.lower() if c.isascii() else c for c in x) for x in some})
    again = np.concatenate([v.hashes() for v in words.split(pa.array([f"{'x' * i} {x}" for i, x in enumerate(some, 1)]))])
    assert again[1::2].tolist() == w.hashes().tolist()  # wherever a word lies
    g = w.hashes()[:300]
    for k in (1, 2, 3, 5, 10, 49, 50, 64, 300):
        a = words.grams(np.concatenate([g, g]), k)
        assert (a[: 301 - k] == a[300 : 601 - k]).all() and len(set(a[:300].tolist())) == 300


def test_sketch_never_underestimates():
    rng = np.random.default_rng(0)
    anchors = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    twice = anchors[:1000]
    counts = [np.zeros(1 << 16, int) for _ in range(2)]
    for a in (anchors, twice):
        for r in range(2):
            np.add.at(counts[r], substring_dedup._cells(a, r, 16).astype(int), 1)
    bitmap = [np.packbits(c >= 2, bitorder="little") for c in counts]
    assert substring_dedup._seen(bitmap, twice, 16).all()
    assert substring_dedup._seen(bitmap, anchors[1000:], 16).mean() < 0.2


def test_op2_empty(spark, tmp_path):
    write(spark, [], tmp_path)
    assert registry.op2_substring_dedup(spark, str(tmp_path)).count() == 0


def test_words():
    texts = ["a  b\tc", None, "", "\x0b", "é ü x", "end"]
    (w,) = words.split(pa.array(texts))
    assert w.counts().tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = w.hashes(lower=True)
    (v,) = words.split(pa.array(["A B C"]))
    assert (v.hashes(lower=True) == h[:3]).all() and not (v.hashes() == h[:3]).any() and (v.hashes(1) != v.hashes(0)).all()
    g = words.grams(h, 2)
    assert len(set(g.tolist())) == len(g) == len(h) - 1


def sets_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for k, t in rows:
        w = WORD.findall((t or "").translate(low))
        out.append((k, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute_join(rows):
    sets = sets_of(rows)
    parent = {k: k for k, _ in sets if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((k, len(s), k if k is None or not s else find(k)) for k, s in sets), key=str)


def near_copies(seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for size in (3, 4, 5, 6, 7, 8, 9, 12, 20, 35, 60, 120, 400):
        for _ in range(2):
            base = prose(rng, size)
            for c in range(9):
                w = list(base)
                for _ in range(int(rng.integers(0, max(2, size // 12)))):
                    w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 999)}"
                if c % 4 == 1:
                    w = w + prose(rng, int(rng.integers(0, size // 4 + 1)))
                rows.append((int(k), " ".join(w)))
                k += 1
    shared = prose(rng, 60)
    for _ in range(60):  # a common passage that makes no links
        rows.append((int(k), " ".join(shared + prose(rng, int(rng.integers(60, 130))))))
        k += 1
    rows += [(k + 1, None), (k + 2, ""), (k + 3, " \t"), (k + 4, "One two"), (k + 5, "one TWO"), (k + 6, "two one"), (k + 7, rows[100][1].upper()), (5, rows[5][1]), (None, rows[5][1]), (k + 8, "be " * 3000), (k + 9, "be be be be be")]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op10(spark, tmp_path, seed):
    rows = near_copies(seed)
    write(spark, rows, tmp_path)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in registry.op10_jaccard_join(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_join(rows)


def test_op10_beyond_the_filter_and_with_dealt_out_groups(spark, tmp_path, monkeypatch):
    """Texts are joined by id where the filter would be too large; groups of more than three sets are dealt out."""
    monkeypatch.setattr(jaccard_join, "FILTER", 15)
    monkeypatch.setattr(jaccard_join, "TOGETHER", 3)
    rows = near_copies(4)
    write(spark, rows, tmp_path)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in registry.op10_jaccard_join(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_join(rows)


def test_op10_empty(spark, tmp_path):
    write(spark, [], tmp_path)
    assert registry.op10_jaccard_join(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("size", [4, 5, 8, 9, 13, 14, 30, 31, 150, 700])
def test_sets_within_the_bound_share_a_key(size):
    """Pigeonhole: any two sets of Jaccard similarity 0.8 or more have an equal block."""
    rng = np.random.default_rng(size)
    for _ in range(30):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        drop = int(rng.integers(0, size // 5 + 1))
        more = int(0.25 * (size - drop) - drop * 1.25) if rng.random() < 0.8 else 0
        kept = a[drop:]
        b = np.concatenate([kept, rng.integers(0, 2**63, max(0, more), dtype=np.uint64)])
        i, u = len(kept), size + len(b) - len(kept)
        if 100 * i < 80 * u or i == u:
            continue
        both = [set(np.concatenate([k for k, _ in jaccard_join._block_keys(np.sort(x), np.array([0, len(x)]))]).tolist()) for x in (a, b)]
        assert both[0] & both[1], (size, drop, more)


def test_set_ids_are_of_sets():
    (w,) = words.split(pa.array(["a b c d e f", "A b c d e f", "a b c d e f a b c d e f", "b c d e f a"]))
    g, at = jaccard_join.shingle_sets(w)
    ids = jaccard_join.set_ids(g, at).tolist()
    assert ids[0] == ids[1] and len(set(ids)) == 3 and np.diff(at).tolist() == [2, 2, 6, 2]


def test_components_of_long_chains(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, tag, rows=None: (written.append(tag), spark.createDataFrame(df.collect(), df.schema))[1])
    edges = [(i, i + 1) for i in range(60)]
    got = {r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), len(edges)).collect()}
    assert len(got) == 1 and len(written) < 10


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (600, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(2000, 2300)] + [(7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), len(edges)).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    groups, mine = defaultdict(set), defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
        mine[got[x]].add(x)
    assert set(got) == set(parent) and Counter(map(frozenset, groups.values())) == Counter(map(frozenset, mine.values()))
