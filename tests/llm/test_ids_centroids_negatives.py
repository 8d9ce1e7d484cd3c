"""Token ids, centroid clustering and hard negatives against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracles import same

from deltaloom.llm import centroids, negatives, registry, token_ids, topk

DOCS = "doc_id long, text string, ids string, nth string, start long"
VECTORS = "vec_id long, embedding array<double>, label int, v string, score long"


# --- token ids -----------------------------------------------------------------------------------


def plain(tokenizer=None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer or token_ids.word_bpe())


AWKWARD = [
    None, "", " ", "\t\n", "a", "A-b's 'sand ''s 12３ x", "It's we'll I'VE 'Re", "é́ é É ß ẞ İ Σς ΑΣ ª º µ × ÷ a×b÷c ÀÿÞ", "x\x00y \x1c\x1d z\x85q\xa0r s　t",
    "<|endoftext|>", "a<|startoftext|>b <|endoftext|> <|nothing|> <|ENDOFTEXT|>", "日本語 текст 한국어 🎈🎈 \U0001f468‍\U0001f469", "́abc ́", "w" * 70 + "! " + "w" * 64, "!?&&&***", "﻿a ﬁ ﬂ Ⅷ ⅷ ǅ",
]


def texts_of(rng, n):
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCXYZ'’.,!?<|>-_0123456789éèÀßÿŸøЖжΣσςİıǅ中文🎈́̈\xa0 \x1c\x00 \n\t      "))
    return ["".join(rng.choice(letters, rng.integers(0, 200))) for _ in range(n)]


def test_words_give_the_ids_of_whole_texts():
    with open(token_ids.word_bpe(), encoding="utf-8") as f:
        coder = token_ids.Coder(f.read())
    assert coder.by_words
    texts = [t or "" for t in AWKWARD] + texts_of(np.random.default_rng(1), 3000)
    want = [e.ids for e in plain().encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # learned, then remembered
        got = coder.encode([t.encode() for t in texts])
        assert [np.frombuffer(x, coder.kind).tolist() for x in got] == want


def test_bounds_of_what_is_remembered(monkeypatch):
    monkeypatch.setattr(token_ids, "CHUNK", 300)
    monkeypatch.setattr(token_ids, "WORDS", 20)
    monkeypatch.setattr(token_ids, "PIECES", 10)
    monkeypatch.setattr(token_ids, "ONCE", 30)
    with open(token_ids.word_bpe(), encoding="utf-8") as f:
        coder = token_ids.Coder(f.read())
    texts = [t or "" for t in AWKWARD] + ["the cat " * 500, "x" * 5000] + texts_of(np.random.default_rng(2), 300)
    want = [e.ids for e in plain().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode([t.encode() for t in texts])] == want


class Asked(dict):
    """What is remembered, and how often it was asked for."""

    times = 0

    def get(self, *key):
        Asked.times += 1
        return super().get(*key)

    def __getitem__(self, key):
        Asked.times += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        Asked.times += 1
        return super().__contains__(key)


def test_equal_words_are_looked_up_once_for_many_texts():
    with open(token_ids.word_bpe(), encoding="utf-8") as f:
        coder = token_ids.Coder(f.read())
    coder.words, coder.pieces, coder.once, Asked.times = Asked(), Asked(), Asked(), 0
    texts = ["The cat's hat, ÉTÉ 12. ", "café x÷y 日本語 "] * 300
    found = coder.encode([(t * 10).encode() for t in texts])
    assert [np.frombuffer(x, coder.kind).tolist() for x in found[:2]] == [e.ids for e in plain().encode_batch([t * 10 for t in texts[:2]], add_special_tokens=False)]
    assert 0 < Asked.times < 200


def test_contractions_and_letters_of_two_bytes():
    with open(token_ids.word_bpe(), encoding="utf-8") as f:
        coder = token_ids.Coder(f.read())
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("''stremvldSTREVLÉÀßÿ×÷Þ\"-9<  "), rng.integers(0, 30))) for _ in range(3000)]
    texts += ["", "'s", "'re'll''s'", "'", "<|endoftext|>'s'<|endoftext|>", "9's9", "'s\u0301 'se"]
    want = [e.ids for e in plain().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode([t.encode() for t in texts])] == want


def test_bytes_that_are_no_text():
    with open(token_ids.word_bpe(), encoding="utf-8") as f:
        coder = token_ids.Coder(f.read())
    texts = [b"\x80", b"ab \x80 c\xc3", b"\xc3 \xa9", b"\xc3\xc3\xa9\xa9", b"\xff\xfe x"]
    want = [plain().encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, coder.kind).tolist() for x in [*(y for t in texts for y in coder.encode([t])), *coder.encode(texts)]] == want * 2


@pytest.mark.parametrize("n", [0, 1, 3, 4, 1001])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    numbers = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
    numbers[: min(n, 8)] = [0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1][: min(n, 8)]
    controls, data = token_ids.pack(numbers)
    assert len(controls) == -(-n // 4) and len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in numbers)
    assert token_ids.unpack(controls, data, n).tolist() == numbers.tolist()


def op11(spark, root, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    return [tuple(r) for r in registry.op11_token_ids(spark, str(root)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]


def test_op11(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK", 2000)
    rng = np.random.default_rng(3)
    rows = [(int(k), t, "x", "y", 7) for k, t in zip(rng.permutation(2000) - 100, AWKWARD + texts_of(rng, 600))] + [(3000, "long text " * 60_000, None, None, None)]
    want, start, tokenizer = [], 0, plain()
    for k, text, *_ in sorted(rows):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(op11(spark, tmp_path, rows)) == want


def test_op11_repeated_and_null_ids(spark, tmp_path):
    rows = [(5, "same text", None, None, None)] * 3000 + [(None, f"no id {i % 7}", None, None, None) for i in range(5000)] + [(1, "a", None, None, None)]
    found = sorted(op11(spark, tmp_path, rows), key=lambda r: r[1])
    assert len(found) == len(rows) and [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found[:-1]]).tolist()
    assert [r[0] for r in found] == [1] + [5] * 3000 + [None] * 5000
    assert op11(spark, tmp_path / "empty", []) == []


def test_files_and_other_tokenizers(spark, tmp_path):
    import public_tokenizers

    texts = [t for t in AWKWARD if t] + ["the the the the cat"]
    other = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_ids.write_ids(token_ids.encode_documents(docs, other, 50256), str(tmp_path / "ids"))
    back = token_ids.read_ids(spark, str(tmp_path / "ids")).orderBy("doc_id").collect()
    want = [[*plain(other).encode(t, add_special_tokens=False).ids, 50256] for t in texts]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in back] == want
    ranks = spark.read.parquet(str(tmp_path / "ids/ranks")).orderBy("rank").collect()
    counts = {}
    for i in (i for ids in want for i in ids):
        counts[i] = counts.get(i, 0) + 1
    assert [(r["id"], r["n"]) for r in ranks] == sorted(counts.items(), key=lambda x: (-x[1], x[0])) and [r["rank"] for r in ranks] == list(range(len(counts)))
    blocks = spark.read.parquet(str(tmp_path / "ids/blocks")).collect()
    assert sum(len(b["data"]) for b in blocks) < 2 * sum(map(len, want)) and all(len(b["controls"]) == -(-sum(b["lengths"]) // 4) for b in blocks)


# --- clustering ----------------------------------------------------------------------------------


def lloyd(rows, k, rounds, scale, d):
    kept = [(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:k]]
    far = lambda v, x: sum((a - b) ** 2 for a, b in zip(v, x))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(c)):
            if members := [v for (_, v), to in zip(kept, own) if to == j]:
                c[j] = tuple(sum(x) // len(members) for x in zip(*members))
    return sorted(((i, near(v), min(far(v, c[near(v)]), 2**63 - 1)) for i, v in kept), key=str), c


@pytest.mark.parametrize(("n", "spread", "k"), [(0, 1, 4), (3, 1, 4), (300, 1, 1), (300, 3, 8), (1200, 0.01, 5), (300, 1e8, 8)])
def test_clusters_are_those_of_lloyd(spark, monkeypatch, n, spread, k):
    monkeypatch.setattr(centroids, "TREE", 200)
    monkeypatch.setattr(centroids, "LEAF", 4)
    rng = np.random.default_rng(n)
    rows = [(i, (rng.standard_normal(3) * spread + 5 * (i % 4)).tolist()) for i in range(n)]
    rows += [(None, [0.0, 1.0, 2.0]), (7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (9, [1.0, None, 2.0]), (10, [float("nan"), 0.0, 0.0]), (11, None), (12, []), (13, [1.0]), (14, [float("inf")] * 3)][: 9 * bool(n)]
    table = spark.createDataFrame([(*r, None, "x", None) for r in rows], VECTORS).repartition(3)
    found, c = centroids.cluster(table, k, 3, 64.0, 3)
    want, ends = lloyd(rows, k, 3, 64.0, 3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and [tuple(x) for x in c.tolist()] == ends


def test_ties_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(centroids, "LEAF", 2)
    rows = [(i, [float(i % 2 * 2), 0.0]) for i in range(40)] + [(100 + i, [1.0, 0.0]) for i in range(20)] + [(200, [1e15, -1e15]), (201, [-3e15, 1.0]), (202, [2e14, 1e15])]
    table = spark.createDataFrame([(*r, None, None, None) for r in rows], VECTORS)
    for scale in (1.0, 64.0):
        found, c = centroids.cluster(table, 6, 3, scale, 2)
        want, ends = lloyd(rows, 6, 3, scale, 2)
        assert sorted((tuple(r) for r in found.collect()), key=str) == want and [tuple(x) for x in c.tolist()] == ends
    reported = centroids.report(found, c).collect()
    by = {}
    for _, j, d in want:
        by[j] = by.get(j, 0) + d
    assert all(r["cluster_inertia"] == min(by[r["cluster"]], 2**63 - 1) and r["inertia"] == min(sum(by.values()), 2**63 - 1) for r in reported)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, ends[r["cluster"]])).encode()).hexdigest() for r in reported)


def test_far_centroids_are_dropped_and_nodes_assigned_whole(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(-50, 50, (500, 4)) + 1000 * j for j in range(4)]).astype(np.int64)
    order, nodes, low, high = centroids.build(v)
    v = v[order]
    sums = np.array([v[a:b].sum(axis=0) for a, b in nodes[:, :2]])
    tree = centroids._Tree({"n": len(v), "v": v.tobytes(), "nodes": nodes.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "sums": sums.tobytes()}, 4)
    found = list(centroids.filtered(tree, np.array([[1000 * j] * 4 for j in range(4)])))
    assert len(found) < 20 and all(isinstance(to, int) for *_, to in found)
    assert sorted((b - a, to) for _, a, b, to in found) and sum(b - a for _, a, b, _ in found) == len(v)


def test_op12_of_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(64).tolist(), i % 3, None, None) for i in range(30)] + [(1, [0.5] * 64, 1, None, None)] * 5000 + [(None, [0.25] * 64, None, None, None)] * 5000 + [(40, [1.0] * 63, 1, None, None)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, tmp_path, "op12_centroid_clustering", ("embeddings",))


# --- hard negatives ------------------------------------------------------------------------------


def mined(rows, k=10):
    kept = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, *_ in kept if i % 100 == 0}):
        _, label, a = min(r for r in kept if r[0] == i)
        scores = sorted((-sum(x * y for x, y in zip(a, v)), j, own) for j, own, v in kept if j != i)
        for place, (p, j, _) in enumerate([s for s in scores if s[2] == label][:5]):
            fine = [(m, -n) for n, m, own in scores if own != label and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(i, j, rank + 1, m, -p, n, place + 1) for rank, (m, n) in enumerate(fine[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "labels", "scale"), [(0, 1, 1), (1, 1, 1), (700, 3, 1), (700, 1, 1), (250, 2, 1e6), (400, 400, 1)])
def test_hard_negatives(spark, monkeypatch, n, labels, scale):
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "CANDIDATES", 64)
    monkeypatch.setattr(negatives, "GROUP", 2)
    rng = np.random.default_rng(n)
    rows = [(i, (np.abs(rng.integers(0, 4, 3)) / 2 * scale).tolist(), int(rng.integers(labels)), "x", 3) for i in range(n)]
    rows += [(100, [1.0, 0.5, 0.0], 0, None, None), (100, [1.0, 0.5, 0.0], 1, None, None), (None, [1.0] * 3, 0, None, None), (2, [1.0] * 3, None, None, None), (3, [None, 1.0, 1.0], 0, None, None), (4, None, 0, None, None), (5, [float("nan")] * 3, 0, None, None)][: 7 * bool(n)]
    rows += [(8, [1.0], 0, None, None), (9, [], 0, None, None), (200, [], 0, None, None)][: 3 * bool(n)] + [(11, [2.0, 2.0, 2.0], 0, None, None)] * (30 * bool(n))
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows)


def test_limits_are_exact(spark):
    rows = [(0, [1.0], 0), (1, [10 / 256], 0), *((10 + i, [i / 256], 1) for i in range(12))]
    found = negatives.hard_negatives(spark.createDataFrame([(*r, None, None) for r in rows], VECTORS), F.col("vec_id") == 0, 256.0)
    # of a positive score of 2,560 those from 768 to 2,304
    assert [r["negative_id"] for r in found.orderBy("rank").collect()] == [19, 18, 17, 16, 15, 14, 13]


def test_anchors_are_not_broadcast(spark, monkeypatch):
    plans, write = [], negatives.materialize

    def planned(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(negatives, "materialize", lambda df, tag: write(planned(df), tag))
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(8).tolist(), i % 3, None, None) for i in range(600)]
    planned(negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0))
    # small as their files are, each anchor has a copy for every salt
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


def test_queries_are_not_broadcast(spark):
    rng = np.random.default_rng(10)
    rows = [(i, rng.standard_normal(8).tolist(), None, None, None) for i in range(600)]
    found = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, 3)
    assert len(found.collect()) == 18 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_op13_of_a_hot_label(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist(), 1 if i % 3 else int(rng.integers(10)), None, None) for i in range(1500)] + [(77, [0.5] * 8, 1, None, None)] * 500 + [(None, [0.5] * 8, 1, None, None)] * 500
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, tmp_path, "op13_hard_negatives", ("embeddings",))
