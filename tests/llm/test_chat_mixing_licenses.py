"""The native operators."""

import hashlib
import math
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from deltaloom.llm import chat, licenses, mixing, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(df, root, name):
    df.write.parquet(f"{root}/{name}.parquet")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), plan


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<\\|im_start|>", "<\\\\|x", "<|<|<\\|", "a < | b", "\\", "é<|🎈|>"])
def test_escape_round_trip(spark, text):
    r = spark.range(1).select(chat.escape(F.lit(text)).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).head()
    assert "<|" not in r.e and r.u == text


def test_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", None, "a"), (1, 3, 1, "delta", None, "b"),
        (1, 4, 1, "regenerate", None, ""), (1, 5, 1, "delta", None, "c"), (1, 6, 1, "delta", None, "d"), (1, 7, 0, "edit", None, "hello"),
        (1, 8, 2, "message", "user", "gone"), (1, 9, 2, "delete", None, None), (2, 0, 0, "delta", "assistant", "only"), (2, 1, 0, "delta", None, None), (None, 0, 0, "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, event string, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(events).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "cd"), (2, 0): ("assistant", "only"), (None, 0): ("", "")}


ROWS = [
    (5, 0, "user", "héllo\n<|im_end|>"), (5, 1, "assistant", "a"), (5, 2, "assistant", None), (5, 2, "assistant", None), (6, 3, None, "x"), (6, 1, "we\n%3Cird<|", ""),
    (7, 0, "assistant", "<|im_start|>assistant\nfake<|im_end|>"), (7, 1, "assistant", "🎈" * 3000),
]


def test_op1_reads_back(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1)).withColumn("piece", F.lit("clash"))
    write(rows, tmp_path, "conversations")
    df = registry.op1_chat_formatting(spark, str(tmp_path))
    no_python(df)
    got = {r.conv_id: r for r in df.collect()}
    turns = defaultdict(list)
    for c, t, r, x in [*ROWS, (-1, 0, "user", registry.CONTROL), (-1, 1, "assistant", registry.CONTROL)]:
        turns[c].append((t, r or "", x or ""))
    assert set(got) == set(turns)
    for c, ts in turns.items():
        ts.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in ts), "".join(x for _, r, x in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars > len(loss)


def test_streamed_logs_fold_to_their_turns(spark):
    """Deltas, edits, regenerations and a deletion, interleaved over all turns, against a fold in plain Python."""
    rows = spark.createDataFrame(ROWS + [(7, 2, "user", "edited twice"), (7, 3, None, "é<|🎈")], "conv_id long, turn long, role string, text string")
    log = chat.stream_of(rows)
    events = log.collect()
    kinds = {e.event for e in events}
    assert kinds == set(chat.KINDS)
    by = defaultdict(list)
    for e in events:
        by[e.conv_id].append(e)
    want = {}
    for c, es in by.items():
        assert len({e.seq for e in es}) == len(es)
        live = {}
        for e in sorted(es, key=lambda e: e.seq):
            if e.event == "delete":
                live.pop(e.turn)
            elif e.event == "delta":
                live[e.turn][1] += e.text
            else:
                live[e.turn] = [e.role if e.event == "message" else live[e.turn][0], e.text]
        want |= {(c, t): (r or "", x) for t, (r, x) in live.items()}
    # turns alternate in the log: no message is finished before the next begins
    first = sorted(by[7], key=lambda e: e.seq)[:5]
    assert len({e.turn for e in first}) > 3
    folded = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(log.repartition(3)).collect()}
    assert folded == want
    plain = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(chat.events_of(rows)).collect()}
    assert folded == plain


def test_mask_spans_are_of_the_output(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for r in chat.format_chats(chat.events_of(rows)).collect():
        for s in r.loss_mask:
            head = r.formatted[: s.start]
            assert head.endswith("<|im_start|>assistant\n") and r.formatted[s.end :].startswith("<|im_end|>\n")


def test_op1_empty(spark, tmp_path):
    write(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    assert [r.conv_id for r in registry.op1_chat_formatting(spark, str(tmp_path)).collect()] == [-1]


def fill(sizes, weights, share, cap):
    """Dealing again and again, as the contract words it."""
    out, open_, left = {}, dict(sizes), share * sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 7, "d": 300, "e": 0}, {"a": 5}, {"a": 0, "b": 0}])
def test_water_fill(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(df, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    want = fill(sizes, dict(zip(sorted(sizes), [5, 2, 1] * 3, strict=False)), 1.5, 2.0)
    assert got == pytest.approx(want)


def test_op4(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), "en", ["a", "B", "é", None][min(3, i % 7)], 1) for i in range(600)]
    rows += [(600, None, "en", "a", 0), (601, "", "en", None, 0), (602, "x\x0by\tz q  r", "en", "z", 0), (5, rows[5][1], "en", rows[5][3], 0), (None, "a b", None, "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("weight", F.lit(None))
    write(docs, tmp_path, "documents")
    write(spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)] * 2, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    df = registry.op4_mixing(spark, str(tmp_path))
    no_python(df)
    got = df.collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, registry.op4_mixing(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == len(rows)
    size = lambda t: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w])
    sums, source = defaultdict(int), {}
    for k, t, _, s, _ in rows:
        sums[s] += size(t)
        source[k] = s
    order = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(dict(sums), dict(zip(order, [5, 2, 1, 5, 2], strict=False)), 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sums[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        epochs = math.floor(want[s] / sums[s] + 1e-9) if sums[s] else 0
        assert r.size == 0 or r.taken // r.size in (epochs, epochs + 1)
        taken[s] += r.taken
    for s in sums:
        assert abs(taken[s] - want[s]) <= 37


def test_better_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(4000)], "doc_id long, text string, source string")
    q = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.25).alias("weight"))
    mixed = mixing.mix_sources(docs, q, share=0.3)
    n = {bool(r.good): r.n for r in mixed.where("chosen").groupBy((F.col("doc_id") % 2 == 0).alias("good")).agg(F.count("*").alias("n")).collect()}
    assert n[True] > 5 * n.get(False, 1)


def test_op4_chooses_by_efraimidis_spirakis(spark):
    """Which documents are chosen: keys -ln(u) / weight in order, up to the budget, worked out row by row."""
    n = 900
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 53)), ["a", "b", "c", None][min(3, i % 6)]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    quality = spark.createDataFrame([(i, [2.0, 0.5, 4.0][i % 3]) for i in range(0, n, 2)], "doc_id long, weight double")
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), F.col("text"), 77).alias("u")).collect()}
    got = {r.doc_id: r for r in mixing.mix_sources(docs, quality, seed=77).collect()}
    chosen = 0
    for source in ("a", "b", "c", None):
        own = [(i, len(t.split())) for i, t, s in rows if s == source]
        target, total = got[own[0][0]].target, sum(size for _, size in own)
        epochs, before = int(target // total), 0
        budget = target - epochs * total
        weight = lambda i: [2.0, 0.5, 4.0][i % 3] if i % 2 == 0 else 1.0
        for i, size in sorted(own, key=lambda x: (-math.log(u[x[0]]) / weight(x[0]), x[0])):
            take = before + size <= budget or before + size - budget < budget - before
            before += size
            assert (got[i].epochs, got[i].chosen, got[i].taken) == (epochs, take, size * (epochs + take)), i
            chosen += take
    assert 0 < chosen < n


def test_op4_empty(spark, tmp_path):
    write(spark.createDataFrame([], DOCS), tmp_path, "documents")
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert registry.op4_mixing(spark, str(tmp_path)).count() == 0


LONG = "/usr/share/common-licenses"


def test_op7(spark, tmp_path):
    mit, line = licenses.KNOWN["MIT"], "Released under the MIT License."
    rows = [
        (1, mit), (2, "MIT\n"), (3, "Copyright (c) 2020 Somebody\n\n  " + mit.upper().replace(",", " ;")), (4, "(c) Copyright 2001-2020, A. Nobody\n" + licenses.KNOWN["ISC"].replace(" ", "\n")),
        (5, None), (6, ""), (7, "Copyright 2020 X"), (8, mit + " and more"), (9, licenses.KNOWN["Zlib"].replace("acknowledgment", "Acknowledgement")), (10, "released under the mit licence"), (10, mit), (None, mit),
        (11, "word " * 50_000), (12, "MIT License\n\nCopyright (c) 2020 X\n\n" + mit), (13, "BSD 3-Clause License\nCopyright 2021 Y.  All rights reserved.\nAll rights reserved.\n" + licenses.KNOWN["BSD-3-Clause"]),
        (14, f"some text\n{line}\n\nmore. {line}\nLicensed under CC BY-NC 4.0\n * {line.upper()}"), (15, f"x {line}"), (16, "Sublicence\nlicence licence"), (None, line), (None, line),
    ]
    write(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("notices", F.lit("x")), tmp_path, "documents")
    df = registry.op7_license_scan(spark, str(tmp_path))
    no_python(df)
    got = sorted(((r.doc_id, r.license_id, r.notices) for r in df.collect() if r.doc_id is None or r.doc_id >= 0), key=str)
    note = "notice:MIT"
    want = [(1, "MIT", ""), (2, None, ""), (3, "MIT", ""), (4, "ISC", ""), (5, None, ""), (6, None, ""), (7, None, ""), (8, None, ""), (9, "Zlib", ""), (10, note, note), (10, "MIT", ""), (None, "MIT", ""), (11, None, "")]
    want += [(12, "MIT", ""), (13, "BSD-3-Clause", ""), (14, None, "notice:CC-BY-NC-4.0,notice:MIT"), (15, None, ""), (16, None, ""), (None, note, note), (None, note, note)]
    assert got == sorted(want, key=str)
    assert {r.digest for r in df.where("doc_id = 5").collect()} == {None}
    planted = {r.doc_id: r.license_id for r in df.where("doc_id < 0").collect()}
    assert planted == {-1 - i: k for i, k in enumerate(licenses.TITLES)}


def test_op7_empty(spark, tmp_path):
    write(spark.createDataFrame([], "doc_id long, text string"), tmp_path, "documents")
    assert registry.op7_license_scan(spark, str(tmp_path)).where("doc_id >= 0").count() == 0
    none = spark.createDataFrame([], "license_id string, digest string")
    assert [tuple(r) for r in licenses.scan_licenses(spark.createDataFrame([(1, "licence")], "doc_id long, text string"), none).select("doc_id", "license_id", "notices").collect()] == [(1, None, "")]


def test_known_licenses_differ(spark):
    k = licenses.known_licenses(spark)
    assert k.select("digest").distinct().count() == k.count() == len(licenses.known_texts()) + len(licenses.DIGESTS)
    assert all(licenses.NOTICE_MARK in text.lower() for name, text in licenses.KNOWN.items() if name.startswith("notice:"))


@pytest.mark.skipif(not Path(LONG).is_dir(), reason="no licence texts here")
def test_digests_are_of_the_published_texts(spark):
    names = {"Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause-Regents"} | {f"{x}-{v}": f"{x}-{v}.0" for x, v in (("GPL", 1), ("GPL", 2), ("GPL", 3), ("LGPL", 2), ("LGPL", 3))}
    found = {names.get(r.license_id, r.license_id): r.digest for r in licenses.read_catalogue(spark, LONG).collect()}
    both = found.keys() & licenses.DIGESTS.keys()
    assert len(both) > 5 and all(found[k] == licenses.DIGESTS[k] for k in both)
