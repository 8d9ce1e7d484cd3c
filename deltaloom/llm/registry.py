"""Queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import centroids, chat, decontaminate, jaccard_join, licenses, mixing, negatives, quality, secrets, substring_dedup, token_ids, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Said by both turns of conversation -1.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    back = chat.read_back(chat.format_chats(chat.stream_of(rows.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + 2 * (length(role) - length(replace(replace(replace(role, '%', ''), chr(10), ''), '<', '')))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + {len(chat.START + chat.END) + 2}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.quality_weights(_table(spark, sf_dir, "labels"))
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), quality)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_DOUBLE = "CAST({} AS DOUBLE)".format
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(sha256(text), '') AS digest, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
q AS (SELECT doc_id, max({_DOUBLE(f"CASE quality WHEN 1 THEN {mixing.GOOD} ELSE {mixing.POOR} END")}) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln((CAST('0x' || substr(sha256('{mixing.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || digest), 1, 13) AS BIGINT) + {_DOUBLE(0.5)}) / pow(2, 52)) / coalesce(weight, 1) AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {_DOUBLE(mixing.CAP)} * sum(size) AS cap, {_DOUBLE(f"{list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]")} AS w FROM d GROUP BY source),
l AS (SELECT *, ({_DOUBLE(mixing.SHARE)} * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(cap, w * coalesce((SELECT max(level) FROM l WHERE level * w <= cap), CAST('inf' AS DOUBLE))) ELSE 0 END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto FROM k),
c AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget, upto FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto <= budget OR upto - budget < budget - (upto - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(toxicity.sample_of(docs, labels, "toxic"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


#: Whole licences as files have them: with a title, a holder, capitals and another spelling. Scanned with the documents.
PLANTED = [
    (-1 - i, f"{titles[0]}\n\nCopyright (c) 20{10 + i} Some Holder\nAll rights reserved.\n\n" + licenses.KNOWN[k].upper().replace(" LICENSE", " LICENCE"))
    for i, (k, titles) in enumerate(licenses.TITLES.items())
]


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(t).alias("text")) for i, t in PLANTED))))
    return licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text").union(planted), licenses.known_licenses(spark))


def _values(rows: list[tuple]) -> str:
    said = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


OP7_SQL = f"""
WITH t(license_id, text) AS ({_values(licenses.known_texts())}),
k AS (SELECT known, min(license_id) AS license_id FROM (SELECT sha256({licenses.canonical_sql("text")}) AS known, license_id FROM t
  UNION ALL SELECT known, license_id FROM ({_values([(v, k) for k, v in licenses.DIGESTS.items()])}) AS g(known, license_id)) GROUP BY known),
a AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM ({_values(PLANTED)}) AS p(doc_id, text)),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM a)
  JOIN k ON known = sha256({licenses.canonical_sql("line")}) WHERE contains(lower(line), '{licenses.NOTICE_MARK}') GROUP BY doc_id),
d AS (SELECT doc_id, sha256({licenses.canonical_sql("text")}) AS digest FROM a)
SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices FROM d LEFT JOIN k ON digest = known LEFT JOIN n USING (doc_id)
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.train(docs))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_ids.token_ids(_table(spark, sf_dir, "documents"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(*centroids.cluster(_table(spark, sf_dir, "embeddings")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", relabelled), F.col("vec_id") % 100 == 0)


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor({} * CAST(x AS DOUBLE)) AS BIGINT))".format


def _op12_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    nearest = "SELECT r, vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, c{0}) GROUP BY ALL"
    # floors of quotients by whole numbers only
    mean = "SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{0}) GROUP BY ALL) GROUP BY j"
    steps = [f"a{r} AS ({nearest.format(r)}), m{r} AS ({mean.format(r)}), c{r + 1} AS (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))" for r in range(rounds)]
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, {_WHOLE(64)} AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM e WHERE vec_id IS NOT NULL QUALIFY j < {k}),
{", ".join(steps)}, z AS ({nearest.format(rounds)})
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} USING (j)
"""


OP12_SQL = _op12_sql()

OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE(256)} AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_FINITE}),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.r, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM a JOIN v c ON a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same QUALIFY positive_rank <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, CAST(positive_rank AS INTEGER) AS positive_rank FROM n WHERE rank <= 10
"""

OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(list_slice(ws, i, i + 49), ' ')) AS low FROM p),
r AS (SELECT doc_id, list(j) AS gone FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE low < doc_id) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, reach) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(reach) AS low FROM r GROUP BY id) ON id = w.doc_id
"""

QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_token_ids": op11_token_ids,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op4_mixing": OP4_SQL, "op10_jaccard_join": OP10_SQL, "op6_exact_top_k": OP6_SQL, "op7_license_scan": OP7_SQL, "op12_centroid_clustering": OP12_SQL, "op13_hard_negatives": OP13_SQL}
