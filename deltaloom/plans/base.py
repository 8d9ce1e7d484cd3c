"""The oracle's views of the driver's tables, as DuckDB common table expressions."""

from __future__ import annotations

from deltaloom.sources.star import CONTROL, CUT_GENES, HELD, SPLIT, TRAIN, UNSEEN_TARGETS

_list = lambda x: "(" + ", ".join(f"'{v}'" for v in x) + ")"


def ensembl_sql(number: str) -> str:
    """The identifier of a nation as a gene."""
    return f"('ENSG' || lpad(CAST({number} AS VARCHAR), 11, '0'))"


VIEWS = f"""
obs AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '{SPLIT}' THEN '{TRAIN}' ELSE '{HELD}' END AS line,
  CASE WHEN c_nationkey = 0 THEN '{CONTROL}' ELSE {ensembl_sql("c_nationkey")} END AS target,
  c_mktsegment AS batch, o_orderpriority AS guide, o_orderkey AS cell FROM orders JOIN customer ON o_custkey = c_custkey),
raw AS (SELECT l_orderkey AS cell, {ensembl_sql("s_nationkey")} AS gene, sum(l_quantity) AS cnt FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
cells AS (SELECT obs.*, lib FROM obs JOIN (SELECT cell, sum(cnt) AS lib FROM raw GROUP BY cell) USING (cell)
  WHERE NOT (line = '{TRAIN}' AND target IN {_list(UNSEEN_TARGETS)})),
counts AS (SELECT cells.*, gene, cnt FROM cells JOIN raw USING (cell)
  WHERE {" AND ".join(f"NOT (line = '{line}' AND gene IN {_list(genes)})" for line, genes in CUT_GENES.items())}),
panel AS (SELECT DISTINCT line, gene FROM counts),
stats AS (SELECT line, target, batch, gene, sum(cnt) AS s_raw, sum(ln(1 + cnt * 1e4 / lib)) AS s_log FROM counts GROUP BY ALL),
strata AS (SELECT line, target, batch, count(*) AS n FROM cells GROUP BY ALL),
ctl AS (SELECT s.line, s.batch, p.gene, s.n AS n_control, coalesce(t.s_raw, 0) / s.n AS m_raw, coalesce(t.s_log, 0) / s.n AS m_log
  FROM strata s JOIN panel p ON s.line = p.line
  LEFT JOIN stats t ON t.line = s.line AND t.batch = s.batch AND t.gene = p.gene AND t.target = '{CONTROL}' WHERE s.target = '{CONTROL}'),
matched AS (SELECT s.line, s.target, c.gene, sum(s.n * m_raw) / sum(s.n) AS c_raw, sum(s.n * m_log) / sum(s.n) AS c_log
  FROM strata s JOIN ctl c ON s.line = c.line AND s.batch = c.batch WHERE s.target <> '{CONTROL}' GROUP BY ALL),
tn AS (SELECT line, target, sum(n) AS n_cells, count(*) AS n_batches FROM strata WHERE target <> '{CONTROL}' GROUP BY ALL),
ts AS (SELECT line, target, gene, sum(s_raw) AS s_raw, sum(s_log) AS s_log FROM stats GROUP BY ALL),
guides AS (SELECT line, target, count(DISTINCT guide) AS n_guides FROM cells GROUP BY ALL),
delta AS (SELECT tn.line, tn.target, p.gene, coalesce(ts.s_raw, 0) / n_cells AS mean_raw, c_raw, coalesce(ts.s_raw, 0) / n_cells - c_raw AS delta_raw,
    coalesce(ts.s_log, 0) / n_cells AS mean_log, c_log, coalesce(ts.s_log, 0) / n_cells - c_log AS delta_log, n_cells, n_guides, n_batches
  FROM tn JOIN panel p ON tn.line = p.line LEFT JOIN ts ON ts.line = tn.line AND ts.target = tn.target AND ts.gene = p.gene
  JOIN matched m ON m.line = tn.line AND m.target = tn.target AND m.gene = p.gene JOIN guides g ON g.line = tn.line AND g.target = tn.target),
baseline AS (SELECT line, gene, sum(n_control * m_raw) / sum(n_control) AS mean_raw, sum(n_control * m_log) / sum(n_control) AS mean_log FROM ctl GROUP BY ALL),
held AS (SELECT DISTINCT target FROM delta WHERE line = '{HELD}'),
seen AS (SELECT DISTINCT target FROM delta WHERE line = '{TRAIN}'),
cohort AS (SELECT target, CASE WHEN target IN (SELECT target FROM seen) THEN 'shared' ELSE 'unseen' END AS cohort FROM held),
axis AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS gene_idx FROM
  (SELECT gene FROM panel WHERE line = '{TRAIN}' INTERSECT SELECT gene FROM panel WHERE line = '{HELD}')),
ytrain AS (SELECT target, gene, delta_log AS y FROM delta JOIN axis USING (gene) WHERE line = '{TRAIN}'),
yheld AS (SELECT target, gene, delta_log AS y FROM delta JOIN axis USING (gene) WHERE line = '{HELD}'),
xtrain AS (SELECT s.target, b.mean_log AS x FROM seen s LEFT JOIN (SELECT * FROM baseline WHERE line = '{TRAIN}') b ON b.gene = s.target),
xheld AS (SELECT s.target, b.mean_log AS x FROM held s LEFT JOIN (SELECT * FROM baseline WHERE line = '{HELD}') b ON b.gene = s.target),
med AS (SELECT coalesce(quantile_cont(x, 0.5), 0) AS median FROM xtrain),
scale AS (SELECT median, avg(coalesce(x, median)) AS mean, coalesce(nullif(stddev_pop(coalesce(x, median)), 0), 1) AS sd FROM xtrain, med GROUP BY median),
ztrain AS (SELECT target, (coalesce(x, median) - mean) / sd AS z FROM xtrain, scale),
zheld AS (SELECT target, (coalesce(x, median) - mean) / sd AS z FROM xheld, scale),
tmean AS (SELECT gene, avg(y) AS p FROM ytrain GROUP BY gene),
items AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
pairs AS (SELECT a.s AS protein1, b.s AS protein2, count(*) AS n FROM items a JOIN items b ON a.o = b.o AND a.s <> b.s GROUP BY ALL),
links AS (SELECT protein1, protein2, CAST(floor(n * 1000.0 / (SELECT max(n) FROM pairs)) AS INTEGER) AS score FROM pairs),
named AS (SELECT s_suppkey AS protein, {ensembl_sql("s_nationkey")} AS gene FROM supplier UNION ALL
  SELECT s_suppkey, {ensembl_sql("(s_nationkey + 1) % 25")} FROM supplier WHERE s_suppkey % 17 = 0 UNION ALL
  SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, 'ENSG' || s_suppkey FROM supplier),
alias AS (SELECT * FROM named WHERE gene LIKE 'ENSG%' AND length(gene) = 15),
wanted AS (SELECT DISTINCT gene FROM panel),
pgene AS (SELECT protein, min(gene) AS gene FROM alias GROUP BY protein HAVING count(DISTINCT gene) = 1 AND min(gene) IN (SELECT gene FROM wanted)),
edges AS (SELECT least(a.gene, b.gene) AS src, greatest(a.gene, b.gene) AS dst, max(CAST(score / 1000.0 AS FLOAT)) AS w
  FROM links JOIN pgene a ON protein1 = a.protein JOIN pgene b ON protein2 = b.protein WHERE score >= 400 AND a.gene <> b.gene GROUP BY ALL),
both_ways AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges),
ident AS (SELECT user_id || '-' || (event_id % 97) AS barcode, event_type AS guide, CASE WHEN event_id % 5 = 0 THEN 'false' ELSE 'True' END AS coverage,
  CASE WHEN event_id % 7 = 0 THEN '2' ELSE '1.0' END AS cells FROM events),
matrix AS (SELECT (doc_id % 150) || '-' || (doc_id % 97) AS barcode FROM documents)
"""


def oracle(body: str) -> str:
    """body over the views; it may begin with its own WITH."""
    return f"WITH {VIEWS}, {body[5:]}" if body.startswith("WITH ") else f"WITH {VIEWS}\n{body}"
