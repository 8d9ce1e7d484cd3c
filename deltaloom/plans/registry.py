"""Named queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.functions.expr import MISSING, cell_name, damped, finite_or_null, is_padded, log_norm, outside_mass, r6, target_id
from deltaloom.operators import audit, calibration, cohorts, families, generate, graph, lowrank, metrics, numbering, pseudobulk, splits, transfer, validate
from deltaloom.plans.base import ensembl_sql, oracle
from deltaloom.plans.fingerprint import digests
from deltaloom.session import dealt, materialize, reserve, small, tasks_of
from deltaloom.sources import blocks, star
from deltaloom.sources.star import CONTROL, HELD, TRAIN, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ALPHAS = [0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]
FOLDS, SEED, RANK, ALPHA, THRESHOLD = 5, 2026, 16, 10.0, 400
PARTS = {"fit": 12, "calibration": 4, "audit": 4}
#: Rows of an axis, about.
AXIS = 20_000
#: Sizes of the studies: ranks and settings of models, cells a panel and a target, iterations and seeds of calibration.
FULL, RIDGE_ALPHAS, LEAVES = 1000, (1.0, 100.0, 1000.0), (7, 15)
TREES = {"leaves": 7, "rounds": 60, "rate": 0.05, "least": 2}
REPLICATES, DEPTH, CELLS, DONORS = 40, 2000, 128, 12
ITERATIONS, MC_SEED, SEEDS = (0, 8, 16), 71001, [72001, 72002, 72003]


def query(sql: str | None = None, whole: bool = False) -> Callable[[Query], Query]:
    """whole: sql has its views already."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if whole else oracle(sql)
        return f

    return add


class Study:
    """The inputs that queries share, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, written: bool = False) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.data = star.cells(spark, sf_dir, written)
        self.cells, self.counts = self.data.cells, self.data.counts

    @cached_property
    def sums(self) -> DataFrame:
        # read several times below: one written table instead of one scan for each
        return materialize(pseudobulk.sufficient(self.data.rows), "sums")

    def deltas(self) -> DataFrame:
        return materialize(pseudobulk.matched_delta_of(self.sums, CONTROL), "delta")

    def baseline(self) -> DataFrame:
        stats, groups, genes, _ = pseudobulk.parts_of(self.sums)
        return pseudobulk.control_baseline(stats, groups, genes, CONTROL)

    def transfer(self) -> Transfer:
        return Transfer(self)


class Transfer:
    """Training and held-out responses on common genes, and the basal feature of their targets; each is made when it is first asked for."""

    def __init__(self, study: Study) -> None:
        self.study = study

    @cached_property
    def delta(self) -> DataFrame:
        return self.study.deltas()

    @cached_property
    def baseline(self) -> DataFrame:
        return materialize(self.study.baseline(), "baseline")

    @cached_property
    def axis(self) -> DataFrame:
        return materialize(cohorts.common_axis(self.delta, TRAIN, HELD), "axis", AXIS)

    @cached_property
    def y(self) -> DataFrame:
        return materialize(self.delta.join(small(self.axis), "gene").select("line", "target", "gene", F.col("delta_log").alias("y")), "y")

    @property
    def train(self) -> DataFrame:
        return self.y.where(F.col("line") == TRAIN).drop("line")

    @property
    def held(self) -> DataFrame:
        return self.y.where(F.col("line") == HELD).drop("line")

    @cached_property
    def targets(self) -> DataFrame:
        return materialize(self._of(HELD).select("target").distinct(), "targets", AXIS)

    @property
    def cohorts(self) -> DataFrame:
        return cohorts.cohorts(self.delta, TRAIN, HELD)

    @cached_property
    def x_train(self) -> DataFrame:
        return materialize(transfer.basal(self._of(TRAIN), self._base(TRAIN)), "basal", AXIS)

    @cached_property
    def x_held(self) -> DataFrame:
        return materialize(transfer.basal(self.targets, self._base(HELD)), "basal", AXIS)

    def _of(self, line: str) -> DataFrame:
        return self.delta.where(F.col("line") == line)

    def _base(self, line: str) -> DataFrame:
        return self.baseline.where(F.col("line") == line)

    def scaled(self) -> tuple[DataFrame, DataFrame]:
        scale = transfer.fit_scale(self.x_train)
        return transfer.apply_scale(self.x_train, scale), transfer.apply_scale(self.x_held, scale)

    def predictions(self, alpha: float = ALPHA) -> DataFrame:
        z_train, z_held = self.scaled()
        ridge = transfer.ridge_predict(z_held, transfer.ridge_fit(z_train, self.train, alpha))
        genes = self.train.select("gene").distinct()
        out = transfer.zero_delta(self.targets, genes)
        for p in (transfer.training_mean(self.train, self.targets), transfer.nearest_line(self.train, self.targets), ridge):
            out = out.unionByName(p)
        return out


# --- matched-control aggregation -------------------------------------------------------------


def _delta(s: Study) -> DataFrame:
    d = pseudobulk.matched_delta_of(s.sums, CONTROL)
    return d.select("line", "target", "gene", *(r6(c).alias(c) for c in ("mean_raw", "c_raw", "delta_raw", "mean_log", "c_log", "delta_log")), "n_cells", "n_guides", "n_batches")


@query("""SELECT line, target, gene, round(mean_raw, 6) AS mean_raw, round(c_raw, 6) AS c_raw, round(delta_raw, 6) + 0.0 AS delta_raw, round(mean_log, 6) AS mean_log,
  round(c_log, 6) AS c_log, round(delta_log, 6) + 0.0 AS delta_log, CAST(n_cells AS BIGINT) AS n_cells, n_guides, n_batches FROM delta""")
def matched_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(Study(spark, sf_dir))


@query(f"""SELECT gene AS output_gene_id, g.n_name AS output_gene, round(mean_raw, 6) AS mean_raw_count, round(c_raw, 6) AS matched_control_raw_count,
  round(delta_raw, 6) + 0.0 AS delta_raw_count, round(mean_log, 6) AS mean_log1p_cp10k, round(c_log, 6) AS matched_control_log1p_cp10k, round(delta_log, 6) + 0.0 AS delta_log1p_cp10k,
  'star' AS dataset, line, 'orders' AS assay_type, CASE WHEN line = '{TRAIN}' THEN 'train' ELSE 'held_out' END AS role, target AS target_gene_id, t.n_name AS target_gene,
  CAST(n_cells AS BIGINT) AS n_cells, n_guides AS n_guide_pairs, n_batches AS n_matched_gem_groups
  FROM delta JOIN nation g ON {ensembl_sql("g.n_nationkey")} = gene JOIN nation t ON {ensembl_sql("t.n_nationkey")} = target""")
def tidy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(star.gene_of("n_nationkey").alias("id"), "n_name")
    d = _delta(Study(spark, sf_dir))
    d = d.join(names.select(F.col("id").alias("gene"), F.col("n_name").alias("output_gene")), "gene").join(names.select(F.col("id").alias("target"), F.col("n_name").alias("target_gene")), "target")
    role = F.when(F.col("line") == TRAIN, "train").otherwise("held_out")
    return d.select(
        F.col("gene").alias("output_gene_id"), "output_gene", F.col("mean_raw").alias("mean_raw_count"), F.col("c_raw").alias("matched_control_raw_count"), F.col("delta_raw").alias("delta_raw_count"),
        F.col("mean_log").alias("mean_log1p_cp10k"), F.col("c_log").alias("matched_control_log1p_cp10k"), F.col("delta_log").alias("delta_log1p_cp10k"), F.lit("star").alias("dataset"), "line",
        F.lit("orders").alias("assay_type"), role.alias("role"), F.col("target").alias("target_gene_id"), "target_gene", "n_cells", F.col("n_guides").alias("n_guide_pairs"), F.col("n_batches").alias("n_matched_gem_groups"),
    )


@query("SELECT line, gene, round(mean_raw, 6) AS mean_raw, round(mean_log, 6) AS mean_log FROM baseline")
def control_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).baseline().select("line", "gene", r6("mean_raw").alias("mean_raw"), r6("mean_log").alias("mean_log"))


@query(f"""SELECT s.line, s.target, s.batch, s.n AS n_target_cells, coalesce(c.n, 0) AS n_control_cells FROM strata s
  LEFT JOIN (SELECT * FROM strata WHERE target = '{CONTROL}') c ON c.line = s.line AND c.batch = s.batch WHERE s.target <> '{CONTROL}'""")
def matched_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudobulk.matched_strata(pseudobulk.strata(Study(spark, sf_dir).cells), CONTROL)


@query("SELECT line, target, batch, gene, round(s_raw, 6) AS s_raw, round(s_log, 6) AS s_log FROM stats")
def group_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudobulk.group_sums(Study(spark, sf_dir).counts).withColumns({c: r6(c) for c in ("s_raw", "s_log")})


@query("""SELECT line, count(*) AS n_cells, min(lib) AS min_library, max(lib) AS max_library, sum(panel) AS panel_total, min(lo) AS min_count, max(hi) AS max_count, bool_and(coalesce(whole, true)) AS whole,
  round(min(panel / lib), 6) AS min_retained, bool_and(panel <= lib) AS within_library FROM (
    SELECT c.line, c.lib, coalesce(p.panel, 0) AS panel, lo, hi, whole FROM cells c LEFT JOIN (
      SELECT cell, sum(cnt) AS panel, min(cnt) AS lo, max(cnt) AS hi, bool_and(cnt = floor(cnt)) AS whole FROM counts GROUP BY cell) p ON p.cell = c.cell) GROUP BY line""")
def aggregation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    return pseudobulk.quality_report(s.counts, s.cells).withColumn("min_retained", r6("min_retained"))


@query("SELECT line, target, CAST(sum(n) AS BIGINT) AS n_cells, count(*) AS n_batches, n_guides FROM strata JOIN guides USING (line, target) GROUP BY ALL")
def target_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups, _, guides = pseudobulk.parts_of(Study(spark, sf_dir).sums)
    return groups.groupBy("line", "target").agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_batches")).join(guides, ["line", "target"])


# --- cohorts, axes, sets ---------------------------------------------------------------------


def _targets(s: Study) -> DataFrame:
    return s.cells.where(F.col("target") != CONTROL).select("line", "target").distinct()


@query("SELECT target, cohort FROM cohort")
def target_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohorts(_targets(Study(spark, sf_dir)), TRAIN, HELD)


@query("SELECT gene, CAST(gene_idx AS INTEGER) AS gene_idx FROM axis")
def common_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.common_axis(pseudobulk.panel(Study(spark, sf_dir).counts), TRAIN, HELD)


@query("SELECT target FROM held UNION SELECT target FROM seen")
def union_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(Study(spark, sf_dir))
    return cohorts.union_axis(t.where(F.col("line") == TRAIN), t.where(F.col("line") == HELD), "target")


@query("SELECT target, target IN (SELECT target FROM seen) AS is_member FROM held")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(Study(spark, sf_dir))
    return cohorts.membership(t.where(F.col("line") == HELD).select("target"), t.where(F.col("line") == TRAIN), "target")


#: Customers' nations as targets some of which have no identifier.
_NAMED = """SELECT CASE WHEN n_nationkey % 8 = 7 THEN 'NaN' WHEN n_nationkey % 8 = 3 THEN '' WHEN n_nationkey = 5 THEN 'other-5' WHEN n_nationkey = 6 THEN NULL
  ELSE 'ENSG' || lpad(CAST(n_nationkey AS VARCHAR), 11, '0') END AS identifier, n_name AS symbol, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("n_nationkey")
    identifier = F.when(k % 8 == 7, "NaN").when(k % 8 == 3, "").when(k == 5, "other-5").when(k == 6, None).otherwise(F.concat(F.lit("ENSG"), F.lpad(k.cast("string"), 11, "0")))
    return c.select(identifier.alias("identifier"), F.col("n_name").alias("symbol"), "c_custkey")


_MISSING = "coalesce(lower(identifier) IN (" + ", ".join(f"'{m}'" for m in MISSING) + "), true)"


@query(f"SELECT 'UNMAPPED:' || symbol AS target_id, symbol, count(*) AS n_cells FROM ({_NAMED}) WHERE {_MISSING} GROUP BY ALL")
def unmapped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.unmapped(_named(spark, sf_dir))


@query(f"SELECT CASE WHEN {_MISSING} THEN 'UNMAPPED:' || symbol ELSE identifier END AS target_id, count(*) AS n FROM ({_NAMED}) GROUP BY ALL")
def target_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).groupBy(target_id("identifier", "symbol").alias("target_id")).agg(F.count("*").alias("n"))


@query(f"SELECT identifier, count(*) AS n FROM ({_NAMED}) WHERE identifier LIKE 'ENSG%' AND length(identifier) = 15 GROUP BY ALL")
def mapped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.functions.expr import is_mapped

    return _named(spark, sf_dir).where(is_mapped("identifier")).groupBy("identifier").agg(F.count("*").alias("n"))


# --- validation ------------------------------------------------------------------------------


@query(f"SELECT DISTINCT identifier, symbol, 'kind' AS reason FROM ({_NAMED}) WHERE NOT {_MISSING} AND NOT identifier LIKE 'ENSG%'")
def bad_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.bad_identifiers(_named(spark, sf_dir))


_SPOILT = "SELECT cell, gene, CASE WHEN cell % 101 = 0 THEN cnt + 0.5 WHEN cell % 103 = 0 THEN -cnt WHEN cell % 107 = 0 THEN NULL ELSE cnt END AS cnt, lib FROM counts"


def _spoilt(s: Study) -> DataFrame:
    """Counts some of which break the rules."""
    k = F.col("cell")
    return s.counts.select("cell", "gene", F.when(k % 101 == 0, F.col("cnt") + 0.5).when(k % 103 == 0, -F.col("cnt")).when(k % 107 == 0, None).otherwise(F.col("cnt")).alias("cnt"), "lib")


@query(f"""SELECT cell, gene, CASE WHEN cnt IS NULL THEN 'finite' WHEN cnt < 0 THEN 'negative' ELSE 'whole' END AS reason FROM ({_SPOILT}) WHERE cnt IS NULL OR cnt < 0 OR cnt <> floor(cnt)
  UNION ALL SELECT cell, NULL, 'total' FROM ({_SPOILT}) GROUP BY cell HAVING sum(cnt) > 250""")
def raw_count_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.bad_counts(_spoilt(Study(spark, sf_dir)), 250)


@query(f"SELECT cell, sum(cnt) AS panel, min(lib) AS lib FROM ({_SPOILT}) GROUP BY cell HAVING sum(cnt) > min(lib) + 0.01 OR NOT min(lib) > 0")
def library_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.above_library(_spoilt(Study(spark, sf_dir)), 0.01)


@query(f"SELECT line, batch, CAST(coalesce(sum(n) FILTER (target = '{CONTROL}'), 0) AS BIGINT) AS n_control FROM strata GROUP BY ALL HAVING coalesce(sum(n) FILTER (target = '{CONTROL}'), 0) < 60")
def control_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.too_few_controls(pseudobulk.strata(Study(spark, sf_dir).cells), CONTROL, 60)


_NAMES = "SELECT CASE WHEN p_partkey % 501 = 0 THEN NULL WHEN p_partkey % 499 = 0 THEN ' ' || p_brand WHEN p_partkey % 251 = 0 THEN 'control' ELSE p_brand || '/' || (p_partkey % 1900) END AS name FROM part"


@query(f"""WITH n AS ({_NAMES}) SELECT name, CASE WHEN name IS NULL THEN 'null' WHEN trim(name) <> name THEN 'padded' ELSE 'control' END AS reason FROM n
  WHERE name IS NULL OR trim(name) <> name OR name = 'control' UNION ALL SELECT name, 'repeated' FROM n WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1
  UNION ALL SELECT CAST(count(*) AS VARCHAR), 'size' FROM n HAVING count(*) <> 7""")
def reference_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 501 == 0, None).when(k % 499 == 0, F.concat(F.lit(" "), "p_brand")).when(k % 251 == 0, "control").otherwise(F.concat("p_brand", F.lit("/"), (k % 1900).cast("string")))
    return validate.bad_names(table(spark, sf_dir, "part").select(name.alias("name")), "name", 7, "control")


@query(f"SELECT CAST(gene_idx AS INTEGER) AS gene_idx, axis.gene AS found, e.gene AS expected FROM axis FULL JOIN (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS gene_idx FROM panel WHERE line = '{TRAIN}') e USING (gene_idx) WHERE axis.gene IS DISTINCT FROM e.gene")
def axis_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pseudobulk.panel(Study(spark, sf_dir).counts)
    return validate.axis_difference(cohorts.common_axis(p, TRAIN, HELD), cohorts.with_index(p.where(F.col("line") == TRAIN), "gene", "gene_idx"), "gene", "gene_idx")


@query(f"""SELECT line, target, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN w IS NULL THEN 'unknown' ELSE 'size' END AS reason FROM
  (SELECT line, target, count(*) AS n FROM cells GROUP BY ALL) FULL JOIN (SELECT l.line, t.target, 1 AS w FROM (SELECT DISTINCT line FROM cells) l, (SELECT target FROM held) t) USING (line, target)
  WHERE n IS NULL OR w IS NULL OR n <> 300""")
def panel_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    t = _targets(s)
    expected = t.select("line").distinct().join(t.where(F.col("line") == HELD).select("target"), how="cross")
    return validate.panel_difference(s.cells, expected, ["line", "target"], 300)


@query("SELECT batch AS context, n_cells, n_others FROM (SELECT batch, count(*) AS n_cells, count(*) FILTER (target <> 'non-targeting') AS n_others, count(DISTINCT batch) AS c, sum(lib) AS t FROM cells GROUP BY batch) WHERE n_others > 0 OR t <= 0 OR c <> 1")
def control_file_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Study(spark, sf_dir).cells.select(F.col("batch").alias("file"), F.col("batch").alias("context"), "target", "lib")
    return validate.bad_controls(cells, CONTROL, "file").select(F.col("file").alias("context"), "n_cells", "n_others")


@query("SELECT target, gene, CAST(n AS BIGINT) AS n FROM (SELECT t.target, axis.gene, coalesce(d.n, 0) AS n FROM (SELECT target FROM held) t CROSS JOIN axis LEFT JOIN (SELECT target, gene, count(*) AS n FROM delta GROUP BY ALL) d ON d.target = t.target AND d.gene = axis.gene) WHERE n <> 1")
def matrix_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lines in one table: shared targets occur twice."""
    s = Study(spark, sf_dir)
    d = s.deltas()
    return transfer.matrix_problems(d, d.where(F.col("line") == HELD).select("target").distinct(), cohorts.common_axis(d, TRAIN, HELD))


# --- transfer --------------------------------------------------------------------------------


@query("SELECT target, round(x, 6) AS x, CAST(x IS NULL AS INTEGER) AS is_missing FROM xtrain")
def basal_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.functions.expr import missing_flag

    t = Study(spark, sf_dir).transfer()
    return t.x_train.select("target", r6("x").alias("x"), missing_flag("x").alias("is_missing"))


@query("SELECT round(median, 6) AS median, round(mean, 6) AS mean, round(sd, 6) AS scale FROM scale")
def standardizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.fit_scale(Study(spark, sf_dir).transfer().x_train).select(*(r6(c).alias(c) for c in ("median", "mean", "scale")))


@query("SELECT target, round(z, 6) + 0.0 AS z FROM zheld")
def standardized_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).transfer().scaled()[1].select("target", r6("z").alias("z"))


_RIDGE = f"SELECT gene, avg(y) AS b0, sum(z * y) / (sum(z * z) + {ALPHA}) AS b1 FROM ytrain JOIN ztrain USING (target) GROUP BY gene"


@query(f"SELECT gene, round(b0, 6) + 0.0 AS b0, round(b1, 6) + 0.0 AS b1 FROM ({_RIDGE})")
def ridge_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Study(spark, sf_dir).transfer()
    return transfer.ridge_fit(t.scaled()[0], t.train, ALPHA).select("gene", r6("b0").alias("b0"), r6("b1").alias("b1"))


_PREDICTED = f"""SELECT 'zero_delta' AS model, target, gene, 0.0::DOUBLE AS p FROM held, axis
  UNION ALL SELECT 'training_mean', target, gene, p FROM held, tmean
  UNION ALL SELECT 'nearest_line', h.target, m.gene, coalesce(y, p) FROM held h CROSS JOIN tmean m LEFT JOIN ytrain USING (target, gene)
  UNION ALL SELECT 'ridge', target, gene, b0 + z * b1 FROM zheld, ({_RIDGE})"""


@query(f"SELECT model, target, gene, round(p, 6) + 0.0 AS p FROM ({_PREDICTED})")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).transfer().predictions().withColumn("p", r6("p"))


_CENTRED = f"""SELECT model, target, p - y AS e, y - avg(y) OVER w AS dy, p - avg(p) OVER w AS dp FROM ({_PREDICTED}) JOIN yheld USING (target, gene) WINDOW w AS (PARTITION BY model, target)"""
_ERRORS = f"""SELECT model, target, sum(e * e) AS sse, sum(abs(e)) AS sae, count(*) AS n,
  CASE WHEN sqrt(sum(dy * dy)) * sqrt(sum(dp * dp)) > 1e-15 THEN sum(dy * dp) / (sqrt(sum(dy * dy)) * sqrt(sum(dp * dp))) END AS pearson FROM ({_CENTRED}) GROUP BY ALL"""


@query(f"SELECT model, target, round(sse, 6) AS sse, round(sae, 6) AS sae, n, round(pearson, 6) + 0.0 AS pearson FROM ({_ERRORS})")
def target_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Study(spark, sf_dir).transfer()
    return metrics.target_errors(t.held, t.predictions()).withColumns({c: r6(c) for c in ("sse", "sae", "pearson")})


@query(f"""WITH m AS (SELECT model, CASE WHEN grouping(cohort) = 1 THEN 'all' ELSE cohort END AS cohort, sum(sse) / sum(n) AS mse, sum(sae) / sum(n) AS mae, avg(pearson) AS mean_target_pearson,
    count(pearson) AS pearson_defined_targets, count(*) AS n_targets, max(n) AS n_output_genes FROM ({_ERRORS}) JOIN cohort USING (target) GROUP BY GROUPING SETS ((model, cohort), (model)))
  SELECT model, cohort, round(mse, 6) AS mse, round(mae, 6) AS mae, round(mean_target_pearson, 6) + 0.0 AS mean_target_pearson, pearson_defined_targets, n_targets, n_output_genes,
    round(mse / max(CASE WHEN model = 'zero_delta' THEN mse END) OVER (PARTITION BY cohort), 6) AS mse_relative_to_zero FROM m""")
def cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Study(spark, sf_dir).transfer()
    m = metrics.cohort_metrics(metrics.target_errors(t.held, t.predictions()), t.cohorts)
    return m.withColumns({c: r6(c) for c in ("mse", "mae", "mean_target_pearson", "mse_relative_to_zero")})


_FOLD = f"SELECT target, ntile({FOLDS}) OVER (ORDER BY sha256('{SEED}:' || target)) - 1 AS fold FROM seen"


@query(f"SELECT target, CAST(fold AS INTEGER) AS fold FROM ({_FOLD})")
def cross_validation_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(Study(spark, sf_dir)).where(F.col("line") == TRAIN)
    return transfer.folds(t, FOLDS, SEED)


_LOSS = f"""WITH fo AS ({_FOLD}), ids AS (SELECT DISTINCT fold AS f FROM fo),
  r AS (SELECT ids.f, fo.fold, x.target, x.x FROM xtrain x JOIN fo USING (target), ids),
  md AS (SELECT f, coalesce(quantile_cont(x, 0.5), 0) AS median FROM r WHERE fold <> f GROUP BY f),
  sc AS (SELECT f, median, avg(coalesce(x, median)) AS mean, coalesce(nullif(stddev_pop(coalesce(x, median)), 0), 1) AS sd FROM r JOIN md USING (f) WHERE fold <> f GROUP BY ALL),
  d AS (SELECT r.f, r.fold, target, (coalesce(x, median) - mean) / sd AS z, gene, y FROM r JOIN sc USING (f) JOIN ytrain USING (target)),
  co AS (SELECT f, gene, avg(y) AS b0, sum(z * y) AS zy, sum(z * z) AS zz FROM d WHERE fold <> f GROUP BY ALL)
  SELECT alpha, sum(power(y - b0 - z * zy / (zz + alpha), 2)) / count(*) AS mse FROM d JOIN co USING (f, gene), (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha) WHERE fold = f GROUP BY alpha"""


def _losses(t: Transfer) -> DataFrame:
    parts = transfer.folds(t.x_train, FOLDS, SEED)
    return transfer.alpha_losses(t.x_train, t.train, parts, ALPHAS)


@query(f"SELECT alpha, round(mse, 8) AS mse FROM ({_LOSS})")
def alpha_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(Study(spark, sf_dir).transfer()).withColumn("mse", F.round("mse", 8))


@query(f"SELECT alpha, round(mse, 8) AS mse FROM ({_LOSS}) ORDER BY mse, alpha DESC LIMIT 1")
def best_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.best_alpha(_losses(Study(spark, sf_dir).transfer())).withColumn("mse", F.round("mse", 8))


@query("""WITH l AS (SELECT p_type AS family, p_brand AS name, round(avg(p_retailprice), 1) AS mse FROM part GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mse, name) AS r FROM l)
  SELECT family, name, mse, CAST(row_number() OVER (ORDER BY mse, name) AS INTEGER) AS place FROM b WHERE r = 1""")
def best_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as families of settings and brands as settings."""
    losses = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family"), F.col("p_brand").alias("name")).agg(F.round(F.avg("p_retailprice"), 1).alias("mse"))
    return transfer.best_per_family(losses)


# --- graph -----------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as proteins with their nations as genes, by identifier and by other names; two in one order are linked, by how often against the most.

    A link is listed once, with the smaller protein first. wanted: the genes of the counts, where they are known already.
    """
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("protein"), "s_nationkey", "s_name", ((F.col("s_nationkey") + 1) % 25).alias("next"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    more = F.when(F.col("protein") % 17 == 0, star.gene_of("next"))
    every = F.array(star.gene_of("s_nationkey"), more, F.col("n_name"), F.col("s_name"), F.concat(F.lit("ENSG"), F.col("protein").cast("string")))
    aliases = sup.join(names, "s_nationkey").select("protein", F.explode(F.array_compact(every)).alias("gene"))
    lines = table(spark, sf_dir, "lineitem")
    items = dealt(lines.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")), tasks_of(lines), "o")
    own = items.groupBy("o").agg(F.collect_set("s").alias("s"))  # the few items of an order
    pairs = own.select(F.explode("s").alias("protein1"), "s").select("protein1", F.explode("s").alias("protein2")).where("protein1 < protein2")
    pairs = pairs.groupBy("protein1", "protein2").agg(F.count("*").alias("n"))
    most = pairs.agg(F.max("n").alias("most"))
    links = pairs.join(F.broadcast(most), how="cross").select("protein1", "protein2", F.floor(F.col("n") * 1000.0 / F.col("most")).cast("int").alias("score"))
    if wanted is None:
        wanted = star.cells(spark, sf_dir).counts.select("gene").distinct()
    return aliases, links, wanted


@query("SELECT src, dst, round(w::DOUBLE, 6) AS w FROM edges")
def gene_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, links, w = _graph(spark, sf_dir)
    return graph.build_graph(a, links, w, THRESHOLD).withColumn("w", r6(F.col("w").cast("double")))


@query("""SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM wanted WHERE gene NOT IN (SELECT src FROM both_ways)) AS n_isolated,
  (SELECT count(DISTINCT gene) FROM pgene) AS n_mapped, (SELECT count(*) FROM (SELECT protein FROM alias GROUP BY protein HAVING count(DISTINCT gene) > 1)) AS n_ambiguous""")
def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, links, w = _graph(spark, sf_dir)
    return graph.graph_report(graph.build_graph(a, links, w, THRESHOLD), a, w)


@query("SELECT src, dst, round(w::DOUBLE, 6) AS w FROM edges WHERE src IN (SELECT gene FROM axis) AND dst IN (SELECT gene FROM axis)")
def induced_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, links, w = _graph(spark, sf_dir)
    some = cohorts.common_axis(pseudobulk.panel(star.cells(spark, sf_dir).counts), TRAIN, HELD)
    return graph.induced(graph.build_graph(a, links, w, THRESHOLD), some).withColumn("w", r6(F.col("w").cast("double")))


_SCORES = "SELECT target AS gene, 0 AS k, avg(y) AS score FROM ytrain GROUP BY target UNION ALL SELECT target, 1, avg(abs(y)) FROM ytrain GROUP BY target"


@query(f"""WITH sc AS ({_SCORES}), q AS (SELECT target AS gene, x FROM xheld),
  pr AS (SELECT src AS gene, k, count(*) AS support, sum(w::DOUBLE * score) / nullif(sum(w::DOUBLE), 0) AS prior FROM both_ways JOIN sc ON dst = sc.gene WHERE src <> dst GROUP BY ALL)
  SELECT q.gene, ks.k, round(x, 6) AS basal, CAST(x IS NULL AS INTEGER) AS is_missing, round(ln(1 + coalesce(support, 0)), 6) AS log_support, round(coalesce(prior, 0), 6) + 0.0 AS prior
  FROM q CROSS JOIN (SELECT DISTINCT k FROM sc) ks LEFT JOIN pr ON pr.gene = q.gene AND pr.k = ks.k""")
def neighbour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Study(spark, sf_dir).transfer()
    a, links, w = _graph(spark, sf_dir)
    return _features(t, graph.build_graph(a, links, w, THRESHOLD).withColumn("w", F.col("w").cast("double")), t.x_held).withColumns({c: r6(c) for c in ("basal", "log_support", "prior")})


def _features(t: Transfer, edges: DataFrame, x: DataFrame) -> DataFrame:
    scores = t.train.groupBy(F.col("target").alias("gene")).agg(F.avg("y").alias("a"), F.avg(F.abs("y")).alias("b"))
    scores = scores.select("gene", F.inline(F.array(F.struct(F.lit(0).alias("k"), F.col("a").alias("score")), F.struct(F.lit(1).alias("k"), F.col("b").alias("score")))))
    return graph.neighbour_features(edges, x.select(F.col("target").alias("gene"), "x"), scores)


#: Scores that SQL has too: the responses on the first genes of the axis, a component each.
_WRITTEN = f"SELECT target AS gene, gene_idx AS k, y AS score FROM ytrain JOIN axis USING (gene) WHERE gene_idx < {RANK}"
_LONG = """SELECT q.gene, i, CASE i WHEN 0 THEN x WHEN 1 THEN CAST(x IS NULL AS DOUBLE) WHEN 2 THEN ln(1 + coalesce(support, 0)) ELSE coalesce(prior, 0) END AS v
  FROM (SELECT target AS gene, x FROM {x}) q CROSS JOIN (SELECT unnest(range({n})) AS i)
  LEFT JOIN (SELECT gene, any_value(support) AS support FROM pr GROUP BY gene) USING (gene) LEFT JOIN (SELECT gene, k + 3 AS i, prior FROM pr) p USING (gene, i)"""


def _near_sql(n: str) -> str:
    """Common table expressions of features in rows, n of a target; those beyond the components there are have no prior, so 0."""
    return f"""sc AS ({_WRITTEN}), pr AS (SELECT src AS gene, k, count(*) AS support, sum(w::DOUBLE * score) / nullif(sum(w::DOUBLE), 0) AS prior
  FROM both_ways JOIN sc ON dst = sc.gene WHERE src <> dst GROUP BY ALL), ftrain AS ({_LONG.format(x="xtrain", n=n)}), fheld AS ({_LONG.format(x="xheld", n=n)})"""


def _maker_inputs(spark: SparkSession, sf_dir: str) -> tuple[Transfer, families.Maker, families.Maker]:
    """Responses, and the makers of training and of held-out targets' features."""
    t = Study(spark, sf_dir).transfer()
    a, links, w = _graph(spark, sf_dir, t.study.sums.where("gene is not null").select("gene").distinct())
    edges = materialize(graph.build_graph(a, links, w, THRESHOLD).withColumn("w", F.col("w").cast("double")), "edges")
    return t, families.feature_maker(edges, t.x_train), families.feature_maker(edges, t.x_held)


def _written_scores(t: Transfer, first: int) -> DataFrame:
    return materialize(t.train.join(small(t.axis.where(F.col("gene_idx") < first)), "gene").select("target", F.col("gene_idx").cast("int").alias("component"), F.col("y").alias("z")), "scores")


@query(f"WITH {_near_sql('(SELECT 3 + count(DISTINCT k) FROM sc)')} SELECT gene AS target, CAST(i AS INTEGER) AS i, round(v, 6) + 0.0 AS v FROM fheld")
def component_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of held-out targets, priors for each component among them, a row each."""
    t, _, held_of = _maker_inputs(spark, sf_dir)
    f = held_of(_written_scores(t, RANK))
    names = families.columns_of(families.GRAPH, f)
    return f.select("target", F.posexplode(F.array(*names)).alias("i", "v")).withColumn("v", r6("v"))


def _graph_ridge_sql() -> str:
    """Ridge on all features by Gauss and Jordan on a list of rows; its matrix is positive definite, so no row is exchanged. A feature that is 0 everywhere changes nothing."""
    p = 4 + RANK
    steps = [f"g{k + 1} AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = {k + 1} THEN v / r[{k + 1}] ELSE v - r[{k + 1}] * m[{k + 1}][j] / m[{k + 1}][{k + 1}] END)) AS m FROM g{k})" for k in range(p)]
    scaled = "SELECT gene, 0 AS i, 1.0::DOUBLE AS z FROM (SELECT DISTINCT gene FROM {0}) UNION ALL SELECT gene, i + 1, (coalesce(v, median) - mean) / sd FROM {0} JOIN st USING (i)"
    return f"""WITH {_near_sql(str(p - 1))},
      md AS (SELECT i, coalesce(quantile_cont(v, 0.5), 0) AS median FROM ftrain GROUP BY i),
      st AS (SELECT i, median, avg(coalesce(v, median)) AS mean, coalesce(nullif(stddev_pop(coalesce(v, median)), 0), 1) AS sd FROM ftrain JOIN md USING (i) GROUP BY ALL),
      zt AS ({scaled.format("ftrain")}), zh AS ({scaled.format("fheld")}),
      gram AS (SELECT a.i, list(g ORDER BY a.j) AS r FROM (SELECT x.i, y.i AS j, sum(x.z * y.z) + CASE WHEN x.i = y.i AND x.i > 0 THEN {ALPHA} ELSE 0 END AS g FROM zt x JOIN zt y USING (gene) GROUP BY x.i, y.i) a GROUP BY a.i),
      rhs AS (SELECT i, list(v ORDER BY gene) AS r FROM (SELECT i, t.gene, sum(z * y) AS v FROM zt JOIN ytrain t ON t.target = zt.gene GROUP BY ALL) GROUP BY i),
      g0 AS (SELECT list(list_concat(gram.r, rhs.r) ORDER BY i) AS m FROM gram JOIN rhs USING (i)), {", ".join(steps)},
      w AS (SELECT i - 1 AS i, gene, m[i][{p} + n] AS b FROM g{p}, (SELECT unnest(range(1, {p + 1})) AS i) u, (SELECT gene, row_number() OVER (ORDER BY gene) AS n FROM (SELECT DISTINCT gene FROM ytrain)) o)
      SELECT zh.gene AS target, w.gene, round(sum(z * b), 6) + 0.0 AS p FROM zh JOIN w USING (i) GROUP BY ALL"""


@query(_graph_ridge_sql())
def graph_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out responses by ridge on all features, from priors on written scores; every gene of the axis is a component to be fitted."""
    t, train_of, held_of = _maker_inputs(spark, sf_dir)
    near = _written_scores(t, RANK)
    every = _written_scores(t, AXIS)
    z = families.predicted_scores(every, train_of(near), held_of(near), [families.Setting("ridge", "ridge", families.GRAPH, ALPHA)])
    return z.join(small(t.axis), F.col("component") == F.col("gene_idx")).select("target", "gene", r6("z").alias("p"))


# --- splits, selections, profiles ------------------------------------------------------------


_CONTROLS = f"SELECT * FROM cells WHERE target = '{CONTROL}' AND line = '{TRAIN}'"


def _controls(s: Study) -> DataFrame:
    return s.cells.where((F.col("target") == CONTROL) & (F.col("line") == TRAIN))


@query(f"""SELECT batch, cell, CASE WHEN n <= 12 THEN 'fit' WHEN n <= 16 THEN 'calibration' ELSE 'audit' END AS part FROM
  (SELECT batch, cell, row_number() OVER (PARTITION BY batch ORDER BY sha256('{SEED}:' || cell)) AS n FROM ({_CONTROLS})) WHERE n <= 20""")
def control_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_controls(_controls(Study(spark, sf_dir)), PARTS, SEED)


@query(f"SELECT batch, count(*) AS n FROM ({_CONTROLS}) GROUP BY batch HAVING count(*) < 52")
def short_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.short_batches(_controls(Study(spark, sf_dir)), {"fit": 40, "audit": 12})


@query("SELECT target, cohort, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY sha256(CAST(target AS VARCHAR))) AS place FROM cohort) WHERE place <= 3")
def hash_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_top_k(cohorts.cohorts(_targets(Study(spark, sf_dir)), TRAIN, HELD), 3)


@query("SELECT target FROM cells WHERE line = 'B' AND target <> 'non-targeting' AND target IN (SELECT target FROM held) GROUP BY target HAVING count(*) >= 20")
def supported_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out targets with enough cells."""
    c = Study(spark, sf_dir).cells.where((F.col("line") == HELD) & (F.col("target") != CONTROL))
    return c.groupBy("target").agg(F.count("*").alias("n")).where("n >= 20").select("target")


@query(f"SELECT target, cell, CAST(place AS INTEGER) AS place FROM (SELECT target, cell, row_number() OVER (PARTITION BY target ORDER BY sha256('{SEED}:' || cell)) AS place FROM cells WHERE line = '{HELD}' AND target <> '{CONTROL}') WHERE place <= 8")
def target_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Study(spark, sf_dir).cells
    return splits.sample_per_target(c.where((F.col("line") == HELD) & (F.col("target") != CONTROL)), 8, SEED)


@query(f"SELECT cell, CASE WHEN n <= 40 THEN 'fit' ELSE 'score' END AS part FROM (SELECT cell, row_number() OVER (ORDER BY sha256('{SEED}:' || cell)) AS n FROM ({_CONTROLS})) WHERE n <= 60")
def control_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.slices(_controls(Study(spark, sf_dir)), {"fit": 40, "score": 20}, SEED)


@query(f"""SELECT s.place, s.cell, gene, cnt FROM (SELECT cell, row_number() OVER (ORDER BY sha256('{SEED}:' || cell)) AS place FROM ({_CONTROLS})) s JOIN counts USING (cell)
  WHERE s.place <= 40 AND gene IN (SELECT gene FROM axis)""")
def selected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point read: the counts of some cells on some genes, in the order of the selection."""
    s = Study(spark, sf_dir)
    sel = splits.slices(_controls(s), {"fit": 40}, SEED)
    sel = sel.select("cell", F.row_number().over(Window.orderBy(splits.hash_order(SEED, "cell"))).cast("long").alias("place"))
    axis = cohorts.common_axis(pseudobulk.panel(s.counts), TRAIN, HELD)
    return s.counts.join(small(sel), "cell").join(small(axis), "gene", "left_semi").select("place", "cell", "gene", "cnt")


@query(ORACLES["selected_cells"], whole=True)
def blocked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same point read from a store of blocks, of which only those with a selected cell are opened."""
    s = Study(spark, sf_dir, written=True)  # the store is made of several reads
    path = reserve(spark, "blocks")
    blocks.write_blocks(s.counts, s.cells, path)
    sel = splits.slices(_controls(s), {"fit": 40}, SEED)
    sel = sel.select("cell", F.row_number().over(Window.orderBy(splits.hash_order(SEED, "cell"))).cast("long").alias("place"))  # 40 rows
    axis = cohorts.common_axis(pseudobulk.panel(s.counts), TRAIN, HELD)
    return blocks.read_cells(spark, path, sel, axis).join(small(sel), "cell").select("place", "cell", "gene", "cnt")


@query(f"""WITH c AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS cell_idx FROM ({_CONTROLS})), n AS (SELECT cell, count(*) AS nnz FROM counts GROUP BY cell)
  SELECT CAST(cell_idx AS INTEGER) AS cell_idx, coalesce(nnz, 0) AS nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY cell_idx ROWS UNBOUNDED PRECEDING), 0) - coalesce(nnz, 0) AS BIGINT) AS begin FROM c LEFT JOIN n USING (cell)""")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    cells = numbering.by_range(_controls(s).select("cell").distinct(), ["cell"], "cell_idx")
    return splits.csr_offsets(s.counts, cells.withColumn("cell_idx", F.col("cell_idx").cast("int")))


@query(f"SELECT batch, gene, round(s / sum(s) OVER (PARTITION BY batch), 6) AS share FROM (SELECT batch, gene, sum(cnt) AS s FROM counts WHERE target = '{CONTROL}' AND line = '{TRAIN}' GROUP BY ALL)")
def control_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(Study(spark, sf_dir)).withColumn("share", r6("share"))


def _profile(s: Study) -> DataFrame:
    return splits.control_profile(s.counts.where((F.col("target") == CONTROL) & (F.col("line") == TRAIN)), "batch")


@query(f"SELECT batch, round(sum(1 - power(1 - share, 2000)), 4) AS expected FROM (SELECT batch, gene, s / sum(s) OVER (PARTITION BY batch) AS share FROM (SELECT batch, gene, sum(cnt) AS s FROM counts WHERE target = '{CONTROL}' AND line = '{TRAIN}' GROUP BY ALL)) GROUP BY batch")
def expected_nonzeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.expected_nonzeros(_profile(Study(spark, sf_dir)), 2000, "batch").withColumn("expected", F.round("expected", 4))


# --- distributions, transport, calibration ---------------------------------------------------


_MOMENTS = """SELECT {by}, gene, coalesce(s, 0) / n AS mean, greatest((coalesce(q, 0) - n * power(coalesce(s, 0) / n, 2)) / nullif(n - 1, 0), 0) AS variance, 1 - coalesce(k, 0) / n AS dropout
  FROM (SELECT {by}, count(*) AS n FROM {cells} GROUP BY ALL) JOIN (SELECT DISTINCT gene FROM panel WHERE line = 'A') g ON true LEFT JOIN (SELECT {by}, gene, sum(x) AS s, sum(x * x) AS q, count(*) FILTER (cnt > 0) AS k FROM
    (SELECT *, ln(1 + cnt * 1e4 / lib) AS x FROM counts WHERE line = 'A' AND target = 'non-targeting') GROUP BY ALL) USING ({by}, gene)"""
_BY_BATCH = _MOMENTS.format(by="batch", cells=f"({_CONTROLS})")


def _moments(s: Study) -> DataFrame:
    counts = s.counts.where((F.col("target") == CONTROL) & (F.col("line") == TRAIN))
    return metrics.moments(counts, _controls(s), s.counts.where(F.col("line") == TRAIN).select("gene").distinct(), "batch")


@query(f"SELECT batch, gene, round(mean, 6) AS mean, round(variance, 6) AS variance, round(dropout, 6) AS dropout FROM ({_BY_BATCH})")
def gene_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(Study(spark, sf_dir)).withColumns({c: r6(c) for c in ("mean", "variance", "dropout")})


@query(f"""WITH m AS ({_BY_BATCH}), r AS (SELECT * FROM m WHERE batch = (SELECT min(batch) FROM m)) SELECT m.batch, round(sqrt(avg(power(m.mean - r.mean, 2))), 6) AS mean_log_rmse,
  round(sqrt(avg(power(m.variance - r.variance, 2))), 6) AS variance_log_rmse, round(avg(abs(m.dropout - r.dropout)), 6) AS dropout_mae FROM m JOIN r USING (gene) GROUP BY m.batch""")
def distribution_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's controls against those of the first."""
    m = materialize(_moments(Study(spark, sf_dir)), "moments")
    first = m.join(F.broadcast(m.agg(F.min("batch").alias("batch"))), "batch", "left_semi")
    return metrics.distribution_distance(m, first, "batch").withColumns({c: r6(c) for c in ("mean_log_rmse", "variance_log_rmse", "dropout_mae")})


_RUNS = "SELECT p_type AS candidate, p_size % 3 AS seed, avg(p_retailprice) / 100 AS score FROM part GROUP BY ALL"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as candidates and sizes as seeds."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("candidate"), (F.col("p_size") % 3).alias("seed")).agg((F.avg("p_retailprice") / 100).alias("score"))


@query(f"SELECT candidate, round(avg(score), 6) AS score FROM ({_RUNS}) GROUP BY candidate ORDER BY avg(score), candidate LIMIT 1")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.select_candidate(_runs(spark, sf_dir)).withColumn("score", r6("score"))


@query(f"WITH r AS ({_RUNS}), o AS (SELECT candidate, list_sort(list(seed)) AS seeds FROM r WHERE candidate NOT LIKE '%E%' OR seed <> 1 GROUP BY candidate) SELECT candidate, CAST(seeds AS VARCHAR) AS seeds FROM o WHERE seeds <> (SELECT min(seeds) FROM o)")
def seed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).where(~F.col("candidate").contains("E") | (F.col("seed") != 1))
    return calibration.seed_problems(r).select("candidate", F.concat(F.lit("["), F.array_join("seeds", ", "), F.lit("]")).alias("seeds"))


@query(f"""SELECT cell, round((lib - coalesce(panel, 0)) * 1e4 / lib, 6) + 0.0 AS outside, round(coalesce(total, 0), 6) AS log_total FROM ({_CONTROLS}) LEFT JOIN
  (SELECT cell, sum(cnt) AS panel, sum(ln(1 + cnt * 1e4 / lib)) AS total FROM counts GROUP BY cell) USING (cell)""")
def transport_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    p = _profiles(s)
    total = F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x)
    return p.rows.select("cell", r6("outside").alias("outside"), r6(total).alias("log_total"))


def _profiles(s: Study) -> generate.Profiles:
    counts = s.counts.where((F.col("target") == CONTROL) & (F.col("line") == TRAIN))
    return generate.transport_profiles(counts, _controls(s), s.counts.where(F.col("line") == TRAIN).select("gene").distinct())


@query(f"""SELECT d.target, d.gene, round(greatest(b.mean_log + delta_log, 0), 6) AS desired, round(exp(greatest(b.mean_log + delta_log, 0)) - 1, 4) AS rate,
  round(least(greatest(0.1 + least(greatest(0.5 * delta_log, -0.25), 0.25), -0.3), 0.3), 6) AS moved FROM delta d JOIN baseline b USING (line, gene) WHERE d.line = '{TRAIN}'""")
def calibration_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desired means, rates and one damped update of an offset of 0.1."""
    from deltaloom.functions.expr import rate

    s = Study(spark, sf_dir)
    both = s.deltas().where(F.col("line") == TRAIN).join(small(s.baseline().select("line", "gene", F.col("mean_log").alias("base"))), ["line", "gene"])
    d = F.col("delta_log")
    return both.select("target", "gene", r6(F.greatest(F.col("base") + d, F.lit(0.0))).alias("desired"), F.round(rate(F.col("base"), d), 4).alias("rate"), r6(damped(F.lit(0.1), d, 0.5, 0.25, 0.3)).alias("moved"))


# --- audit -----------------------------------------------------------------------------------


def _identities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as cell identities, documents as the cells of a matrix."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % 97).cast("string")).alias("barcode"), F.col("event_type").alias("guide"),
        F.when(k % 5 == 0, "false").otherwise("True").alias("coverage"), F.when(k % 7 == 0, "2").otherwise("1.0").alias("cells"),
    )
    d = F.col("doc_id")
    return e, table(spark, sf_dir, "documents").select(F.concat((d % 150).cast("string"), F.lit("-"), (d % 97).cast("string")).alias("barcode"))


@query("""SELECT barcode, guide, coverage, cells FROM (SELECT *, count(*) OVER (PARTITION BY barcode) AS n FROM ident)
  WHERE upper(coverage) = 'TRUE' AND CAST(cells AS DOUBLE) = 1 AND n = 1 AND barcode IN (SELECT barcode FROM matrix)""")
def eligible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.eligible(*_identities(spark, sf_dir))


@query("""SELECT DISTINCT barcode, 'identity' AS side FROM ident WHERE barcode NOT IN (SELECT barcode FROM matrix)
  UNION ALL SELECT DISTINCT barcode, 'matrix' FROM matrix WHERE barcode NOT IN (SELECT barcode FROM ident)""")
def unmatched_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unmatched(*_identities(spark, sf_dir))


@query("SELECT split_part(barcode, '-', 2) AS gem, guide, count(*) AS n FROM ident GROUP BY ALL")
def guide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.guide_counts(_identities(spark, sf_dir)[0])


@query("""SELECT gem, string_agg(guide || '=' || n, ',' ORDER BY guide) AS guides FROM (SELECT split_part(barcode, '-', 2) AS gem, guide, count(*) AS n FROM ident GROUP BY ALL) GROUP BY gem""")
def nested_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = audit.nested(audit.guide_counts(_identities(spark, sf_dir)[0]))
    said = F.transform(F.sort_array(F.map_entries("guides")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("gem", F.array_join(said, ",").alias("guides"))


@query("SELECT guide, count(*) AS n FROM ident GROUP BY guide")
def guide_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.frequencies(_identities(spark, sf_dir)[0], "guide")


@query("SELECT count(DISTINCT barcode) AS n_barcodes, count(DISTINCT guide) AS n_guides, count(*) AS n_rows FROM ident")
def distinct_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distinct_counts(_identities(spark, sf_dir)[0])


@query("SELECT barcode, count(*) AS n FROM ident GROUP BY barcode HAVING count(*) > 1")
def repeated_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated(_identities(spark, sf_dir)[0], "barcode")


_SAID = "coalesce(length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), 'null')".format
_DIGEST = f"sha256(concat_ws(',', '', {', '.join(_SAID(c) for c in ('batch', 'cell', 'guide', 'line', 'target'))}))"


@query(f"""SELECT line, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS a, CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS b
  FROM (SELECT line, {_DIGEST} AS h FROM cells) GROUP BY line""")
def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the cells of each line as tables of their own."""
    cells = Study(spark, sf_dir).cells.select("line", "target", "batch", "guide", "cell")
    out = None
    for line in (TRAIN, HELD):
        d = digests(cells.where(F.col("line") == line)).select(F.lit(line).alias("line"), "n", "a", "b")
        out = d if out is None else out.unionByName(d)
    return out


# --- scalar expressions ----------------------------------------------------------------------


@query("""SELECT cell, gene, round(ln(1 + cnt * 1e4 / lib), 6) AS x, 'pred_' || lpad(CAST(cell AS VARCHAR), 9, '0') AS name FROM counts""")
def normalized_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).counts.select("cell", "gene", r6(log_norm("cnt", "lib")).alias("x"), cell_name("cell").alias("name"))


@query("SELECT s_name, split_part(s_name, '#', -1) AS last, trim(' ' || s_name) <> ' ' || s_name AS padded, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_acctbal END AS value FROM supplier")
def string_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaloom.functions.expr import last_part

    s = table(spark, sf_dir, "supplier")
    value = F.when(F.col("s_suppkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    return s.select("s_name", last_part("s_name", "#").alias("last"), is_padded(F.concat(F.lit(" "), "s_name")).alias("padded"), finite_or_null(value).alias("value"))


@query("SELECT c.cell, round((lib - coalesce(p, 0)) * 1e4 / lib, 6) + 0.0 AS outside FROM cells c LEFT JOIN (SELECT cell, sum(cnt) AS p FROM counts GROUP BY cell) q ON q.cell = c.cell")
def outside_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    p = s.counts.groupBy("cell").agg(F.sum("cnt").alias("p"))
    return s.cells.join(p, "cell", "left").select("cell", r6(outside_mass("lib", F.coalesce("p", F.lit(0.0)))).alias("outside"))


# --- without SQL: iterative or random --------------------------------------------------------


def _basis(t: Transfer) -> tuple[DataFrame, DataFrame]:
    return lowrank.response_basis(t.train, RANK, SEED)


@query("SELECT target, gene, round(y, 6) + 0.0 AS p FROM ytrain")
def full_rank_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With as many components as there are targets nothing is lost."""
    t = Study(spark, sf_dir).transfer()
    mean, basis = lowrank.response_basis(t.train, FULL, SEED)
    return lowrank.reconstruct(lowrank.project(t.train, mean, basis), mean, basis).withColumn("p", r6("p"))


@query(f"SELECT target, gene, round(b0 + z * b1, 6) + 0.0 AS p FROM zheld, ({_RIDGE})")
def full_rank_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on all components' scores by one feature is ridge on the responses."""
    t = Study(spark, sf_dir).transfer()
    mean, basis = lowrank.response_basis(t.train, FULL, SEED)
    train, held = t.scaled()
    x_train, x_held = (x.select("target", F.col("z").alias("basal")) for x in (train, held))
    w = lowrank.ridge_fit(x_train, lowrank.project(t.train, mean, basis), ["basal"], ALPHA)
    return lowrank.reconstruct(lowrank.ridge_predict(x_held, ["basal"], w), mean, basis).withColumn("p", r6("p"))


@query(f"""WITH t AS (SELECT sum(power(y - p, 2)) AS whole, count(DISTINCT target) AS n FROM ytrain JOIN tmean USING (gene))
  SELECT CAST(least({RANK}, n - 1, (SELECT count(*) FROM axis)) AS INTEGER) AS components, round(whole, 6) AS whole, true AS orthonormal, true AS best FROM t""")
def basis_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truncated basis is orthonormal, and leaves as little as the best one of its rank, which the exact matrix of products gives."""
    t = Study(spark, sf_dir).transfer()
    mean, basis = _basis(t)
    tail, _ = lowrank.exact_tail(t.train, RANK)
    r = lowrank.basis_report(t.train, mean, basis)
    best = F.col("left") <= F.lit(tail) * 1.01 + F.col("whole") * 1e-9
    return r.select("components", F.round("whole", 6).alias("whole"), (F.col("off") < 1e-9).alias("orthonormal"), best.alias("best"))


@query()
def low_rank_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training responses from their scores on the basis."""
    t = Study(spark, sf_dir).transfer()
    mean, basis = _basis(t)
    return lowrank.reconstruct(lowrank.project(t.train, mean, basis), mean, basis).withColumn("p", r6("p"))


@query()
def low_rank_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out responses by ridge of basis scores on graph features, a prior for each component among them."""
    t, train_of, held_of = _maker_inputs(spark, sf_dir)
    return families.predict(t.train, train_of, held_of, [families.Setting("ridge", "ridge", families.GRAPH, ALPHA)], RANK, SEED)["ridge"].withColumn("p", r6("p"))


@query()
def low_rank_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out responses by boosted trees of basis scores on graph features."""
    t, train_of, held_of = _maker_inputs(spark, sf_dir)
    return families.predict(t.train, train_of, held_of, [families.Setting("trees", "trees", families.GRAPH, **TREES)], RANK, SEED)["trees"].withColumn("p", r6("p"))


@query()
def grid_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the whole grid over the folds, features made from each fold's training rows."""
    t, features_of, _ = _maker_inputs(spark, sf_dir)
    y = materialize(t.train, "train")
    return families.grid_losses(y, transfer.folds(t.x_train, FOLDS, SEED), features_of, families.grid(RIDGE_ALPHAS, LEAVES, **{k: v for k, v in TREES.items() if k != "leaves"}), RANK, SEED).withColumn("mse", F.round("mse", 6))


def _null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _null_parts(spark, sf_dir)[2]


def _null_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, cells and their counts."""
    s = Study(spark, sf_dir)
    profile = materialize(_profile(s).withColumnRenamed("batch", "context"), "profile")
    t = _targets(s).where(F.col("line") == HELD).select(F.col("target").alias("perturbation"))
    cells = generate.prediction_grid(profile.select("context").distinct(), t, REPLICATES)
    return profile, cells, generate.multinomial_null(profile, cells, DEPTH, SEED)


@query()
def multinomial_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of equal depth for every context and perturbation."""
    return _null(spark, sf_dir)


@query(f"""SELECT 'pred_' || lpad(CAST((c * (SELECT count(*) FROM held) + p) * {REPLICATES} + r AS VARCHAR), 9, '0') AS cell_name, context, {DEPTH} AS depth, 0 AS off_profile
  FROM (SELECT batch AS context, row_number() OVER (ORDER BY batch) - 1 AS c FROM (SELECT DISTINCT batch FROM ({_CONTROLS}))), (SELECT row_number() OVER (ORDER BY target) - 1 AS p FROM held), (SELECT unnest(range({REPLICATES})) AS r)""")
def null_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the panel has its depth, and counts only where its context's profile has mass."""
    seen = _profile(Study(spark, sf_dir)).where("share > 0").select(F.col("batch").alias("context"), "gene", F.lit(1).alias("on"))
    drawn = _null(spark, sf_dir).join(seen, ["context", "gene"], "left")
    return drawn.groupBy("cell_name", "context").agg(F.sum("cnt").alias("depth"), F.count(F.when(F.col("on").isNull(), 1)).alias("off_profile"))


@query(f"""WITH n AS (SELECT batch AS context, (SELECT count(*) FROM held) * {REPLICATES} AS n_cells, count(*) FILTER (s > 0 AND s < whole) AS n_genes
    FROM (SELECT batch, gene, sum(cnt) AS s, sum(sum(cnt)) OVER (PARTITION BY batch) AS whole FROM counts WHERE target = '{CONTROL}' AND line = '{TRAIN}' GROUP BY batch, gene) GROUP BY batch)
  SELECT context, n_cells, n_genes, true AS agrees FROM n""")
def null_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null's cells are draws of their contexts' profiles, by sums of genes and by how cells scatter."""
    profile, cells, drawn = _null_parts(spark, sf_dir)
    return generate.null_agreement(drawn, profile, cells, DEPTH).select("context", "n_cells", "n_genes", "agrees")


def _donors_sql(per_batch: int, seed: int) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:order:' || batch || ':' || i)) - 1 AS BIGINT) AS draw, batch, cell FROM
      (SELECT batch, i, CAST('0x' || substr(sha256('{seed}:' || batch || ':' || i), 1, 12) AS BIGINT) % n AS place FROM (SELECT batch, count(*) AS n FROM ({_CONTROLS}) GROUP BY batch), (SELECT unnest(range({per_batch})) AS i))
      JOIN (SELECT batch, cell, row_number() OVER (PARTITION BY batch ORDER BY cell) - 1 AS place FROM ({_CONTROLS})) USING (batch, place)"""


@query(_donors_sql(DONORS, SEED))
def donor_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced donors: as many draws from each batch."""
    return splits.balanced_donors(_controls(Study(spark, sf_dir)), DONORS, SEED)


@query(f"""WITH c AS (SELECT cell, row_number() OVER (ORDER BY sha256('{SEED}:' || cell)) - 1 AS place FROM ({_CONTROLS}))
  SELECT draw, cell FROM (SELECT i AS draw, CAST('0x' || substr(sha256('{SEED}:draw:' || i), 1, 12) AS BIGINT) % (SELECT count(*) FROM c) AS place FROM (SELECT unnest(range({CELLS})) AS i)) JOIN c USING (place)""")
def uniform_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.uniform_donors(_controls(Study(spark, sf_dir)), CELLS, SEED)


def _generated(spark: SparkSession, sf_dir: str) -> tuple[generate.Profiles, DataFrame, DataFrame, DataFrame]:
    s = Study(spark, sf_dir)
    profiles = _profiles(s).written()
    delta = s.deltas().where(F.col("line") == TRAIN).select("target", "gene", F.col("delta_log").alias("d"))
    donors = materialize(splits.uniform_donors(profiles.rows, CELLS, SEED), "donors")
    return profiles, donors, delta, materialize(generate.transport_generate(profiles, donors, delta, SEED), "drawn")


@query()
def transport_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control profiles moved by the responses of every training target, at their donors' depth."""
    profiles, _, delta, drawn = _generated(spark, sf_dir)
    return generate.sample_report(drawn, profiles, delta)


@query(f"""WITH c AS (SELECT cell, lib, row_number() OVER (ORDER BY sha256('{SEED}:' || cell)) - 1 AS place FROM ({_CONTROLS})),
  d AS (SELECT i AS draw, lib FROM (SELECT i, CAST('0x' || substr(sha256('{SEED}:draw:' || i), 1, 12) AS BIGINT) % (SELECT count(*) FROM c) AS place FROM (SELECT unnest(range({CELLS})) AS i)) JOIN c USING (place))
  SELECT target, draw AS sample, CAST(lib AS BIGINT) AS depth, true AS within FROM (SELECT DISTINCT target FROM delta WHERE line = '{TRAIN}'), d""")
def transport_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated cells have their donor's depth, and no more counts than that."""
    *_, drawn = _generated(spark, sf_dir)
    return drawn.select("target", "sample", "depth", (F.aggregate("cnt", F.lit(0).cast("long"), lambda a, c: a + c) <= F.col("depth")).alias("within"))


_DRAWS = f"""cc AS (SELECT cell, lib, row_number() OVER (ORDER BY sha256('{SEED}:' || cell)) - 1 AS place FROM ({_CONTROLS})),
  dd AS (SELECT draw, cell, lib FROM (SELECT i AS draw, CAST('0x' || substr(sha256('{SEED}:draw:' || i), 1, 12) AS BIGINT) % (SELECT count(*) FROM cc) AS place FROM (SELECT unnest(range({CELLS})) AS i)) JOIN cc USING (place)),
  mv AS (SELECT target, draw, greatest(x + delta_log, 0) AS to_, x + delta_log AS moved, gene FROM (SELECT target, gene, delta_log FROM delta WHERE line = '{TRAIN}') JOIN
    (SELECT draw, g.gene, coalesce(ln(1 + cnt * 1e4 / c.lib), 0) AS x FROM dd CROSS JOIN (SELECT DISTINCT gene FROM panel WHERE line = '{TRAIN}') g LEFT JOIN counts c ON c.cell = dd.cell AND c.gene = g.gene) USING (gene))"""


@query(f"WITH {_DRAWS} SELECT target, round(avg(CAST(moved < 0 AS INTEGER)), 6) AS clip_fraction, true AS within_depth FROM mv GROUP BY target")
def sample_clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target's sample, the share of values that would be below 0, and that no cell exceeds its donor's depth."""
    profiles, _, delta, drawn = _generated(spark, sf_dir)
    return generate.sample_report(drawn, profiles, delta).select("target", r6("clip_fraction").alias("clip_fraction"), "within_depth")


@query(f"WITH {_DRAWS} SELECT target, count(*) AS n_genes, true AS agrees FROM (SELECT target, gene FROM mv GROUP BY target, gene HAVING max(to_) > 0) GROUP BY target")
def transport_goodness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's counts are draws of its donors' moved profiles."""
    profiles, donors, delta, drawn = _generated(spark, sf_dir)
    return generate.transport_agreement(drawn, profiles, donors, delta).select("target", "n_genes", "agrees")


@query()
def calibrated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy and calibrated generators, scored over seeds against calibration controls."""
    s = Study(spark, sf_dir)
    controls = _controls(s)
    parts = materialize(splits.split_controls(controls, {k: PARTS[k] for k in ("fit", "calibration")}, SEED), "parts")
    of = lambda p: parts.where(F.col("part") == p).select("cell")
    fit = _profiles(s).of(of("fit")).written()
    own = s.counts.where((F.col("target") == CONTROL) & (F.col("line") == TRAIN)).join(of("calibration"), "cell", "left_semi")
    genes = s.counts.where(F.col("line") == TRAIN).select("gene").distinct()
    reference = materialize(metrics.moments(own, controls.join(of("calibration"), "cell", "left_semi"), genes), "reference")
    deltas = calibration.candidates(fit, materialize(splits.balanced_donors(fit.rows, PARTS["fit"], MC_SEED), "donors"), ITERATIONS, MC_SEED)
    return calibration.evaluate_candidates(fit, lambda seed: splits.balanced_donors(fit.rows, PARTS["calibration"], seed), deltas, reference, SEEDS).withColumns({c: r6(c) for c in ("mean_log_rmse", "variance_log_rmse", "dropout_mae")})
