"""Registered queries for results of tests, confounds, kernels and approximations from state probabilities, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hmm, predict, svm
from ..operators import results as R
from ..operators import testing as T
from . import inference as I
from . import sqltext as S
from . import views as V
from .series import _emb, _r, _soft, query

_STATS = f"{I._perm_sql(True)}, {I._CORR}"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = I._units(spark, sf_dir)
    return T.correlation_stats(u, T.permutations(u, I.PERMS, I.SEED, "block", carry=True))


@query(f"""WITH {_STATS}, d AS (SELECT perm_id, max(r) FILTER (p = 0) - max(r) FILTER (p = 1) AS d FROM st GROUP BY 1),
o AS (SELECT d AS observed FROM d WHERE perm_id = 0),
x AS (SELECT any_value(observed) AS observed, count(*) FILTER (d >= observed) / (count(*) + 1.0) AS p FROM d, o)
SELECT 0 AS state_a, 1 AS state_b, round(observed, 6) AS observed, round(p, 6) AS p FROM x UNION ALL SELECT 1, 0, round(-observed, 6), round(1 - p, 6) FROM x""")
def mirrored_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided p of a pair of correlations, and of the pair turned round."""
    s = _stats(spark, sf_dir).groupBy("perm_id").agg(F.max(F.when(F.col("p") == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("p") == 1, F.col("r"))).alias("b"))
    s = s.select("perm_id", F.lit(0).alias("state_a"), F.lit(1).alias("state_b"), (F.col("a") - F.col("b")).alias("stat"))
    return R.mirrored_p(s, "stat").select("state_a", "state_b", *_r("observed", "p"))


@query(f"""WITH {_STATS}, o AS (SELECT p, t AS observed FROM ts WHERE perm_id = 0)
SELECT ts.p AS predictor, round(any_value(observed), 5) AS observed, round(avg(CASE WHEN abs(t) >= abs(observed) THEN 1.0 ELSE 0.0 END), 6) AS p,
  round(quantile_cont(t, 0.025) FILTER (perm_id > 0), 5) AS lower, round(quantile_cont(t, 0.975) FILTER (perm_id > 0), 5) AS upper FROM ts JOIN o USING (p) GROUP BY 1""")
def null_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stats(spark, sf_dir).withColumnRenamed("p", "predictor")
    return R.null_summary(s, "t", "predictor").select("predictor", *_r("observed", digits=5), *_r("p"), *_r("lower", "upper", digits=5))


@query(f"WITH {I._HOURS} SELECT tau % 3 AS part, round(avg(p), 6) AS p, round(tanh(avg(p)), 6) AS r FROM pv GROUP BY 1")
def mean_of_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I._hours(spark, sf_dir).withColumn("part", F.col("tau") % 3)
    return R.mean_p(h, "p", "part").select("part", *_r("p"), F.round(R.inverse_fisher_z("p"), 6).alias("r"))


_RANKED = f"{I._HOURS}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, CAST(count(*) OVER () AS DOUBLE) AS n FROM pv), h1 AS (SELECT sum(1.0 / i) AS c FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM pv))) AS i))"
_UP, _DOWN = "OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"""WITH {_RANKED}
SELECT 'sidak' AS method, tau, round(1 - pow(1 - p, n), 6) AS q FROM r
UNION ALL SELECT 'holm-sidak', tau, round(max(1 - pow(1 - p, n - r + 1)) {_DOWN}, 6) FROM r
UNION ALL SELECT 'simes-hochberg', tau, round(least(1.0, min(p * (n - r + 1)) {_UP}), 6) FROM r
UNION ALL SELECT 'fdr_by', tau, round(least(1.0, min(p * n * c / r) {_UP}), 6) FROM r, h1""")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I._hours(spark, sf_dir).cache()
    parts = [R.corrected(h, m).select(F.lit(m).alias("method"), "tau", *_r("q")) for m in ("sidak", "holm-sidak", "simes-hochberg", "fdr_by")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {I._HOURS} SELECT tau % 2 AS part, count(p) AS tests, CAST(0 AS BIGINT) AS missing, count(*) FILTER (p <= 0.125) AS significant, round(min(p), 6) AS least, round(avg(p), 6) AS mean FROM pv GROUP BY 1")
def test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I._hours(spark, sf_dir).withColumn("part", F.col("tau") % 2)
    return R.summary_of_tests(h, "part", alpha=0.125).select("part", "tests", "missing", "significant", *_r("least", "mean"))


_BOTH = f"""{I._UNITS}, n AS (SELECT CAST(unnest(range(0, {I.PERMS})) AS INTEGER) AS perm_id),
iu AS (SELECT unit_id, block, perm_id FROM units, n),
ia AS (SELECT perm_id, block, unit_id AS dst, row_number() OVER (PARTITION BY perm_id, block ORDER BY unit_id) AS place FROM iu),
ib AS (SELECT perm_id, block, unit_id AS src, row_number() OVER (PARTITION BY perm_id, block ORDER BY {I._KEY}, unit_id) AS place FROM iu),
inner_ AS (SELECT ia.perm_id, dst AS mid, src FROM ia JOIN ib USING (perm_id, block, place)),
pl AS (SELECT unit_id, block, row_number() OVER (PARTITION BY block ORDER BY unit_id) AS place FROM units),
sz AS (SELECT block AS unit_id, max(place) AS size FROM pl GROUP BY 1),
ou AS (SELECT unit_id, size, perm_id FROM sz, n),
oa AS (SELECT perm_id, size, unit_id AS dst, row_number() OVER (PARTITION BY perm_id, size ORDER BY unit_id) AS place FROM ou),
ob AS (SELECT perm_id, size, unit_id AS src, row_number() OVER (PARTITION BY perm_id, size ORDER BY {I._KEY.replace(f"'{I.SEED}:'", f"'{I.SEED + 1}:'")}, unit_id) AS place FROM ou),
om AS (SELECT oa.perm_id, dst, src FROM oa JOIN ob USING (perm_id, size, place)),
outer_ AS (SELECT om.perm_id, x.unit_id AS dst, y.unit_id AS mid FROM om JOIN pl x ON x.block = om.dst JOIN pl y ON y.block = om.src AND y.place = x.place)
SELECT perm_id, dst, src FROM outer_ JOIN inner_ USING (perm_id, mid)"""


@query(f"WITH {_BOTH}")
def perm_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.both_permutations(I._units(spark, sf_dir), I.PERMS, I.SEED)


@query(f"""WITH {I._perm_sql(False)}, v AS (SELECT perm_id, x.n AS a, x.bal AS b, y.total AS y FROM perms JOIN units x ON x.unit_id = dst JOIN units y ON y.unit_id = src),
c AS (SELECT perm_id, count(*) AS n, regr_sxx(a, a) + 0.001 AS aa, regr_sxx(b, b) + 0.001 AS bb, regr_sxy(a, b) AS ab, regr_sxy(y, a) AS ay, regr_sxy(y, b) AS byy, regr_sxx(y, y) AS yy FROM v GROUP BY 1),
w AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS wa, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS wb FROM c),
e AS (SELECT perm_id, n, (2 * (wa * ay + wb * byy) - wa * wa * (aa - 0.001) - wb * wb * (bb - 0.001) - 2 * wa * wb * ab) / yy AS r2 FROM w)
SELECT perm_id, 0 AS q, CAST(n AS DOUBLE) AS n, round(r2, 6) AS r2, round((r2 / 2) / ((1 - r2) / (n - 2)), 4) AS f FROM e""")
def ols_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = I._units(spark, sf_dir)
    return T.multiple_regression(u, T.permutations(u, I.PERMS, I.SEED), 2, 1).select("perm_id", "q", "n", *_r("r2"), *_r("f", digits=4))


@query("""WITH u AS (SELECT CAST(label % 2 AS INTEGER) AS g, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
t AS (SELECT count(*) AS n, regr_sxx(a, a) AS aa, regr_sxx(b, b) AS bb, regr_sxy(a, b) AS ab FROM u),
w AS (SELECT sum(aa) AS aa, sum(bb) AS bb, sum(ab) AS ab FROM (SELECT g, regr_sxx(a, a) AS aa, regr_sxx(b, b) AS bb, regr_sxy(a, b) AS ab FROM u GROUP BY g)),
l AS (SELECT n, (w.aa * w.bb - w.ab * w.ab) / (t.aa * t.bb - t.ab * t.ab) AS wilks FROM t, w)
SELECT round(wilks, 8) AS wilks, round((1 - wilks) / wilks * (n - 0.5 * 5) / 4, 5) AS f FROM l""")
def manova_two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outcomes over two groups: the closed form of the statistic."""
    e = _emb(spark, sf_dir)
    g = F.col("label") % 2
    u = e.select(F.col("t").alias("unit_id"), F.array(*((g == v).cast("double") for v in (0, 1))).alias("d"), F.array(F.col("y")[0], F.col("y")[1]).alias("r"))
    return T.manova(u, T.permutations(u, 1, I.SEED), 2, 2).select(*_r("wilks", digits=8), *_r("f", digits=5))


@query("""WITH e AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m), 6) AS value, round(exp(-sum((a.m - b.m) * (a.m - b.m)) / 2), 6) AS gaussian FROM e a JOIN e b ON a.i = b.i AND a.label <= b.label GROUP BY 1, 2""")
def kernel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear and Gaussian kernel of the labels' mean vectors."""
    e = _emb(spark, sf_dir).select("label", F.posexplode("y").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    f = e.groupBy(F.col("label").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("features"))
    f = f.cache()
    g = predict.kernel(f, "gaussian", 1.0).withColumnRenamed("value", "gaussian")
    return predict.kernel(f).join(g, ["a", "b"]).select("a", "b", *_r("value", "gaussian"))


@query("SELECT DISTINCT id, id - id % 4 AS family FROM (SELECT o_custkey AS id FROM orders UNION SELECT o_custkey - o_custkey % 4 FROM orders)")
def family_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families as connected components of ties; the ties are made up (each customer with the first of its four)."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") - F.col("o_custkey") % 4).alias("b"))
    return predict.families(o.distinct())


@query(f"WITH {S.SOFT_LONG}, x AS (SELECT a.session_id, a.state AS i, b.state AS j, sum(a.g * b.g) AS s FROM gl a JOIN gl b ON a.session_id = b.session_id AND b.t = a.t + 1 GROUP BY 1, 2, 3) SELECT session_id, i, j, round(s / sum(s) OVER (PARTITION BY session_id), 6) AS xi FROM x")
def pairs_of_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.pairs_of_gamma(_soft(spark, sf_dir)).select("session_id", "i", "j", *_r("xi"))


@query(f"""WITH {S.SOFT_LONG}, w AS (SELECT gl.state, gl.g, CAST(seq.t AS DOUBLE) / 100 AS x, seq.value AS y FROM gl JOIN seq USING (session_id, t)),
m AS (SELECT state, sum(g * y) / sum(g) AS m FROM w GROUP BY 1)
SELECT w.state, 0 AS i, 0 AS j, round(sum(g * x * (y - m)) / (sum(g * x * x) + 0.1), 5) AS beta FROM w JOIN m USING (state) GROUP BY 1""")
def state_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.sequence(spark, sf_dir).withColumn("x", F.array(F.col("t").cast("double") / 100))
    return hmm.state_regressions(o, _soft(spark, sf_dir)).select("state", "i", "j", *_r("beta", digits=5))


@query(f"""WITH {I._UNITS}, m AS (SELECT avg(total) AS my FROM units), b AS (SELECT any_value(my) AS my, sum(n * (total - my)) / (sum(n * n) + 0.00001) AS b FROM units, m)
SELECT unit_id, round(total - my - b * n, 2) + 0.0 AS clean, round(total, 2) AS target FROM units, b""")
def target_without_confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target freed of a confound, and given it back."""
    u = I._units(spark, sf_dir).select("unit_id", F.slice("d", 1, 1).alias("confounds"), F.col("r")[0].alias("target"))
    mean, beta = predict.fit_confounds(u)
    clean = predict.deconfound(u, mean, beta).withColumn("clean", F.round("target", 2) + 0.0)
    return predict.reconfound(clean, mean, beta).select("unit_id", "clean", F.round("target", 2).alias("target"))


@query(f"WITH {I._UNITS} SELECT round((SELECT lgamma(count(*) + 1) FROM units), 4) AS free, round((SELECT sum(lgamma(c + 1)) FROM (SELECT count(*) AS c FROM units GROUP BY block)), 4) AS within, round((SELECT sum(lgamma(k + 1)) FROM (SELECT c, count(*) AS k FROM (SELECT count(*) AS c FROM units GROUP BY block) GROUP BY c)), 4) AS whole")
def permutation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = I._units(spark, sf_dir)
    row = (round(T.count_permutations(u), 4), round(T.count_permutations(u, "block"), 4), round(T.count_permutations(u, "block", True), 4))
    return spark.createDataFrame([row], "free double, within double, whole double")


@query("""WITH c AS (SELECT 0 AS i, count(DISTINCT o_orderstatus = 'F') AS k FROM orders UNION ALL SELECT 1, count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 2, count(DISTINCT o_totalprice) FROM orders)
SELECT i AS p, CASE WHEN k = 2 THEN 't' WHEN k > 2 AND k < 10 THEN 'groups' ELSE 'regression' END AS kind FROM c""")
def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = T.column_kinds(_orders(spark, sf_dir), "d", 3)
    return spark.createDataFrame(list(enumerate(kinds)), "p int, kind string")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: d = [finished or not, priority, price], r = [price]."""
    o = V.table(spark, sf_dir, "orders")
    d = F.array((F.col("o_orderstatus") == "F").cast("double"), F.substring("o_orderpriority", 1, 1).cast("double"), F.col("o_totalprice").cast("double"))
    return o.select(F.col("o_orderkey").alias("unit_id"), d.alias("d"), F.array(F.col("o_totalprice").cast("double")).alias("r"))


@query("""WITH o AS (SELECT CAST(o_totalprice AS DOUBLE) AS v, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS f, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS g FROM orders),
c AS (SELECT count(*) AS n, corr(f, v) AS r FROM o),
k AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM o GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS mm, sum(n * s) AS w FROM k)
SELECT 0 AS p, 't' AS kind, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS observed FROM c
UNION ALL SELECT 1, 'groups', round((sum(k.n * (k.m - mm) * (k.m - mm)) / (t.k - 1)) / (w / (t.n - t.k)), 4) FROM k, t GROUP BY t.k, t.n, w""")
def tests_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each predictor by the statistic that fits it; the observed values."""
    u = _orders(spark, sf_dir).withColumn("d", F.slice("d", 1, 2))
    return T.across_columns(u, n=1, seed=I.SEED).select("p", "kind", *_r("observed", digits=4))


@query()
def cv_with_confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated prediction with a confound removed on the training folds."""
    e = _emb(spark, sf_dir)
    u = e.select(F.col("t").alias("unit_id"), F.expr("slice(y, 2, size(y) - 1)").alias("features"), F.col("y")[0].alias("target"), F.array(F.col("label").cast("double")).alias("confounds"))
    return predict.cross_validate(u)


@query()
def cv_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel ridge regression of the labels' parity from all coordinates, by a Gaussian kernel."""
    e = _emb(spark, sf_dir)
    return predict.kernel_cross_validate(e.select(F.col("t").alias("unit_id"), F.col("y").alias("features"), (F.col("label") % 2).cast("double").alias("target")), 3, None, "gaussian", 4.0)


@query()
def cv_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support vector machines with a Gaussian kernel tell the labels' parity from all coordinates."""
    e = _emb(spark, sf_dir)
    u = e.select(F.col("t").alias("unit_id"), F.col("y").alias("features"), (F.col("label") % 2).cast("double").alias("target"))
    return svm.cross_svm(u, 3, None, "gaussian", 4.0, (0.1, 1.0))
