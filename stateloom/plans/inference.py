"""Registered queries for association tests, corrections, spectra and prediction, with their SQL where there is one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, exchange, predict, quantiles, spectral
from ..operators import testing as T
from . import sqltext as S
from . import views as V
from .lineage import cut
from .series import _emb, _r, _z, query

PERMS, SEED = 20, 11


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: d = [orders, balance], r = [sum of orders], block = nation."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("block"), F.col("c_acctbal").cast("double").alias("bal"))
    o = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit_id")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("total"))
    return c.join(o, "unit_id").select("unit_id", "block", F.array("n", "bal").alias("d"), F.array("total").alias("r"))


_UNITS = """units AS (
  SELECT c_custkey AS unit_id, c_nationkey AS block, CAST(count(*) AS DOUBLE) AS n, CAST(any_value(c_acctbal) AS DOUBLE) AS bal, sum(CAST(o_totalprice AS DOUBLE)) AS total
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"""
_KEY = f"CASE WHEN perm_id = 0 THEN '' ELSE md5('{SEED}:' || perm_id || ':' || unit_id) END"


def _perm_sql(block: bool) -> str:
    part = "PARTITION BY perm_id, block" if block else "PARTITION BY perm_id"
    on = "a.perm_id = b.perm_id AND a.place = b.place" + (" AND a.block = b.block" if block else "")
    return f"""{_UNITS}, u AS (SELECT unit_id, block, CAST(perm_id AS INTEGER) AS perm_id FROM units, (SELECT unnest(range(0, {PERMS})) AS perm_id)),
a AS (SELECT perm_id, block, unit_id AS dst, row_number() OVER ({part} ORDER BY unit_id) AS place FROM u),
b AS (SELECT perm_id, block, unit_id AS src, row_number() OVER ({part} ORDER BY {_KEY}, unit_id) AS place FROM u),
perms AS (SELECT a.perm_id, dst, src FROM a JOIN b ON {on})"""


@query(f"WITH {_perm_sql(False)} SELECT * FROM perms")
def perm_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.permutations(_units(spark, sf_dir), PERMS, SEED)


@query(f"WITH {_perm_sql(True)} SELECT * FROM perms")
def perm_within_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.permutations(_units(spark, sf_dir), PERMS, SEED, "block")


_BETWEEN = f"""{_UNITS}, pl AS (SELECT unit_id, block, row_number() OVER (PARTITION BY block ORDER BY unit_id) AS place FROM units),
sz AS (SELECT block AS unit_id, max(place) AS size FROM pl GROUP BY 1),
u AS (SELECT unit_id, size, CAST(perm_id AS INTEGER) AS perm_id FROM sz, (SELECT unnest(range(0, {PERMS})) AS perm_id)),
a AS (SELECT perm_id, size, unit_id AS dst, row_number() OVER (PARTITION BY perm_id, size ORDER BY unit_id) AS place FROM u),
b AS (SELECT perm_id, size, unit_id AS src, row_number() OVER (PARTITION BY perm_id, size ORDER BY {_KEY}, unit_id) AS place FROM u),
m AS (SELECT a.perm_id, dst, src FROM a JOIN b USING (perm_id, size, place)),
perms AS (SELECT m.perm_id, x.unit_id AS dst, y.unit_id AS src FROM m JOIN pl x ON x.block = m.dst JOIN pl y ON y.block = m.src AND y.place = x.place)"""


@query(f"WITH {_BETWEEN} SELECT * FROM perms")
def perm_between_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.block_permutations(_units(spark, sf_dir), PERMS, SEED)


_CORR = f"""st AS (
  SELECT perm_id, 0 AS p, count(*) AS n, corr(x.n, y.total) AS r FROM perms JOIN units x ON x.unit_id = dst JOIN units y ON y.unit_id = src GROUP BY 1
  UNION ALL SELECT perm_id, 1, count(*), corr(x.bal, y.total) FROM perms JOIN units x ON x.unit_id = dst JOIN units y ON y.unit_id = src GROUP BY 1),
ts AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM st)"""


@query(f"WITH {_perm_sql(True)}, {_CORR} SELECT perm_id, p, n, round(r, 6) AS r, round(t, 5) AS t FROM ts")
def corr_tstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    return T.correlation_stats(u, T.permutations(u, PERMS, SEED, "block", carry=True)).select("perm_id", "p", "n", F.round("r", 6).alias("r"), F.round("t", 5).alias("t"))


@query(f"WITH {_perm_sql(True)}, {_CORR}, o AS (SELECT p, t AS observed FROM ts WHERE perm_id = 0) SELECT ts.p AS predictor, round(any_value(observed), 5) AS observed, round(avg(CASE WHEN abs(t) >= abs(observed) THEN 1.0 ELSE 0.0 END), 6) AS p FROM ts JOIN o USING (p) GROUP BY 1")
def perm_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    out = T.across_units(u, PERMS, block="block", how="within", seed=SEED, chunk=8)
    # columns: predictor p, outcome q, observed, and the p-value
    return out.toDF("predictor", "q", "observed", "pv").select("predictor", F.round("observed", 5).alias("observed"), F.round("pv", 6).alias("p"))


@query(f"WITH {_perm_sql(True)}, {_CORR}, m AS (SELECT perm_id, max(abs(t)) AS top FROM ts GROUP BY 1), o AS (SELECT p, t AS observed FROM ts WHERE perm_id = 0) SELECT p AS predictor, round(observed, 5) AS observed, round((count(*) FILTER (top >= abs(observed)) + 1) / (count(*) + 1), 6) AS p FROM o, m WHERE perm_id > 0 GROUP BY 1, 2")
def fwer_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    out = T.across_units(u, PERMS, block="block", how="within", seed=SEED, fwer=True)
    return out.toDF("predictor", "q", "observed", "pv").select("predictor", F.round("observed", 5).alias("observed"), F.round("pv", 6).alias("p"))


@query(f"WITH {_UNITS} SELECT count(*) AS n, round(regr_r2(total, n), 6) AS r2, round(regr_r2(total, n) / ((1 - regr_r2(total, n)) / (count(*) - 2)), 4) AS f FROM units")
def ols_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.single_regression(_units(spark, sf_dir)).where("p = 0")
    return s.select("n", F.round("r2", 6).alias("r2"), F.round("f", 4).alias("f"))


@query(f"""WITH {_perm_sql(False)}, c AS (SELECT perm_id, corr(x.n, y.total) AS a, corr(x.bal, y.total) AS b, corr(x.n, x.bal) AS ab FROM perms JOIN units x ON x.unit_id = dst JOIN units y ON y.unit_id = src GROUP BY 1)
SELECT perm_id, 0 AS component, round(sqrt((a * a + b * b - 2 * a * b * ab) / (1 - ab * ab)), 6) AS r FROM c""")
def cca_perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one outcome the canonical correlation is the multiple correlation."""
    u = _units(spark, sf_dir)
    return T.canonical(u, T.permutations(u, PERMS, SEED), 2, 1).select("perm_id", "component", *_r("r"))


@query()
def manova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    labels = [r[0] for r in e.select("label").distinct().orderBy("label").collect()]
    n = e.select(F.size("y")).first()[0]
    u = e.select(F.col("t").alias("unit_id"), F.array(*((F.col("label") == v).cast("double") for v in labels)).alias("d"), F.col("y").alias("r"))
    return T.manova(u, T.permutations(u, 5, SEED), len(labels), n)


_T0 = "SELECT count(*) FILTER (o_orderstatus = 'F') AS n0, count(*) FILTER (o_orderstatus = 'O') AS n1, avg(v) FILTER (o_orderstatus = 'F') AS m0, avg(v) FILTER (o_orderstatus = 'O') AS m1, var_samp(v) FILTER (o_orderstatus = 'F') AS v0, var_samp(v) FILTER (o_orderstatus = 'O') AS v1 FROM (SELECT o_orderstatus, CAST(o_totalprice AS DOUBLE) AS v FROM orders)"


@query(f"WITH s AS ({_T0}) SELECT n0, n1, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) AS t FROM s")
def t_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return T.two_sample_t(o.select((F.col("o_orderstatus") == "O").cast("int").alias("group"), F.col("o_totalprice").cast("double").alias("value"))).select("n0", "n1", *_r("t"))


@query("""WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(CAST(o_totalprice AS DOUBLE)) AS m, var_pop(CAST(o_totalprice AS DOUBLE)) AS v FROM orders GROUP BY 1),
s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * m) / sum(n) AS mm, sum(n * v) AS w FROM g)
SELECT s.k, s.n, round((sum(g.n * (g.m - mm) * (g.m - mm)) / (s.k - 1)) / (w / (s.n - s.k)), 5) AS f FROM g, s GROUP BY s.k, s.n, w""")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("group"), F.col("o_totalprice").cast("double").alias("value"))
    return T.one_way_f(o).select("k", "n", F.round("f", 5).alias("f"))


@query(f"WITH {S.STATES}, s AS (SELECT state, sum(value) AS s, count(*) AS n FROM path GROUP BY 1) SELECT state, round(s / n - (sum(s) OVER () - s) / (sum(n) OVER () - n), 5) AS difference FROM s")
def state_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.state_vs_rest(V.state_sequence(spark, sf_dir)).select("state", F.round("difference", 5).alias("difference"))


@query(f"WITH {S.STATES}, s AS (SELECT state, median(value) AS v FROM path GROUP BY 1) SELECT a.state AS state_a, b.state AS state_b, round(a.v - b.v, 6) + 0.0 AS difference FROM s a JOIN s b ON a.state < b.state")
def state_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.state_pairs(V.state_sequence(spark, sf_dir), how="median").select("state_a", "state_b", (F.round("difference", 6) + 0.0).alias("difference"))


@query()
def visits_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.across_visits(V.state_sequence(spark, sf_dir), 5, n=20)


@query(f"""WITH {S.SEQ}, h AS (SELECT session_id, t, value, row_number() OVER (PARTITION BY session_id ORDER BY md5('0:' || session_id || ':' || t), t) % 2 = 1 AS train FROM seq),
c AS (SELECT session_id, train, t - avg(t) OVER w AS d, value - avg(value) OVER w AS r FROM h WINDOW w AS (PARTITION BY session_id, train)),
f AS (
  SELECT session_id, sum(d * r) FILTER (train) / (sum(d * d) FILTER (train) + 0.001) AS b,
    sum(d * d) FILTER (NOT train) AS dd, sum(d * r) FILTER (NOT train) AS dr, sum(r * r) FILTER (NOT train) AS rr
  FROM c GROUP BY 1),
u AS (SELECT session_id, CAST(perm_id AS INTEGER) AS perm_id FROM f, (SELECT unnest(range(0, 20)) AS perm_id)),
x AS (SELECT perm_id, session_id AS dst, row_number() OVER (PARTITION BY perm_id ORDER BY session_id) AS place FROM u),
y AS (SELECT perm_id, session_id AS src, row_number() OVER (PARTITION BY perm_id ORDER BY CASE WHEN perm_id = 0 THEN '' ELSE md5('0:' || perm_id || ':' || session_id) END, session_id) AS place FROM u),
s AS (
  SELECT perm_id, 1 - sum(p.rr - 2 * q.b * p.dr + q.b * q.b * p.dd) / sum(p.rr) AS stat
  FROM x JOIN y USING (perm_id, place) JOIN f p ON p.session_id = dst JOIN f q ON q.session_id = src GROUP BY 1),
o AS (SELECT stat AS observed FROM s WHERE perm_id = 0)
SELECT 0 AS q, round(any_value(observed), 6) AS observed, round(avg(CASE WHEN stat >= observed THEN 1.0 ELSE 0.0 END), 6) AS p FROM s, o""")
def sessions_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the time in a session explain the value, with coefficients swapped between sessions?"""
    s = V.sequence(spark, sf_dir).select("session_id", F.col("t").alias("unit_id"), F.array(F.col("t").cast("double")).alias("d"), F.array("value").alias("r"))
    return T.across_sessions(s, 1, 1, n=20).select("q", *_r("observed", "p"))


#: Permutations of the tests by hour.
HOUR_PERMS = 40

# p-values of a test in each hour of the day: does the number of a user's events go with the mean value in that hour?
_HOURS = f"""h AS (SELECT CAST(hour(ts) AS INTEGER) AS tau, avg(value) AS m FROM events GROUP BY 1),
hu AS (SELECT user_id AS unit_id, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1),
hm AS (SELECT user_id AS unit_id, CAST(hour(ts) AS INTEGER) AS tau, avg(value) AS v FROM events GROUP BY 1, 2),
hk AS (SELECT unit_id, CAST(perm_id AS INTEGER) AS perm_id FROM hu, (SELECT unnest(range(0, {HOUR_PERMS})) AS perm_id)),
ha AS (SELECT perm_id, unit_id AS dst, row_number() OVER (PARTITION BY perm_id ORDER BY unit_id) AS place FROM hk),
hb AS (SELECT perm_id, unit_id AS src, row_number() OVER (PARTITION BY perm_id ORDER BY {_KEY}, unit_id) AS place FROM hk),
hc AS (SELECT perm_id, tau, count(*) AS k, corr(n, v) AS r FROM ha JOIN hb USING (perm_id, place) JOIN hu ON hu.unit_id = dst JOIN hm ON hm.unit_id = src GROUP BY 1, 2),
hs AS (SELECT perm_id, tau, abs(r * sqrt((k - 2) / (1 - r * r))) AS s FROM hc WHERE k > 2 AND r IS NOT NULL AND NOT isnan(r) AND abs(r) < 1),
hp AS (SELECT tau, avg(CASE WHEN x.s >= o.s THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS p FROM hs x JOIN (SELECT tau, s FROM hs WHERE perm_id = 0) o USING (tau) GROUP BY tau),
pv AS (SELECT tau, m, p FROM hp JOIN h USING (tau))"""


def _hour_stats(spark: SparkSession, sf_dir: str, n_perms: int) -> DataFrame:
    """(perm_id, tau, t) of that test."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), F.hour("ts").alias("tau"), "value")
    n = e.groupBy("unit_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = e.groupBy("unit_id", "tau").agg(F.avg("value").alias("m"))
    # a unit without events in an hour still lends its number to others
    d = cut(n.select("unit_id", F.array("n").alias("d")))
    s = T.fixed_predictor_stats(d, m.select("unit_id", "tau", F.array("m").alias("r")), T.permutations(d, n_perms, SEED, carry=True), "tau")
    return s.where("n > 2 and t is not null and not isnan(t)").select("perm_id", "tau", "t")


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tau, m, p): the mean value and the p-value of each hour."""
    h = V.table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("tau")).agg(F.avg("value").alias("m"))
    return h.join(T.p_values(_hour_stats(spark, sf_dir, HOUR_PERMS), "t", "tau").select("tau", "p"), "tau")


@query(f"WITH {_HOURS}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM pv) SELECT tau, round(p, 6) AS p, round(least(1.0, min(p * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.benjamini_hochberg(_hours(spark, sf_dir)).select("tau", *_r("p", "q"))


@query(f"WITH {_HOURS}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM pv) SELECT tau, round(p, 6) AS p, round(least(1.0, max(p * (n - r + 1)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.holm(_hours(spark, sf_dir)).select("tau", *_r("p", "q"))


@query(f"WITH {_HOURS} SELECT tau, round(p, 6) AS p, round(least(1.0, p * count(*) OVER ()), 6) AS q FROM pv")
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bonferroni(_hours(spark, sf_dir)).select("tau", *_r("p", "q"))


@query(f"WITH {_HOURS}, l AS (SELECT *, tau - row_number() OVER (ORDER BY tau) AS run FROM pv WHERE p < 0.25) SELECT min(tau) AS start, max(tau) AS \"end\" FROM l GROUP BY run")
def sig_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import summary

    return summary.significant_intervals(_hours(spark, sf_dir), 0.25).select("start", "end")


@query(f"WITH {_HOURS}, s AS (SELECT tau, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS z FROM h), l AS (SELECT *, tau - row_number() OVER (ORDER BY tau) AS run FROM s WHERE abs(z) > 0.5) SELECT min(tau) AS start, max(tau) AS \"end\", round(sum(abs(z)), 6) AS mass FROM l GROUP BY run")
def cluster_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy()
    z = _hours(spark, sf_dir).withColumn("stat", (F.col("m") - F.avg("m").over(w)) / F.stddev_pop("m").over(w))
    return T.cluster_masses(z, 0.5).select("start", "end", *_r("mass"))


@query(f"""WITH units AS (SELECT user_id AS unit_id, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1),
m AS (SELECT user_id AS unit_id, CAST(hour(ts) AS INTEGER) AS tau, avg(value) AS m FROM events GROUP BY 1, 2),
u AS (SELECT unit_id, CAST(perm_id AS INTEGER) AS perm_id FROM units, (SELECT unnest(range(0, 50)) AS perm_id)),
a AS (SELECT perm_id, unit_id AS dst, row_number() OVER (PARTITION BY perm_id ORDER BY unit_id) AS place FROM u),
b AS (SELECT perm_id, unit_id AS src, row_number() OVER (PARTITION BY perm_id ORDER BY {_KEY}, unit_id) AS place FROM u),
c AS (SELECT perm_id, tau, count(*) AS k, corr(n, m) AS r FROM a JOIN b USING (perm_id, place) JOIN units ON units.unit_id = dst JOIN m ON m.unit_id = src GROUP BY 1, 2),
s AS (SELECT perm_id, tau, abs(r * sqrt((k - 2) / (1 - r * r))) AS stat FROM c WHERE k > 2 AND r IS NOT NULL AND NOT isnan(r) AND abs(r) < 1),
o AS (SELECT *, tau - row_number() OVER (PARTITION BY perm_id ORDER BY tau) AS run FROM s WHERE stat > (SELECT quantile_cont(stat, 0.95) FROM s)),
g AS (SELECT perm_id, min(tau) AS start, max(tau) AS stop, sum(stat) AS mass FROM o GROUP BY perm_id, run),
top AS (SELECT perm_id, coalesce(max(mass), 0) AS top FROM (SELECT DISTINCT perm_id FROM s WHERE perm_id > 0) LEFT JOIN g USING (perm_id) GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY start) - 1 AS INTEGER) AS cluster, start, stop AS "end", round(mass, 5) AS mass, round((SELECT count(*) FILTER (top >= mass) + 1 FROM top) / ((SELECT count(*) FROM top) + 1), 6) AS p FROM g WHERE perm_id = 0""")
def cluster_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters over the hours of the day against permuted units: does the number of a user's events go with the mean
    value in that hour?"""
    s = _hour_stats(spark, sf_dir, 50).withColumnRenamed("t", "stat")
    return T.cluster_p_values(s).select("cluster", "start", "end", *_r("mass", digits=5), *_r("p"))


#: Permutations of the map queries: the 95 % quantile of so many falls between two of them.
MAP_PERMS = 30


def _map_sql(axes: str, cells: str, touch: str, how: str) -> str:
    """Clusters of signed correlation maps, by recursion over touching cells. axes: columns of a cell; cells: the query of
    (unit_id, axes, x, y) pairs as s (permuted outcome) and d; touch: whether cells a and b touch."""
    cell = axes.replace(" ", "").split(",")
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cell)
    passed = f"""v AS (SELECT perm_id, {axes}, stat AS value FROM s JOIN (SELECT {axes}, quantile_cont(stat, 0.95) AS l FROM s GROUP BY {axes}) USING ({axes}) WHERE stat >= l AND stat > 0)"""
    if how == "z":
        passed = f"""v AS (SELECT perm_id, {axes}, (stat - m) / sd AS value FROM s JOIN (SELECT {axes}, avg(stat) AS m, stddev_pop(stat) AS sd FROM s GROUP BY {axes}) USING ({axes}) WHERE sd > 0 AND (stat - m) / sd >= 1.6448536269514722)"""
    return f"""WITH RECURSIVE units AS (SELECT user_id AS unit_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS b FROM events GROUP BY 1),
u AS (SELECT unit_id, CAST(perm_id AS INTEGER) AS perm_id FROM units, (SELECT unnest(range(0, {MAP_PERMS})) AS perm_id)),
a AS (SELECT perm_id, unit_id AS dst, row_number() OVER (PARTITION BY perm_id ORDER BY unit_id) AS place FROM u),
b AS (SELECT perm_id, unit_id AS src, row_number() OVER (PARTITION BY perm_id ORDER BY {_KEY}, unit_id) AS place FROM u),
{cells},
s AS (SELECT perm_id, {axes}, r * sqrt((k - 2) / (1 - r * r)) AS stat FROM c WHERE k > 2 AND r IS NOT NULL AND NOT isnan(r) AND abs(r) < 1),
{passed},
id AS (SELECT *, row_number() OVER (ORDER BY perm_id, {axes}) AS i FROM v),
e AS (SELECT a.i AS u, b.i AS w FROM id a JOIN id b ON a.perm_id = b.perm_id AND {touch}),
reach(i, r) AS (SELECT u, w FROM e UNION SELECT reach.i, e.w FROM reach JOIN e ON reach.r = e.u),
g AS (SELECT i, min(r) AS cl FROM reach GROUP BY i),
mm AS (SELECT perm_id, cl, sum(value) AS mass FROM id JOIN g USING (i) GROUP BY perm_id, cl),
top AS (SELECT perm_id, coalesce(max(mass), 0) AS top FROM (SELECT DISTINCT perm_id FROM s) LEFT JOIN mm USING (perm_id) GROUP BY perm_id),
l AS (SELECT quantile_cont(top, 0.95) AS l FROM top),
o AS (SELECT cl, mass, row_number() OVER (ORDER BY cl) - 1 AS number FROM mm WHERE perm_id = 0)
SELECT {axes}, round(value, 5) AS value, CAST(number AS INTEGER) AS cluster, round(mass, 4) AS mass, mass >= l AS kept,
  round((SELECT count(*) FILTER (top >= mass) + 1 FROM top WHERE perm_id > 0) / {MAP_PERMS}.0, 6) AS cluster_p
FROM id JOIN g USING (i) JOIN o USING (cl), l WHERE perm_id = 0"""


_DAY_CELLS = """m AS (SELECT user_id AS unit_id, CAST(hour(ts) AS INTEGER) AS tau, CAST(isodow(ts) - 1 AS INTEGER) AS day, avg(value) AS m FROM events GROUP BY 1, 2, 3),
c AS (SELECT perm_id, tau, day, count(*) AS k, corr(n, m) AS r FROM a JOIN b USING (perm_id, place) JOIN units ON units.unit_id = dst JOIN m ON m.unit_id = src GROUP BY 1, 2, 3)"""
_JOINT_CELLS = """m AS (SELECT user_id AS unit_id, CAST(hour(ts) AS INTEGER) AS tau, avg(value) AS m FROM events GROUP BY 1, 2),
c AS (SELECT perm_id, CAST(p AS INTEGER) AS p, tau, count(*) AS k, corr(CASE WHEN p = 0 THEN n ELSE b END, m) AS r FROM a JOIN b USING (perm_id, place) JOIN units ON units.unit_id = dst JOIN m ON m.unit_id = src, (SELECT unnest([0, 1]) AS p) GROUP BY 1, 2, 3)"""
_NEAR_DAY = "a.tau BETWEEN b.tau - 1 AND b.tau + 1 AND a.day BETWEEN b.day - 1 AND b.day + 1"
_NEAR_JOINT = "a.tau BETWEEN b.tau - 1 AND b.tau + 1 AND a.p BETWEEN b.p - 1 AND b.p + 1"


def _map_result(clusters: DataFrame, *axes: str) -> DataFrame:
    return clusters.select(*axes, *_r("value", digits=5), "cluster", *_r("mass", digits=4), "kept", *_r("cluster_p"))


def _day_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(perm_id, tau, day, t): does the number of a user's events go with the mean value in an hour of a weekday?"""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), F.hour("ts").alias("tau"), F.weekday("ts").alias("day"), "value")
    n = e.groupBy("unit_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # a user has few events in a cell: they are dealt once, by user
    m = e.repartition("unit_id").groupBy("unit_id", "tau", "day").agg(F.avg("value").alias("m"))
    # a unit without events in a cell still lends its number to others
    d = cut(n.select("unit_id", F.array("n").alias("d")))
    r = m.select("unit_id", "tau", "day", F.array("m").alias("r"))
    return T.fixed_predictor_stats(d, r, T.permutations(d, MAP_PERMS, SEED, carry=True), "tau", "day").where("n > 2").select("perm_id", "tau", "day", "t")


@query(_map_sql("tau, day", _DAY_CELLS, _NEAR_DAY, "raw"))
def cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters in two dimensions, by hour and weekday, of raw statistics."""
    return _map_result(clusters.cluster_correction(cut(_day_map(spark, sf_dir)), ("tau", "day"), "t"), "tau", "day")


@query(_map_sql("tau, day", _DAY_CELLS, _NEAR_DAY, "z"))
def cluster_map_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cluster_map, of statistics made z-scores of their cell."""
    return _map_result(clusters.cluster_correction(cut(_day_map(spark, sf_dir)), ("tau", "day"), "t", how="z"), "tau", "day")


@query(_map_sql("p, tau", _JOINT_CELLS, _NEAR_JOINT, "z"))
def cluster_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map of two predictors (a user's events and purchases) by hour."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), F.hour("ts").alias("tau"), "value", "event_type")
    n = e.groupBy("unit_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("event_type") == "purchase").cast("double").alias("b"))
    m = e.groupBy("unit_id", "tau").agg(F.avg("value").alias("m"))
    d, r = cut(n.select("unit_id", F.array("n", "b").alias("d"))), m.select("unit_id", "tau", F.array("m").alias("r"))
    s = T.fixed_predictor_stats(d, r, T.permutations(d, MAP_PERMS, SEED, carry=True), "tau").where("n > 2").select("perm_id", "p", "tau", "t")
    return _map_result(clusters.cluster_correction(cut(s), ("p", "tau"), "t", how="z"), "p", "tau")


@query(f"WITH {S.STATES} SELECT state, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{round(q * 1000)}" for q in (0.0, 0.025, 0.5, 0.975, 1.0)) + " FROM path GROUP BY 1")
def state_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the signal in each state."""
    at = (0.0, 0.025, 0.5, 0.975, 1.0)
    q = quantiles.quantiles(V.state_sequence(spark, sf_dir), "value", at, "state")
    return q.select("state", "n", *(F.round(F.col("quantiles")[i], 6).alias(f"q{round(p * 1000)}") for i, p in enumerate(at)))


@query(f"WITH {_HOURS} SELECT tau % 3 AS part, round(exp(avg(ln(greatest(p, 1e-15)))), 6) AS p FROM pv GROUP BY 1")
def combine_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.combined_p(_hours(spark, sf_dir).withColumn("part", F.col("tau") % 3), "p", "part").select("part", *_r("p"))


# Spectra


@query()
def state_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _z(spark, sf_dir)
    y = z.withColumn("y", F.array(F.col("y")[0], F.col("y")[0] * F.col("y")[0]))
    return spectral.state_spectra(y, V.soft_gamma(V.sequence(spark, sf_dir)), fs=100.0, window=32, half_bandwidth=2.0, tapers=3)


_PSD = "psd AS (SELECT user_id AS session_id, CAST(event_id % 45 AS DOUBLE) AS f, avg(value) AS power FROM events GROUP BY 1, 2)"


@query(f"WITH {_PSD}, b AS (SELECT * FROM (VALUES ('delta', 1.0, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 12.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 44.0)) t(band, lo, hi)) SELECT session_id, band, round(avg(power), 6) AS power FROM psd JOIN b ON f BETWEEN lo AND hi GROUP BY 1, 2")
def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    psd = e.groupBy(F.col("user_id").alias("session_id"), (F.col("event_id") % 45).cast("double").alias("f")).agg(F.avg("value").alias("power"))
    return spectral.band_power(psd, "session_id").select("session_id", "band", *_r("power"))


@query("""WITH c AS (SELECT CAST(l_linenumber AS INTEGER) AS f, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) / 1000 AS y FROM lineitem),
s AS (SELECT f, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM c GROUP BY 1) SELECT f, round(xy * xy / (xx * yy), 6) AS coherence FROM s""")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of two channels from their cross spectra (here real sums of products stand in for them)."""
    li = V.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("f"), F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    cross = li.select("f", F.posexplode("y").alias("i", "a"), "y").select("f", "i", "a", F.posexplode("y").alias("j", "b")).groupBy("f", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("re"), F.lit(0.0).alias("im"))
    return spectral.coherence(cross, "f").where("i < j").select("f", *_r("coherence"))


# Prediction


@query()
def fisher_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .series import fixed_model

    return predict.kernel(predict.fisher_scores(_z(spark, sf_dir), fixed_model()))


@query()
def cv_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated prediction of the first coordinate from the others."""
    e = _emb(spark, sf_dir)
    u = e.select(F.col("t").alias("unit_id"), F.expr("slice(y, 2, size(y) - 1)").alias("features"), F.col("y")[0].alias("target"), (F.col("t") % 7).alias("family"))
    return predict.cross_validate(u, folds=5, group="family")


@query()
def cv_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir)
    u = e.select(F.col("t").alias("unit_id"), F.col("y").alias("features"), (F.col("label") % 2).cast("double").alias("target"))
    return predict.cross_validate(u, folds=3, classify=True)


# Model selection, exchangeability, factors, confounds


@query()
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free energy and similarity over numbers of states: 3 to 8, five runs each, each the best of its starts and trained until it
    converges (100 cycles at most)."""
    from ..operators import hmm

    return hmm.selection(hmm.sweep(_z(spark, sf_dir), list(range(3, 9)), 5, hmm.Spec(3, "diag", "state", "no")))


_NODE = f"CASE WHEN perm_id = 0 THEN '' ELSE md5('{SEED}:' || perm_id || ':' || path) END"


_TREE = f"""n AS (SELECT n_nationkey AS u, n_regionkey + 1 AS b, '/' || (n_regionkey + 1) || '/' || n_nationkey AS path FROM nation),
z AS (SELECT perm_id, b, '/' || b AS path, size FROM (SELECT b, count(*) AS size FROM n GROUP BY 1), (SELECT CAST(unnest(range(0, {PERMS})) AS INTEGER) AS perm_id)),
da AS (SELECT perm_id, b AS db, size, row_number() OVER (PARTITION BY perm_id, size ORDER BY b) AS place FROM z),
sa AS (SELECT perm_id, b AS sb, size, row_number() OVER (PARTITION BY perm_id, size ORDER BY {_NODE}, b) AS place FROM z),
m AS (SELECT perm_id, db, sb FROM da JOIN sa USING (perm_id, size, place)),
du AS (SELECT perm_id, db, u AS dst, row_number() OVER (PARTITION BY perm_id, db ORDER BY u) AS place FROM m JOIN n ON b = db),
su AS (SELECT perm_id, db, u AS src, row_number() OVER (PARTITION BY perm_id, db ORDER BY {_NODE}, u) AS place FROM m JOIN n ON b = sb)"""


@query(f"WITH {_TREE} SELECT perm_id, dst, src FROM du JOIN su USING (perm_id, db, place)")
def tree_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffles of nations that keep regions whole: regions of one size change places, nations inside them too."""
    n = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit_id"), (F.col("n_regionkey") + 1).alias("region"))
    return T.tree_permutations(n, ["region"], PERMS, SEED)


@query(f"""WITH {_TREE}, x AS (SELECT c_nationkey AS u, CAST(count(*) AS DOUBLE) AS d, avg(CAST(c_acctbal AS DOUBLE)) AS r FROM customer GROUP BY 1),
c AS (SELECT perm_id, count(*) AS k, corr(a.d, b.r) AS r FROM du JOIN su USING (perm_id, db, place) JOIN x a ON a.u = dst JOIN x b ON b.u = src GROUP BY 1),
s AS (SELECT perm_id, r * sqrt((k - 2) / (1 - r * r)) AS t FROM c), o AS (SELECT t AS o FROM s WHERE perm_id = 0)
SELECT round(any_value(o), 5) AS observed, round(avg(CASE WHEN abs(t) >= abs(o) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS p FROM s, o""")
def tree_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a nation's number of customers go with their mean balance, with shuffles that keep regions whole?"""
    n = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit_id"), (F.col("n_regionkey") + 1).alias("region"))
    c = V.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("unit_id"))
    c = c.agg(F.array(F.count(F.lit(1)).cast("double")).alias("d"), F.array(F.avg(F.col("c_acctbal").cast("double"))).alias("r"))
    out = T.across_units(n.join(c, "unit_id"), PERMS, how="tree", levels=("region",), seed=SEED, chunk=7)
    return out.toDF("predictor", "q", "observed", "pv").select(F.round("observed", 5).alias("observed"), F.round("pv", 6).alias("p"))


_MONTHS = """x AS (SELECT month(o_orderdate) - 1 AS u, CAST(count(*) AS DOUBLE) AS d, avg(CAST(o_totalprice AS DOUBLE)) AS r FROM orders GROUP BY 1),
b2 AS (SELECT unnest([0, 1]) AS s), i3 AS (SELECT unnest([0, 1, 2]) AS i),
p3 AS (SELECT [a.i, b.i, c.i] AS p FROM i3 a, i3 b, i3 c WHERE a.i <> b.i AND b.i <> c.i AND a.i <> c.i),
s AS (SELECT h.s AS h, [q.s, v.s] AS q, [e.p, f.p, g.p, k.p] AS p, row_number() OVER (ORDER BY h.s, q.s, v.s, e.p, f.p, g.p, k.p) AS id
  FROM b2 h, b2 q, b2 v, p3 e, p3 f, p3 g, p3 k),
m AS (SELECT id, u AS dst, 6 * xor(u // 6, h) + 3 * xor((u // 3) % 2, q[u // 6 + 1]) + p[u // 3 + 1][u % 3 + 1] AS src FROM s, x)"""


@query(f"""WITH {_MONTHS}, c AS (SELECT id, count(*) AS k, corr(a.d, b.r) AS r FROM m JOIN x a ON a.u = dst JOIN x b ON b.u = src GROUP BY 1),
t AS (SELECT id, r * sqrt((k - 2) / (1 - r * r)) AS t FROM c), o AS (SELECT t AS o FROM t WHERE id = 1)
SELECT count(*) AS shuffles, round(any_value(o), 5) AS observed, CAST(sum(CASE WHEN abs(t) >= abs(o) - 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS extreme,
  round(min(t), 5) AS lowest, round(max(t), 5) AS highest, round(stddev_pop(t), 6) AS spread FROM t, o""")
def exact_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a month's number of orders go with their mean price? All shuffles of months in quarters in halves of a year."""
    month = F.month("o_orderdate").cast("int")
    o = V.table(spark, sf_dir, "orders").groupBy(month.alias("unit_id"))
    o = cut(o.agg(F.count(F.lit(1)).cast("double").alias("d"), F.avg(F.col("o_totalprice").cast("double")).alias("r")))
    u = o.select("unit_id", F.ceil(F.col("unit_id") / 6).cast("int").alias("half"), F.ceil(F.col("unit_id") / 3).cast("int").alias("quarter"), F.array("d").alias("d"), F.array("r").alias("r"))
    s = cut(T.correlation_stats(u, exchange.every_shuffle(u, ["half", "quarter"])).select("perm_id", "t"))
    s = s.crossJoin(F.broadcast(s.where("perm_id = 0").select(F.col("t").alias("o"))))
    extreme = F.sum(F.when(F.abs("t") >= F.abs("o") - 1e-9, 1).otherwise(0)).cast("long")
    return s.agg(F.count(F.lit(1)).alias("shuffles"), F.round(F.max("o"), 5).alias("observed"), extreme.alias("extreme"), F.round(F.min("t"), 5).alias("lowest"), F.round(F.max("t"), 5).alias("highest"), F.round(F.stddev_pop("t"), 6).alias("spread"))


@query("""WITH c AS (SELECT n_regionkey AS r, n_nationkey AS n, count(*) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
g AS (SELECT r, k, count(*) AS m FROM c GROUP BY 1, 2), h AS (SELECT shape, count(*) AS m FROM (SELECT r, list(k || ':' || m ORDER BY k) AS shape FROM g GROUP BY 1) GROUP BY 1)
SELECT round((SELECT sum(lgamma(k + 1)) FROM c) + (SELECT sum(lgamma(m + 1)) FROM g) + (SELECT sum(lgamma(m + 1)) FROM h), 4) AS log_shuffles""")
def shuffle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shuffles of customers in nations in regions there are: blocks of one make-up change places."""
    n = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") + 1).alias("nation"), (F.col("n_regionkey") + 1).alias("region"))
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"), "c_nationkey").join(n, "c_nationkey")
    return spark.createDataFrame([(round(exchange.log_shuffles(c, ["region", "nation"]), 4),)], "log_shuffles double")


@query(f"""WITH x AS (SELECT CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS u, o_totalprice FROM orders),
v AS (SELECT u, CAST(count(*) AS DOUBLE) AS d, avg(CAST(o_totalprice AS DOUBLE)) AS r FROM x GROUP BY 1), i AS (SELECT u FROM v),
o AS (SELECT [a.u, b.u, c.u, d.u, e.u] AS p FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.u, b.u, c.u, d.u, e.u])) = 5),
k AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS number FROM o),
s AS (SELECT p, number FROM k ORDER BY CASE WHEN number = 0 THEN '' ELSE md5('{SEED}:' || number) END, number LIMIT 60),
c AS (SELECT number, count(*) AS k, corr(a.d, b.r) AS r FROM s JOIN v a ON true JOIN v b ON b.u = p[a.u] GROUP BY 1),
t AS (SELECT number, r * sqrt((k - 2) / (1 - r * r)) AS t FROM c), z AS (SELECT t AS o FROM t WHERE number = 0)
SELECT round(any_value(o), 5) AS observed, round(avg(CASE WHEN abs(t) >= abs(o) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS p FROM t, z""")
def distinct_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a priority's number of orders go with their mean price? 60 different shuffles of the five priorities."""
    o = V.coded(V.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("d"), F.avg(F.col("o_totalprice").cast("double")).alias("r")), "o_orderpriority", "unit_id")
    out = T.across_units(cut(o.select("unit_id", F.array("d").alias("d"), F.array("r").alias("r"))), 60, how="distinct", seed=SEED)
    return out.toDF("predictor", "q", "observed", "pv").select(F.round("observed", 5).alias("observed"), F.round("pv", 6).alias("p"))


@query()
def nmf_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency factors of the coherence of all channels of the embeddings."""
    e = _emb(spark, sf_dir).withColumn("session_id", F.col("label") % 2)
    c = spectral.coherence(spectral.state_spectra(V.renumber_rows(e), None, 100.0, 16, 2.0, 3), "session_id", "state", "f")
    return spectral.factorise(c, 2)[0]


@query(f"WITH {_UNITS}, m AS (SELECT avg(total) AS my, avg(n) AS mx, regr_slope(total, n) AS b FROM units) SELECT unit_id, round(total - my - b * (n - mx), 2) + 0.0 AS r FROM units, m")
def deconfounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir).withColumn("c", F.slice("d", 1, 1))
    return T.deconfound(u, "r", "c").select("unit_id", (F.round(F.col("r")[0], 2) + 0.0).alias("r"))


@query("WITH f AS (SELECT session_id, (row_number() OVER (ORDER BY session_id) - 1) % 5 AS fold FROM (SELECT DISTINCT user_id AS session_id FROM events)) SELECT session_id, CAST(fold AS INTEGER) AS fold FROM f")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"))
    return predict.folds_of(u.distinct(), 5, "session_id").select("session_id", "fold")


@query(f"""WITH {S.STATES}, r AS (SELECT session_id, t, state, row_number() OVER (PARTITION BY session_id ORDER BY md5('{SEED}:' || session_id || ':' || t), t) % 2 = 1 AS train FROM path)
SELECT session_id, t, train FROM r""")
def split_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.state_sequence(spark, sf_dir).withColumn("unit_id", F.col("t"))
    return T.session_halves(p, SEED).select("session_id", "t", "train")


@query()
def split_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).select(F.col("t").alias("unit_id"), F.expr("slice(y, 2, size(y) - 1)").alias("features"), F.col("y")[0].alias("target"))
    return predict.split_predict(e.where("unit_id % 2 = 0"), e.where("unit_id % 2 = 1"))


@query()
def split_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb(spark, sf_dir).select(F.col("t").alias("unit_id"), F.col("y").alias("features"), (F.col("label") % 2).cast("double").alias("target"))
    return predict.split_classify(e.where("unit_id % 2 = 0"), e.where("unit_id % 2 = 1"))
