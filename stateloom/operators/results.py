"""Results of tests: stepwise corrections, p-values of further kinds, percentiles of null distributions, summaries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import quantiles

#: Rows that a range of sorted p-values should hold.
RANGE_ROWS = 200_000


def _harmonic(n: int) -> float:
    return float((1 / np.arange(1, n + 1)).sum()) if n < 1_000_000 else math.log(n) + np.euler_gamma + 1 / (2 * n)


# A method: the value of the r-th smallest of n p-values, and where its running extreme comes from: the smallest over
# larger p-values, the largest over smaller ones, or none
METHODS = {
    "bonferroni": (lambda p, r, n: p * n, None),
    "sidak": (lambda p, r, n: 1 - F.pow(1 - p, F.lit(float(n))), None),
    "holm": (lambda p, r, n: p * (n - r + 1), "smaller"),
    "holm-sidak": (lambda p, r, n: 1 - F.pow(1 - p, n - r + 1), "smaller"),
    "simes-hochberg": (lambda p, r, n: p * (n - r + 1), "larger"),
    "fdr_bh": (lambda p, r, n: p * n / r, "larger"),
    "fdr_by": (lambda p, r, n: p * n * _harmonic(n) / r, "larger"),
}


def corrected(p: DataFrame, method: str = "fdr_bh", column: str = "p") -> DataFrame:
    """Adds q, the corrected p-value by a method of METHODS, over all rows that have a p; others are left out.

    Rows are sorted by ranges of p; ranks and running extremes are taken inside a range and offset by those of the
    ranges, a row each, so no task holds all tests. Equal p-values get equal q."""
    if method not in METHODS:
        raise ValueError(f"method is one of {sorted(METHODS)}")
    value, side = METHODS[method]
    known = p.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    n = known.count()
    if side is None:
        return known.withColumn("q", F.least(F.lit(1.0), value(F.col(column), None, n)))
    parts = max(1, -(-n // RANGE_ROWS))
    ranged = cut(known.repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id()))
    by_part = Window.orderBy("_part")  # a row for each range
    before = F.coalesce(F.sum("_c").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).select("_part", before.alias("_before"))
    inside = Window.partitionBy("_part").orderBy(column)
    ranked = ranged.join(F.broadcast(sizes), "_part").withColumn("_r", F.col("_before") + F.row_number().over(inside))
    ranked = cut(ranked.withColumn("_v", value(F.col(column), F.col("_r"), n)))
    best, frame, rows = (
        (F.min, by_part.rowsBetween(1, Window.unboundedFollowing), (Window.currentRow, Window.unboundedFollowing))
        if side == "larger"
        else (F.max, by_part.rowsBetween(Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.currentRow))
    )
    others = ranked.groupBy("_part").agg(best("_v").alias("_b")).select("_part", best("_b").over(frame).alias("_b"))
    own = best("_v").over(Window.partitionBy("_part").orderBy("_r").rowsBetween(*rows))
    pick = F.least if side == "larger" else F.greatest
    out = ranked.join(F.broadcast(others), "_part").withColumn("q", F.least(F.lit(1.0), pick(own, F.col("_b"))))
    return out.select(*known.columns, "q")


def _nulls(stats: DataFrame, stat: str, *keys: str) -> DataFrame:
    """(keys, observed, nulls): the statistic of perm_id 0, and the array of all others'; one value for a permutation."""
    v = F.col(stat)
    return stats.groupBy(*keys).agg(F.max(F.when(F.col("perm_id") == 0, v)).alias("observed"), F.collect_list(F.when(F.col("perm_id") > 0, v)).alias("nulls"))


def null_summary(stats: DataFrame, stat: str, *keys: str, absolute: bool = True) -> DataFrame:
    """(keys, observed, p, lower, upper): p is the share of permutations, the identity included, that reach the observed
    statistic (its absolute value for t, plain for F); lower and upper are the 2.5 and 97.5 percentiles without it."""
    stats = cut(stats.select("perm_id", *keys, stat))
    v = F.abs(stat) if absolute else F.col(stat)
    at = F.max(F.when(F.col("perm_id") == 0, v)).over(Window.partitionBy(*keys))
    s = stats.withColumn("_reached", (v >= at).cast("double"))
    null = F.when(F.col("perm_id") > 0, F.col(stat))
    limits = quantiles.quantiles(stats, null, [0.025, 0.975], *keys)
    limits = limits.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("quantiles")[0].alias("lower"), F.col("quantiles")[1].alias("upper"))
    told = s.groupBy(*keys).agg(F.max(F.when(F.col("perm_id") == 0, F.col(stat))).alias("observed"), F.avg("_reached").alias("p"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    # without keys a row each
    return told.join(limits if keys else F.broadcast(limits), on).drop(*(f"_{k}" for k in keys))


def mirrored_p(stats: DataFrame, stat: str, a: str = "state_a", b: str = "state_b", *keys: str) -> DataFrame:
    """(keys, a, b, observed, p) for both orders of each pair: the one-sided p is the number of permutations, the
    identity included, that reach the observed difference, over their number and one; the other order has 1 - p."""
    n = _nulls(stats, stat, *keys, a, b)
    reached = F.size(F.filter("nulls", lambda x: x >= F.col("observed"))) + 1
    one = n.select(*keys, a, b, "observed", (reached / (F.size("nulls") + 2)).alias("p"))
    return one.unionByName(one.select(*keys, F.col(b).alias(a), F.col(a).alias(b), (-F.col("observed")).alias("observed"), (1 - F.col("p")).alias("p")))


def mean_p(p: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, p): plain mean of the p-values that there are."""
    return p.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(*keys).agg(F.avg(column).alias("p"))


def inverse_fisher_z(z: Column | str) -> Column:
    """The correlation of a Fisher z."""
    return F.tanh(z)


def summary_of_tests(p: DataFrame, *keys: str, column: str = "p", alpha: float = 0.05) -> DataFrame:
    """(keys, tests, missing, significant, least, mean): one row for each group of tests."""
    v = F.col(column).cast("double")
    there = v.isNotNull() & ~F.isnan(v)
    known = F.when(there, v)
    return p.groupBy(*keys).agg(F.count(known).alias("tests"), F.count_if(~there | v.isNull()).alias("missing"), F.count_if(known <= alpha).alias("significant"), F.min(known).alias("least"), F.avg(known).alias("mean"))


def named(results: DataFrame, predictors: list[str] | None = None, outcomes: list[str] | None = None) -> DataFrame:
    """Adds predictor and outcome: the names of the columns p (or, without it, all) and q; numbered names by default."""
    label = lambda names, c, word: F.coalesce(F.get(F.array(*map(F.lit, names)), F.col(c)), F.concat(F.lit(f"{word} "), (F.col(c) + 1).cast("string"))) if names else F.concat(F.lit(f"{word} "), (F.col(c) + 1).cast("string"))
    out = results
    if "predictor_id" in out.columns:
        out = out.withColumn("predictor", label(predictors, "predictor_id", "Predictor"))
    return out.withColumn("outcome", label(outcomes, "q", "Outcome")) if "q" in out.columns else out
