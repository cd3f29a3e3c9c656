"""Cluster correction of maps of any number of dimensions (time, or time by predictor, hour by weekday, ...).

A map is a table (perm_id, axes, stat), a row for each cell; axes are columns of whole numbers. Cells that pass a threshold
and touch, diagonally too, are a cluster. All permutations' maps are labelled at once: neighbouring cells along the last
axis are runs, found by a window; runs that touch across the other axes are edges; clusters are components of the
runs. A cluster's mass is judged by the largest mass of each permutation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..plans.lineage import cut
from . import graph, quantiles


def runs(cells: DataFrame, axes: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, all axes but the last, start, end, mass, run): neighbouring cells along the last axis, with the sum of their
    value; run is a number of its own for each."""
    *others, last = axes
    w = Window.partitionBy(*keys, *others).orderBy(last)
    at = cells.withColumn("_run", F.col(last) - F.row_number().over(w))
    found = at.groupBy(*keys, *others, "_run").agg(F.min(last).alias("start"), F.max(last).alias("end"), F.sum("value").alias("mass")).drop("_run")
    return cut(found).withColumn("run", F.monotonically_increasing_id())


def labelled_runs(cells: DataFrame, axes: tuple[str, ...], *keys: str) -> DataFrame:
    """Runs with their cluster, the smallest run number in it. cells: keys, axes and value, those above a threshold."""
    *others, last = axes
    r = cut(runs(cells, axes, *keys))
    if not others:
        return r.withColumn("cluster", F.col("run"))
    # each run looks at the rows beside it: steps of -1, 0 and 1 along the other axes
    step = F.sequence(F.lit(-1), F.lit(1))
    a = r.select(*keys, *others, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("run").alias("u"))
    for o in others:
        a = a.withColumn("_d", F.explode(step)).withColumn(o, F.col(o) + F.col("_d")).drop("_d")
    b = r.select(*keys, *others, "start", "end", F.col("run").alias("v"))
    near = _join(a, b, [*keys, *others]).where((F.col("start") <= F.col("_e") + 1) & (F.col("_s") <= F.col("end") + 1))
    labels = graph.components(near.where("u < v").select("u", "v")).withColumnRenamed("id", "run")
    return r.join(labels, "run", "left").withColumn("cluster", F.coalesce("component", "run")).drop("component")


def _join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns of which keys may be null."""
    b = b.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in b.columns))
    return a.join(b, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))).drop(*(f"_r_{c}" for c in on))


def thresholded(stats: DataFrame, axes: tuple[str, ...], stat: str, alpha: float, how: str, *keys: str) -> DataFrame:
    """(perm_id, keys, axes, value): cells that pass. raw: the statistic, where it is above 0 and reaches its cell's (1 -
    alpha) quantile over all permutations, the identity included. z: the statistic less its cell's mean, over its
    standard deviation, where that reaches the normal quantile of 1 - alpha; cells that don't vary never pass."""
    cell = [*keys, *axes]
    s = stats.select("perm_id", *cell, F.col(stat).cast("double").alias("value")).where("value is not null and not isnan(value)")
    if how == "raw":
        limits = quantiles.quantiles(s, "value", [1 - alpha], *cell).withColumn("limit", F.col("quantiles")[0]).drop("n", "quantiles")
        return _join(s, limits, cell).where((F.col("value") >= F.col("limit")) & (F.col("value") > 0)).drop("limit")
    if how != "z":
        raise ValueError("how is raw or z")
    spread = s.groupBy(*cell).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).where("sd > 0")
    z = _join(s, spread, cell).withColumn("value", (F.col("value") - F.col("m")) / F.col("sd")).drop("m", "sd")
    return z.where(F.col("value") >= special.normal_ppf(1 - alpha))


def cluster_correction(stats: DataFrame, axes: tuple[str, ...] = ("tau",), stat: str = "stat", alpha: float = 0.05, how: str = "raw", *keys: str) -> DataFrame:
    """(keys, axes, value, cluster, mass, limit, kept, cluster_p): a row for each observed cell that passes its threshold. mass is its
    cluster's sum, limit the (1 - alpha) quantile of the largest mass of each permutation, the identity included (0 for
    one without clusters); kept says whether mass reaches it; cluster_p is (permutations but the identity whose largest mass
    reaches mass, + 1) / (their number + 1). cluster is a number from 0 by each cluster's first cell.

    Keys part maps of their own, such as predictors; a predictor among the axes makes one joint map. Null and NaN
    statistics are no cells. An empty table gives no rows."""
    passed = cut(thresholded(stats, axes, stat, alpha, how, *keys))
    found = cut(labelled_runs(passed, axes, "perm_id", *keys))
    masses = found.groupBy("perm_id", *keys, "cluster").agg(F.sum("mass").alias("mass"))
    largest = masses.groupBy("perm_id", *keys).agg(F.max("mass").alias("top"))
    maps = stats.where(F.col(stat).isNotNull() & ~F.isnan(F.col(stat).cast("double"))).select("perm_id", *keys).distinct()
    m = largest.select(*(F.col(c).alias(f"_m_{c}") for c in ("perm_id", *keys)), "top")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in ("perm_id", *keys)))
    tops = cut(maps.join(m, same, "left").select("perm_id", *keys, F.coalesce("top", F.lit(0.0)).alias("top")))
    limits = quantiles.quantiles(tops, "top", [1 - alpha], *keys).withColumn("limit", F.col("quantiles")[0]).drop("n", "quantiles")
    seen = masses.where("perm_id = 0").drop("perm_id")
    seen = _join(seen, limits, list(keys)) if keys else seen.crossJoin(F.broadcast(limits))  # one row
    # the largest masses (one for each permutation) and the observed ones in one order: how many of the first reach each of
    # the second
    line = tops.where("perm_id > 0").select(*keys, F.col("top").alias("mass"), F.lit(None).cast("long").alias("cluster"), F.lit(1).alias("of_null"))
    line = line.unionByName(seen.select(*keys, "mass", "cluster", F.lit(0).alias("of_null")))
    w = Window.partitionBy(*keys)
    reached = F.sum("of_null").over(w.orderBy(F.desc("mass")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    p = line.withColumn("cluster_p", (reached + 1) / (F.sum("of_null").over(w) + 1)).where("of_null = 0").drop("of_null", "mass")
    judged = _join(seen, p, [*keys, "cluster"])
    observed = found.where("perm_id = 0").drop("perm_id", "mass", "run")
    first = observed.groupBy(*keys, "cluster").agg(F.min(F.struct(*(F.col(o) for o in axes[:-1]), "start")).alias("first"))
    named = first.withColumn("number", (F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).cast("int")).drop("first")
    cells = observed.withColumn(axes[-1], F.explode(F.sequence("start", "end"))).drop("start", "end")
    rows = _join(_join(cells, judged, [*keys, "cluster"]), named, [*keys, "cluster"]).drop("cluster").withColumnRenamed("number", "cluster")
    values = passed.where("perm_id = 0").drop("perm_id")
    return _join(values, rows, [*keys, *axes]).select(*keys, *axes, "value", "cluster", "mass", "limit", (F.col("mass") >= F.col("limit")).alias("kept"), "cluster_p")


def corrected_p(clusters: DataFrame, cells: DataFrame, p: str | None = None, axes: tuple[str, ...] = ("tau",), *keys: str) -> DataFrame:
    """(keys, axes, q): for every cell of a table of them, its own p (column p of cells, or the normal tail of the cluster
    table's value) where its cluster is kept, else 1."""
    kept = clusters.where("kept").select(*(F.col(c).alias(f"_c_{c}") for c in (*keys, *axes)), "value")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in (*keys, *axes)))
    j = cells.join(kept, same, "left")

    @F.pandas_udf("double")
    def tail(z):
        return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)))

    own = F.col(p) if p else tail("value")
    return j.select(*keys, *axes, F.when(F.col("value").isNotNull(), own).otherwise(1.0).alias("q"))
