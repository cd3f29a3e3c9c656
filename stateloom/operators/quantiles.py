"""Exact quantiles of groups of any size, by selection in repeated range histograms.

A target is an order statistic of a group. Each round counts the values of all groups in equal ranges between the
smallest and the largest value that may still be a target, as one aggregation with map-side sums, and keeps the range where
the target falls. When a range holds few values, those are ranked. So no task gathers a group: what moves is a row for
each range of a target, and at the end `FEW` values of it. Groups that are small from the start need no rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Ranges of a histogram, and values that one task may rank.
RANGES, FEW = 256, 4096
_LARGEST = 1.7976931348623157e308


def _join(left: DataFrame, right: DataFrame, ks: list[str], more: Column | None = None, how: str = "inner") -> DataFrame:
    """Joins on keys that may be null; the right side's keys are named r_. Without keys the right side has a row for each
    target at most."""
    r = right.select(*(F.col(k).alias(f"r_{k}") for k in ks), *(c for c in right.columns if c not in ks))
    on = F.lit(True) if more is None else more
    for k in ks:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return left.join(r if ks else F.broadcast(r), on, how).drop(*(f"r_{k}" for k in ks))


def quantiles(rows: DataFrame, value: Column | str, probabilities: Sequence[float], *keys: str) -> DataFrame:
    """(keys, n, quantiles): the number of values and an array with the quantile of each probability, interpolated between
    neighbours (of n values in order, place (n - 1) * probability from 0). Nulls and NaN are left out; a group without any
    value has n = 0 and nulls. Null keys are a group. Infinite values are ordered as numbers."""
    if not probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities are between 0 and 1")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    ks = [f"k{i}" for i in range(len(keys))]
    data = rows.select(*(F.col(k).alias(name) for k, name in zip(keys, ks)), F.when(v.isNotNull() & ~F.isnan(v), v).alias("v"))
    # a row for each group
    groups = cut(data.groupBy(*ks).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    small, large = groups.where(F.col("n") <= FEW), groups.where(F.col("n") > FEW)
    parts, any_large = [], bool(large.limit(1).count())
    if not any_large or small.limit(1).count():
        few = _join(data, small.select(*ks, "n"), ks) if any_large else data
        parts.append(few.groupBy(*ks).agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, map(float, probabilities)))).alias("quantiles")))
    if any_large:
        parts.append(_of_large(cut(data.where("v is not null")), large, probabilities, ks))
    out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    nothing = F.array(*(F.lit(None).cast("double") for _ in probabilities))
    return out.select(*(F.col(k).alias(name) for k, name in zip(ks, keys)), "n", F.coalesce("quantiles", nothing).alias("quantiles"))


def _of_large(data: DataFrame, groups: DataFrame, probabilities: Sequence[float], ks: list[str]) -> DataFrame:
    place = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for i, p in enumerate(probabilities)))
    asked = groups.select(*ks, "n", "lo", "hi", F.explode(place).alias("a")).select("*", "a.i", "a.place")
    asked = asked.withColumn("low", F.floor("place")).withColumn("share", F.col("place") - F.col("low"))
    asked = asked.withColumn("rank", F.explode(F.array_distinct(F.array("low", F.ceil("place")))))
    targets = asked.groupBy(*ks, "rank").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("count"))
    found = order_statistics(data, targets.withColumn("below", F.lit(0).cast("long")), ks)
    both = _join(asked.select(*ks, "n", "i", "share", F.col("rank").alias("at")), found, ks, F.col("at") == F.col("rank"))
    ends = both.groupBy(*ks, "n", "i").agg(F.first("share").alias("share"), F.min_by("x", "rank").alias("x0"), F.max_by("x", "rank").alias("x1"))
    q = F.when((F.col("share") == 0) | (F.col("x0") == F.col("x1")), F.col("x0")).otherwise((1 - F.col("share")) * F.col("x0") + F.col("share") * F.col("x1"))
    listed = F.array_sort(F.collect_list(F.struct("i", q.alias("q"))))  # one for each probability
    return ends.groupBy(*ks, "n").agg(F.transform(listed, lambda s: s["q"]).alias("quantiles"))


def order_statistics(data: DataFrame, targets: DataFrame, ks: list[str]) -> DataFrame:
    """(keys, rank, x): the values v of the given ranks, from 0. targets: keys, rank, the smallest and largest value lo and
    hi that it may be, the count of values from lo to hi, and how many are below."""
    found, pending, clamp = [], cut(targets), lambda c: F.greatest(F.least(c, F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2
    ranks = []
    while True:
        found.append(pending.where("lo = hi").select(*ks, "rank", F.col("lo").alias("x")))
        ranks.append(pending.where((F.col("lo") < F.col("hi")) & (F.col("count") <= FEW)))
        pending = pending.where((F.col("lo") < F.col("hi")) & (F.col("count") > FEW))
        if not pending.limit(1).count():
            break
        inside = _join(data, pending.select(*ks, "rank", "lo", "hi", "below"), ks, F.col("v").between(F.col("lo"), F.col("hi")))
        lo, hi = clamp(F.col("lo")), clamp(F.col("hi"))
        share = (clamp(F.col("v")) - lo) / (hi - lo) * RANGES
        # where the ends can't be told apart so, the smallest value parts from the others
        at = F.when((hi - lo) / RANGES > 0, F.least(F.floor(share), F.lit(RANGES - 1))).otherwise((F.col("v") > F.col("lo")).cast("long"))
        counts = inside.groupBy(*ks, "rank", "below", at.alias("range")).agg(F.count("v").alias("count"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("count").over(Window.partitionBy(*ks, "rank").orderBy("range"))
        here = counts.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("count"))
        pending = cut(here.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("upto"))).select(*ks, "rank", "lo", "hi", "count", "below"))
    last = ranks[0]
    for r in ranks[1:]:
        last = last.unionByName(r)
    near = _join(data, last.select(*ks, "rank", "lo", "hi", "below"), ks, F.col("v").between(F.col("lo"), F.col("hi")))
    order = F.row_number().over(Window.partitionBy(*ks, "rank").orderBy("v"))
    found.append(near.withColumn("place", order - 1 + F.col("below")).where("place = rank").select(*ks, "rank", F.col("v").alias("x")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
