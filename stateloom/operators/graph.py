"""Connected components of edge lists, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id of an undirected edge list (u, v) of longs: the smallest id that it reaches. In a round an
    id takes the smallest label of its neighbours, its label's own id hears of it too, and labels jump to their label's
    label, so rounds grow with the logarithm of a chain's length. Rows with a null are left out."""
    e = edges.select("u", "v").where("u is not null and v is not null")
    both = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("c"), F.lit(True).alias("new")))
    while labels.where("new").limit(1).count():
        of = labels.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        heard = both.join(of, "v").groupBy("u").agg(F.min("cv").alias("cv"))
        told = heard.join(labels.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").where("cv < cu")
        offers = told.select(F.col("u").alias("id"), "cv").unionByName(told.select(F.col("cu").alias("id"), "cv"))
        best = offers.groupBy("id").agg(F.min("cv").alias("o"))
        hooked = labels.select("id", F.col("c").alias("old")).join(best, "id", "left").select("id", "old", F.least("old", "o").alias("c"))
        up = hooked.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        jumped = hooked.join(up, "c", "left").select("id", "old", F.least("c", "cc").alias("c"))
        labels = cut(jumped.select("id", "c", (F.col("c") < F.col("old")).alias("new")))
    return labels.select("id", F.col("c").alias("component"))
