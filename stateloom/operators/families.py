"""Families of twins and half-siblings as nested blocks for shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import graph

#: Levels of `family_blocks` for `testing.tree_permutations(..., whole=False)` and the functions of `exchange`.
LEVELS = ["type", "family", "sibship"]


def _sums(column: str):
    """A multiset of hashes as numbers that don't depend on its order."""
    return F.concat_ws(",", F.count(F.lit(1)), F.bit_xor(F.xxhash64(column)), F.sum(F.xxhash64(F.lit(1), column).cast("decimal(38,0)")))


def _refined(edges: DataFrame) -> DataFrame:
    """Colours (c) of sibships, told apart by those of the sibships that share their mother or father, and so on, in rounds
    of joins until no more colours appear."""
    known = edges.agg(F.count_distinct("family", "c")).first()[0]
    while True:
        m = edges.groupBy("m").agg(_sums("c").alias("cm"))
        f = edges.groupBy("f").agg(_sums("c").alias("cf"))
        edges = cut(edges.join(m, "m").join(f, "f").withColumn("c", F.md5(F.concat_ws("|", "c", "cm", "cf"))).drop("cm", "cf"))
        now = edges.agg(F.count_distinct("family", "c")).first()[0]
        if now == known:
            return edges
        known = now


def _told_apart(edges: DataFrame) -> DataFrame:
    """Colours that differ inside each family: sibships that share a parent, and whose other parent has no further ones, are
    numbered at once; of other equal ones a family's first is marked and the colours refined again."""
    while True:
        edges = _refined(edges)
        same = edges.groupBy("family", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not same.limit(1).count():
            return edges
        least = same.groupBy("family").agg(F.min("c").alias("tied"))
        degree = lambda k: edges.groupBy(k).agg(F.count(F.lit(1)).alias(f"d{k}"))
        e = edges.join(degree("m"), "m").join(degree("f"), "f").join(least, "family", "left")
        tied = F.col("c") == F.col("tied")
        # leaves of a star: a number for each; the others: the first of the family only
        at = F.when(F.col("df") == 1, F.concat(F.lit("m"), "m")).when(F.col("dm") == 1, F.concat(F.lit("f"), "f"))
        place = F.row_number().over(Window.partitionBy("family", "c", "at").orderBy("first"))
        e = e.withColumn("at", at).withColumn("place", place)
        lone = F.when(F.col("at").isNull() & (F.col("place") > 1), 0).otherwise(F.col("place"))
        edges = cut(e.withColumn("c", F.when(tied, F.md5(F.concat_ws("|", "c", lone.cast("string")))).otherwise(F.col("c"))).select(*edges.columns))


def family_blocks(subjects: DataFrame, unit: str = "unit_id", mother: str = "mother", father: str = "father", zygosity: str = "zygosity") -> DataFrame:
    """(unit_id, type, family, sibship) of a twin table with whole numbers from 0 as ids: families are subjects tied by parents,
    over any number of half-siblings. Families of one type (a hash) have the same pedigree and change places as wholes, each
    sibship with its counterpart; inside a family full siblings of one kind change places: identical twins (MZ),
    fraternal twins (DZ), others. A twin without the other one counts among the others, a missing parent as one of the
    subject's own. Rows without an id are left out, and so are repeated rows.

    A type is the family's list of sibships, with who shares which parent, in an order found by refining colours, so
    equal types mean equal pedigrees (up to 128 bits of hashes). Pedigrees with loops that refinement can't order in one way
    may get two types; then fewer families change places, never wrong ones."""
    k = F.upper(F.trim(F.col(zygosity).cast("string")))
    own = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.concat(F.lit("?"), F.col(unit).cast("string")))
    s = subjects.where(F.col(unit).isNotNull()).select(F.col(unit).cast("long").alias("unit_id"), own(mother).alias("m"), own(father).alias("f"), F.when(k == "MZ", 1).when(k == "DZ", 2).otherwise(3).alias("kind"))
    s = cut(s.dropDuplicates(["unit_id"]))
    pairs = s.groupBy("m", "f", "kind").agg(F.count(F.lit(1)).alias("n"))
    lone = (F.col("kind") < 3) & (F.col("n") < 2)
    s = cut(s.join(pairs, ["m", "f", "kind"]).select("unit_id", "m", "f", F.when(lone, 3).otherwise(F.col("kind")).alias("kind")))
    ties = [s.join(s.groupBy(c).agg(F.min("unit_id").alias("v")), c).select(F.col("unit_id").alias("u"), "v") for c in ("m", "f")]
    of = graph.components(ties[0].unionByName(ties[1])).select(F.col("id").alias("unit_id"), F.col("component").alias("family"))
    s = cut(s.join(of, "unit_id"))
    count = lambda v: F.count(F.when(F.col("kind") == v, 1)).cast("string")
    edges = s.groupBy("family", "m", "f").agg(F.concat_ws(":", *map(count, (1, 2, 3))).alias("has"), F.min("unit_id").alias("first"))
    edges = _told_apart(cut(edges.withColumn("c", F.md5("has"))))
    edges = cut(edges.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy("c"))))
    rank = lambda c: edges.groupBy(c).agg(F.min("place").alias(f"r{c}"))
    row = F.concat_ws(",", "place", "has", "rm", "rf")
    types = edges.join(rank("m"), "m").join(rank("f"), "f").withColumn("row", row).groupBy("family").agg(_sums("row").alias("type"))
    # a positive type lets its families change places, a negative family keeps its sibships in place
    label = F.shiftrightunsigned(F.xxhash64("type"), 1) + 1
    told = types.select("family", label.alias("type"))
    out = s.join(edges.select("m", "f", "place"), ["m", "f"]).join(told, "family")
    return out.select("unit_id", "type", (-F.col("family") - 1).alias("family"), (F.col("place") * 3 + F.col("kind") - 3).alias("sibship"))
