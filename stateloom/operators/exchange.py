"""Shuffles of nested blocks by number: how many there are, each of them once, and random sets without repeats.

Children of a block that have one make-up and may change places form a group. A shuffle is an order for each group, so its
number has a digit for each group (mixed radix, n! values for n children), and a digit gives the order of that rank in the
dictionary. Number 0 changes nothing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Shuffles that `every_shuffle` lists at most, unless told otherwise.
MOST = 1_000_000


def tree_levels(units: DataFrame, levels: list[str], whole: bool = True) -> list[DataFrame]:
    """A table (parent, unit_id, label, swaps, shape) of blocks for each level, from the top, then one of the units. Blocks are
    named by their path. shape is a block's make-up: how many children of each make-up it has, and whether they swap."""
    path = [F.lit("").alias("p0")]
    for j in range(1, len(levels) + 1):
        path.append(F.concat(*(x for c in levels[:j] for x in (F.lit("/"), F.col(c).cast("string")))).alias(f"p{j}"))
    rows = cut(units.select("unit_id", *path, *(F.col(c).alias(f"l{j}") for j, c in enumerate(levels, 1))))
    last = len(levels)
    # make-up of blocks, from the last level up
    shapes = [rows.groupBy(f"p{last}").agg(F.count(F.lit(1)).cast("string").alias("shape"))]
    for j in range(last, 0, -1):
        kin = rows.select(f"p{j - 1}", f"p{j}", F.col(f"l{j}").alias("label")).distinct().join(shapes[0], f"p{j}")
        kinds = kin.withColumn("shape", F.concat((F.col("label") > 0).cast("string"), F.lit(":"), "shape")).groupBy(f"p{j - 1}", "shape").agg(F.count(F.lit(1)).alias("n"))
        shapes.insert(0, kinds.groupBy(f"p{j - 1}").agg(F.md5(F.to_json(F.sort_array(F.collect_list(F.struct("shape", "n"))))).alias("shape")))
    out = []
    for j in range(1, last + 1):
        up = F.lit(whole) if j == 1 else F.col(f"l{j - 1}") > 0
        kids = rows.select(F.col(f"p{j - 1}").alias("parent"), F.col(f"p{j}").alias("unit_id"), F.col(f"l{j}").alias("label"), up.alias("swaps")).distinct()
        make_up = shapes[j].select(F.col(f"p{j}").alias("unit_id"), "shape")
        out.append(kids.join(make_up, "unit_id").withColumn("shape", F.concat((F.col("label") > 0).cast("string"), F.lit(":"), "shape")))
    out.append(rows.select(F.col(f"p{last}").alias("parent"), "unit_id", F.col("unit_id").alias("label"), F.lit(True).alias("swaps"), F.lit("").alias("shape")))
    return out


def _groups(tree: list[DataFrame]) -> DataFrame:
    """(level, parent, shape, n) of groups of two children or more that change places."""
    sizes = [t.where("swaps").groupBy("parent", "shape").agg(F.count(F.lit(1)).alias("n")).select(F.lit(j).alias("level"), "*") for j, t in enumerate(tree)]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out.where("n > 1")


def _log_factorial(n):
    """ln n!: of the product up to 20, by Stirling's series beyond."""
    n = n.cast("double")
    series = n * F.log(n) - n + F.log(n * 2 * math.pi) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20.0)).cast("int")))).otherwise(series)


def _log_total(groups: DataFrame) -> float:
    sizes = groups.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    return sizes.agg(F.sum(F.col("k") * _log_factorial(F.col("n"))).alias("v")).first()["v"] or 0.0


def log_shuffles(units: DataFrame, levels: list[str] = (), whole: bool = True) -> float:
    """Natural logarithm of the number of shuffles that respect nested blocks (as in `testing.tree_permutations`; no levels:
    free shuffles). 0 without units."""
    return _log_total(_groups(tree_levels(units, list(levels), whole)))


def _order_of(number: str, n: str) -> str:
    """SQL for the order (array of 1..n) of a rank among all orders of the dictionary."""
    f = f"factorial(cast({n} - i as int))"
    at = f"cast(s.d div {f} as int)"
    return f"""aggregate(sequence(1, cast({n} as int)),
      named_struct('rest', sequence(1, cast({n} as int)), 'd', {number}, 'out', cast(array() as array<int>)),
      (s, i) -> named_struct('rest', concat(slice(s.rest, 1, {at}), slice(s.rest, {at} + 2, cast({n} as int))), 'd', s.d % {f},
                             'out', concat(s.out, array(get(s.rest, {at})))), s -> s.out)"""


class Shuffles:
    """All shuffles of units (unit_id, levels) by number; `total` of them. Raises where there are more than `most`."""

    def __init__(self, units: DataFrame, levels: list[str] = (), whole: bool = True, most: int = MOST):
        self.tree = tree_levels(units, list(levels), whole)
        groups = cut(_groups(self.tree))
        logs = _log_total(groups)
        if logs > math.log(most) + 1e-6:
            raise ValueError(f"about e^{logs:.1f} shuffles, more than {most}: draw some of them")
        # each of these rows at least doubles the total, so there are at most log2(most)
        rows = groups.orderBy("level", "parent", "shape").collect()
        self.total, digits = 1, []
        for r in rows:
            digits.append((r["level"], r["parent"], r["shape"], r["n"], self.total))
            self.total *= math.factorial(r["n"])
        self.digits = digits

    def of(self, ids: DataFrame) -> DataFrame:
        """(perm_id, dst, src) of ids (perm_id int, number long)."""
        pairs = ids.select("perm_id", "number", F.lit("").alias("dst"), F.lit("").alias("src"))
        for j, kids in enumerate(self.tree):
            place = F.row_number().over(Window.partitionBy("parent", "shape").orderBy("label"))
            placed = kids.select("parent", "shape", "unit_id", place.alias("place"))
            a = pairs.join(placed.withColumnsRenamed({"parent": "dst", "unit_id": "to"}), "dst")
            here = [d for d in self.digits if d[0] == j]
            if here:
                each = F.array(*(F.struct(F.lit(p).alias("dst"), F.lit(h).alias("shape"), F.lit(n).alias("n"), F.lit(w).cast("long").alias("weight")) for _, p, h, n, w in here))
                orders = ids.select("number").distinct().select("number", F.inline(each))
                orders = orders.select("number", "dst", "shape", F.expr(_order_of("(number div weight) % factorial(cast(n as int))", "n")).alias("order"))
                a = a.join(orders, ["number", "dst", "shape"], "left").withColumn("place", F.coalesce(F.get("order", F.col("place") - 1), "place"))
            b = placed.withColumnsRenamed({"parent": "src", "unit_id": "from"})
            pairs = a.join(b, ["src", "shape", "place"]).select("perm_id", "number", F.col("to").alias("dst"), F.col("from").alias("src"))
        return pairs.drop("number")

    def between(self, first: int, last: int) -> DataFrame:
        """Shuffles first..last-1, under their numbers."""
        spark = self.tree[0].sparkSession
        ids = spark.range(first, min(last, self.total)).select(F.col("id").cast("int").alias("perm_id"), F.col("id").alias("number"))
        return self.of(ids)


def every_shuffle(units: DataFrame, levels: list[str] = (), whole: bool = True, most: int = MOST) -> DataFrame:
    """(perm_id, dst, src): each shuffle once, the identity as 0. Without units there are no rows."""
    return Shuffles(units, levels, whole, most).between(0, most)


def without_repeats(units: DataFrame, levels: list[str], n: int, seed: int = 0, whole: bool = True):
    """(ids, make): ids (perm_id int, number long) of n different random shuffles, fewer where there are not n, the identity
    as 0; make(ids) gives (perm_id, dst, src) of some of them. Where there are few shuffles (4 n, or 1,000) numbers
    are drawn in order of MD5; where there are many, shuffles are drawn, known again by two 64-bit sums over their
    pairs, and drawn anew where they repeat."""
    from . import testing

    spark = units.sparkSession
    few = max(4 * n, 1_000)
    levels = list(levels)
    if log_shuffles(units, levels, whole) <= math.log(few) + 1e-6:
        all_of = Shuffles(units, levels, whole, few)
        rank = F.row_number().over(Window.orderBy(F.when(F.col("number") > 0, F.md5(F.concat(F.lit(f"{seed}:"), F.col("number").cast("string")))).otherwise(""), "number"))
        ids = spark.range(all_of.total).withColumnRenamed("id", "number").withColumn("perm_id", (rank - 1).cast("int")).where(F.col("perm_id") < n)
        return cut(ids.select("perm_id", "number")), all_of.of

    def drawn(numbers: DataFrame) -> DataFrame:
        return testing.tree_permutations(units, levels, 0, seed, whole, ids=numbers)

    known, first, found = None, 0, 0
    while found < n:
        more = max(n - found, n // 2)
        new_ids = spark.range(first, first + more).select(F.col("id").cast("int").alias("perm_id"))
        first += more
        print_of = (F.bit_xor(F.xxhash64("dst", "src")).alias("a"), F.sum(F.xxhash64("src", "dst", F.lit(1)).cast("decimal(38,0)")).alias("b"))
        new = drawn(new_ids).groupBy("perm_id").agg(*print_of)
        both = new if known is None else known.unionByName(new)
        known = cut(both.groupBy("a", "b").agg(F.min("perm_id").alias("perm_id")).select("perm_id", "a", "b"))
        found = known.count()
    # a row for each shuffle asked for
    rank = (F.row_number().over(Window.orderBy("perm_id")) - 1).cast("int")
    ids = cut(known.select(rank.alias("at"), F.col("perm_id").cast("long").alias("number")).withColumnRenamed("at", "perm_id").where(F.col("perm_id") < n))

    def make(some: DataFrame) -> DataFrame:
        made = drawn(some.select(F.col("number").cast("int").alias("perm_id"))).withColumnRenamed("perm_id", "number")
        return made.join(some.withColumn("number", F.col("number").cast("int")), "number").select("perm_id", "dst", "src")

    return ids, make


def distinct_shuffles(units: DataFrame, levels: list[str], n: int, seed: int = 0, whole: bool = True) -> DataFrame:
    """(perm_id, dst, src) of n different random shuffles; see `without_repeats`."""
    ids, make = without_repeats(units, levels, n, seed, whole)
    return make(ids)
