"""Association tests on tidy tables: statistics, permutations, p-values and corrections.

Units are rows (unit_id, d ARRAY, r ARRAY[, block, tau]). A permutation is a table (perm_id, dst, src); perm_id 0 is
the identity. Orders come from MD5 of 'seed:perm:unit', so they do not depend on partitions and plain SQL gets the
same ones. Statistics of all permutations are one aggregation by (perm_id, tau, p, q) of moments."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..plans.lineage import cut, stored
from . import exchange, quantiles, results


def order_key(seed: int, perm, unit):
    return F.md5(F.concat(F.lit(f"{seed}:"), perm.cast("string"), F.lit(":"), unit.cast("string")))


# Permutations


#: Units that one task ranks.
RANK_ROWS = 100_000


def _in_order(units: DataFrame, n_units: int, *keys: str) -> DataFrame:
    """Adds place, the rank by unit_id inside keys: taken inside ranges of the id, offset by the ranges' sizes."""
    parts = -(-n_units // RANK_ROWS)
    if parts <= 1:
        return units.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("unit_id")))
    ranged = cut(units.repartitionByRange(parts, "unit_id").withColumn("part", F.spark_partition_id()))
    return _placed(ranged, ("unit_id",), *keys)


def _at_random(units: DataFrame, n_units: int, key, *keys: str) -> DataFrame:
    """Adds place, the rank by the text key (as evenly spread as an MD5) and unit_id inside keys: taken inside buckets of
    the key's first bits, offset by the buckets' sizes. The key doesn't travel: it is made where its bucket is ranked."""
    bits = min(16, max(0, math.ceil(math.log2(max(1, n_units / RANK_ROWS)))))
    made = F.unhex(key)
    if not bits:
        dealt = units.repartition(*keys).withColumn("key", made)
        return dealt.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("key", "unit_id"))).drop("key")
    head = F.coalesce(F.conv(F.hex(F.substring(made, 1, 2)), 16, 10).cast("int"), F.lit(0))
    return _placed(units.withColumn("part", F.shiftright(head, 16 - bits)), ("key", "unit_id"), *keys, key=made).drop("key")


def _placed(rows: DataFrame, order: tuple[str, ...], *keys: str, key=None) -> DataFrame:
    """The rank by order inside keys, of rows whose part rises with the order; key, if any, is made after they are dealt."""
    # a row for each part and value of keys
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy(*keys, "part").orderBy(*order)
    dealt = rows if key is None else rows.repartition(*keys, "part").withColumn("key", key)
    ranked = dealt.withColumn("place", F.row_number().over(within)).join(sizes, [*keys, "part"])
    return ranked.withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def permutations(units: DataFrame, n: int, seed: int = 0, block: str | None = None, first: int = 0, carry: bool = False) -> DataFrame:
    """(perm_id, dst, src) for perm_id first..n-1: free, or inside blocks. units has unit_id and the block column. No task
    ranks many more than RANK_ROWS units of a permutation. carry adds d of dst and r of src, those of them that units has, so
    that nothing need be looked up for each permutation."""
    keys = ["block"] if block else []
    carried = [c for c in ("d", "r") if carry and c in units.columns]
    u = units.select("unit_id", *([F.col(block).alias("block")] if block else []), *carried)
    size = u.count()
    placed = _in_order(u, size, *keys)
    out = ["perm_id", "dst", "src", *carried]
    still = placed.select(F.lit(0).alias("perm_id"), F.col("unit_id").alias("dst"), F.col("unit_id").alias("src"), *out[3:])
    if n < 2:
        return still if first == 0 else still.limit(0)
    ids = F.explode(F.sequence(F.lit(max(1, first)), F.lit(n - 1)))
    moved = u.drop("d").withColumn("perm_id", ids)
    b = _at_random(moved, size, order_key(seed, F.col("perm_id"), F.col("unit_id")), "perm_id", *keys).withColumnRenamed("unit_id", "src")
    # all permutations look into one table of places
    shuffled = b.join(placed.drop("r").withColumnRenamed("unit_id", "dst"), [*keys, "place"]).select(*out)
    return still.unionByName(shuffled) if first == 0 else shuffled


def tree_permutations(units: DataFrame, levels: list[str], n: int, seed: int = 0, whole: bool = True, first: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """(perm_id, dst, src) for perm_id first..n-1, or those of ids, that respect nested blocks. Each level is a column of whole numbers that
    divides the level before it. A positive number lets what is inside the block change places with what is inside it
    and of the same make-up; a negative one keeps that in place and shuffles only further down. whole says so of the
    first level's blocks. The units of a last block always change places. Ids of units are unique; perm_id 0 is the
    identity; without units there are no rows."""
    size, tree = units.count(), exchange.tree_levels(units, levels, whole)
    numbers = units.sparkSession.range(first, n).select(F.col("id").cast("int").alias("perm_id")) if ids is None else ids.select("perm_id")
    pairs = numbers.select("perm_id", F.lit("").alias("dst"), F.lit("").alias("src"))
    for kids in tree[:-1]:
        pairs = _paired(pairs, kids, seed, "label", size)
    return _paired(pairs, tree[-1], seed, "unit_id", size)


def _paired(pairs: DataFrame, kids: DataFrame, seed: int, label: str, size: int) -> DataFrame:
    """(perm_id, dst, src) of the children of blocks that stand in each other's place: those of one make-up in order of
    label, and in random order where they swap."""
    order = F.row_number().over(Window.partitionBy("parent", "shape").orderBy("label"))
    a = kids.withColumn("place", order).select(F.col("parent").alias("dst"), "shape", "place", F.col("unit_id").alias("to"))
    a = pairs.join(a, "dst").select("perm_id", F.col("dst").alias("of"), "shape", "place", "to")
    b = pairs.join(kids.withColumnRenamed("parent", "src"), "src").select("perm_id", F.col("dst").alias("of"), "shape", "unit_id", "label", "swaps", "src")
    node = F.concat("src", F.lit("/"), F.col("unit_id").cast("string")) if label == "unit_id" else F.col("unit_id")
    key = F.when(F.col("swaps") & (F.col("perm_id") > 0), order_key(seed, F.col("perm_id"), node)).otherwise("")
    if label == "unit_id":
        b = _at_random(b.drop("label"), size, key, "perm_id", "of", "shape")
    else:
        b = b.withColumn("place", F.row_number().over(Window.partitionBy("perm_id", "of", "shape").orderBy(key, "label")))
    b = b.select("perm_id", "of", "shape", "place", F.col("unit_id").alias("from"))
    return a.join(b, ["perm_id", "of", "shape", "place"]).select("perm_id", F.col("to").alias("dst"), F.col("from").alias("src"))


def block_permutations(units: DataFrame, n: int, seed: int = 0, block: str = "block", first: int = 0) -> DataFrame:
    """(perm_id, dst, src): whole blocks change places with blocks of their size; units keep their order inside."""
    w = Window.partitionBy(block).orderBy("unit_id")
    placed = units.select("unit_id", block).withColumn("place", F.row_number().over(w))
    sizes = placed.groupBy(block).agg(F.max("place").alias("size"))
    as_units = sizes.select(F.col(block).alias("unit_id"), "size")
    moves = permutations(as_units, n, seed, "size", first).select("perm_id", F.col("dst").alias("dst_block"), F.col("src").alias("src_block"))
    dst = placed.select(F.col("unit_id").alias("dst"), F.col(block).alias("dst_block"), "place")
    src = placed.select(F.col("unit_id").alias("src"), F.col(block).alias("src_block"), "place")
    return moves.join(dst, "dst_block").join(src, ["src_block", "place"]).select("perm_id", "dst", "src")


def both_permutations(units: DataFrame, n: int, seed: int = 0, block: str = "block", first: int = 0) -> DataFrame:
    """Inside blocks, then whole blocks: the two maps composed."""
    inner = permutations(units, n, seed, block, first).select("perm_id", F.col("dst").alias("mid"), "src")
    outer = block_permutations(units, n, seed + 1, block, first).select("perm_id", "dst", F.col("src").alias("mid"))
    return outer.join(inner, ["perm_id", "mid"]).select("perm_id", "dst", "src")


def count_permutations(units: DataFrame, block: str | None = None, whole_blocks: bool = False) -> float:
    """Natural logarithm of the number of different shuffles."""
    if block is None:
        return float(special.gammaln(units.count() + 1))
    sizes = units.groupBy(block).agg(F.count(F.lit(1)).alias("size"))
    if whole_blocks:
        sizes = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
        return float(sum(special.gammaln(r["n"] + 1) for r in sizes.collect()))
    return float(sum(special.gammaln(r["size"] + 1) * r["count"] for r in sizes.groupBy("size").count().collect()))


# Statistics


def _pairs(units: DataFrame, perms: DataFrame | None, *keys: str) -> DataFrame:
    """(perm_id, keys, p, q, x, y): each predictor with each outcome of the permuted unit, nulls left out. Vectors travel
    whole and are opened where they have met, or came with the permutations."""
    some = lambda c: F.exists(c, lambda v: v.isNotNull() & ~F.isnan(v))
    d = units.where(some("d")).select(F.col("unit_id").alias("dst"), *keys, "d")
    if perms is not None and {"d", "r"} <= set(perms.columns):
        met = perms
    elif perms is None:
        met = d.join(units.where(some("r")).select(F.col("unit_id").alias("dst"), *keys, "r"), ["dst", *keys]).withColumn("perm_id", F.lit(0))
    else:
        moved = perms.join(d, "dst").drop("dst")
        met = moved.join(units.where(some("r")).select(F.col("unit_id").alias("src"), *keys, "r"), ["src", *keys])
    opened = met.select("perm_id", *keys, F.posexplode("d").alias("p", "x"), "r").where("x is not null and not isnan(x)")
    return opened.select("perm_id", *keys, "p", F.posexplode("r").alias("q", "y"), "x").where("y is not null and not isnan(y)")


def correlation_stats(units: DataFrame, perms: DataFrame | None = None, *keys: str) -> DataFrame:
    """(perm_id, keys, p, q, n, r, t): Pearson correlation over complete pairs and its t value. r is null where x or y does
    not vary, t also where r is 1 or -1."""
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    s = _pairs(units, perms, *keys).groupBy("perm_id", *keys, "p", "q").agg(F.count(F.lit(1)).alias("n"), r.alias("r"))
    return s.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def fixed_predictor_stats(predictors: DataFrame, outcomes: DataFrame, perms: DataFrame, *keys: str) -> DataFrame:
    """As `correlation_stats`, of predictors (unit_id, d) that are the same for all values of keys and of outcomes (unit_id,
    keys, r), one row for each of them that there is; perms may carry d. A unit's predictors under all permutations meet its outcomes once, as a
    row, and tasks emit sums by permutation and cell, so neither permuted outcomes nor empty cells are ever rows. A task holds
    permutations x cells numbers, taken from the cell's mean. A spread under 1e-12 of the squares is taken for none."""
    import pandas as pd
    import pyarrow as pa

    from . import preprocess

    entry = F.struct(F.struct(*keys, F.lit(0).alias("_")).alias("cell"), "r")
    # outcomes are made once: width, means and sums read these rows
    y = stored(outcomes.select(F.col("unit_id").alias("src"), entry.alias("y")).groupBy("src").agg(F.collect_list("y").alias("ys")))
    p, q = preprocess.width(predictors, "d"), preprocess.width(y.select(F.col("ys")[0]["r"].alias("r")), "r")
    middle = lambda c, n: [F.coalesce(F.avg(F.when(~F.isnan(F.col(c)[i]), F.col(c)[i])), F.lit(0.0)).alias(f"_{i}") for i in range(n)]
    mx = np.array(predictors.agg(*middle("d", p)).first())
    # a row for each cell
    cells = y.select(F.explode("ys").alias("y")).select("y.cell.*", "y.r")
    means = {tuple(r[: len(keys)]): np.array(r[len(keys) :]) for r in cells.groupBy(*keys).agg(*middle("r", q)).collect()}
    moved = perms if "d" in perms.columns else perms.join(predictors.select(F.col("unit_id").alias("dst"), "d"), "dst")
    x = moved.groupBy("src").agg(F.collect_list(F.struct("perm_id", "d")).alias("xs"))
    kinds = dict(outcomes.dtypes)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def unpacked(column):
        """The unit, and the two fields, of each entry of a list of pairs."""
        return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), *column.flatten().flatten()

    def numbers(column, width: int, mean):
        v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) - mean
        return np.where(np.isnan(v), 0.0, v), (~np.isnan(v)).astype(float)

    def run(batches):
        cells, total = {}, {}
        for b in batches:
            if not b.num_rows:
                continue
            unit, perm, d = unpacked(b.column("xs"))
            v, there = numbers(d, p, mx)
            ids, place = np.unique(perm.to_numpy(), return_inverse=True)
            xs, xt = (np.zeros((b.num_rows, len(ids), p)) for _ in range(2))
            xs[unit, place], xt[unit, place] = v, there
            unit, cell, r = unpacked(b.column("ys"))
            told = list(zip(*(c.to_pylist() for c in cell.flatten()[:-1]))) if keys else [()] * len(unit)
            place = np.array([cells.setdefault(c, len(cells)) for c in told], int)
            v, there = numbers(r, q, np.array([means[c] for c in cells])[place])
            for j in range(q):
                ys, yt = (np.zeros((b.num_rows, len(cells))) for _ in range(2))
                ys[unit, place], yt[unit, place] = v[:, j], there[:, j]
                for i in range(p):
                    a, on = xs[:, :, i].T, xt[:, :, i].T
                    sums = np.stack([on @ yt, a @ yt, on @ ys, (a * a) @ yt, on @ (ys * ys), a @ ys])
                    for n, k in enumerate(ids):
                        old = total.get((int(k), i, j))
                        new = sums[:, n]
                        if old is not None:
                            new = new + np.pad(old, ((0, 0), (0, new.shape[1] - old.shape[1])))
                        total[int(k), i, j] = new
        at = list(cells)
        for (k, i, j), m in total.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"perm_id": np.full(m.shape[1], k, np.int32), **{c: [v[n] for v in at[: m.shape[1]]] for n, c in enumerate(keys)}, "p": np.int32(i), "q": np.int32(j), **dict(zip(names, m))}), schema=out, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join(["perm_id int", *(f"{k} {kinds[k]}" for k in keys), "p int", "q int", *(f"{n} double" for n in names)])
    out = to_arrow_schema(StructType.fromDDL(ddl))
    sums = x.join(y, "src").select("xs", "ys").mapInArrow(run, ddl).groupBy("perm_id", *keys, "p", "q").agg(*(F.sum(n).alias(n) for n in names)).where("n > 0")
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    least = lambda s, ss: F.when(spread(s, ss) > 1e-12 * F.col(ss), spread(s, ss)).otherwise(0.0)
    r = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(least("sx", "sxx")) * F.sqrt(least("sy", "syy")))
    s = sums.select("perm_id", *keys, "p", "q", F.col("n").cast("long").alias("n"), r.alias("r"))
    return s.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def single_regression(units: DataFrame, perms: DataFrame | None = None, *keys: str) -> DataFrame:
    """(perm_id, keys, p, q, n, r2, f): share of variance that one predictor explains, and its F value."""
    s = _pairs(units, perms, *keys).groupBy("perm_id", *keys, "p", "q").agg(F.count(F.lit(1)).alias("n"), F.regr_r2("y", "x").alias("r2"))
    return s.withColumn("f", F.col("r2") / ((1 - F.col("r2")) / (F.col("n") - 2)))


def two_sample_t(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys, n0, n1, t): equal-variance t of value between group 0 and 1."""
    a = groups.groupBy(*keys).agg(*(f(F.when(F.col("group") == g, F.col("value"))).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    t = (F.col("m0") - F.col("m1")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    return a.select(*keys, "n0", "n1", t.alias("t"))


def one_way_f(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys, k, n, f): one-way analysis of variance of value over group."""
    g = groups.where("value is not null").groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    s = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = F.col("sq") - F.col("n") * F.col("mm") * F.col("mm")
    return s.select(*keys, "k", "n", ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def _moments(units: DataFrame, perms: DataFrame, p: int, q: int, *keys: str):
    """Rows of second moments: DtD once, and RtR, DtR of each permutation, all from complete rows."""
    complete = units.where(F.forall("d", lambda v: v.isNotNull() & ~F.isnan(v)) & F.forall("r", lambda v: v.isNotNull() & ~F.isnan(v)))
    joined = perms.join(complete.select(F.col("unit_id").alias("dst"), *keys, "d"), "dst").join(complete.select(F.col("unit_id").alias("src"), *keys, "r"), ["src", *keys])
    v = [F.lit(1.0), *(F.col("d")[i] for i in range(p)), *(F.col("r")[i] for i in range(q))]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    if len(pairs) > 300:  # too many expressions for one aggregation
        return _wide_moments(joined, p, q, *keys), pairs, len(v)
    return joined.groupBy("perm_id", *keys).agg(F.array(*(F.sum(v[i] * v[j]) for i, j in pairs)).alias("m")), pairs, len(v)


def _wide_moments(joined: DataFrame, p: int, q: int, *keys: str) -> DataFrame:
    """(perm_id, keys, m) as the expressions of `_moments` give it, from products of matrices."""
    import pandas as pd

    by = ["perm_id", *keys]
    at = np.triu_indices(1 + p + q)

    def told(total):
        for k, m in total.items():
            yield pd.DataFrame(dict(zip(by, k)) | {"i": np.arange(len(m)), "v": m})

    def run(frames):
        total: dict = {}
        for f in frames:
            for k, g in f.groupby(by):
                v = np.column_stack([np.ones(len(g)), np.stack(g["d"].to_numpy())[:, :p], np.stack(g["r"].to_numpy())[:, :q]])
                total[k] = total.get(k, 0) + (v.T @ v)[at]
            if len(total) > 256:
                yield from told(total)
                total = {}
        yield from told(total)

    kinds = dict(joined.dtypes)
    parts = joined.select(*by, "d", "r").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in by), "i int", "v double"]))
    sums = parts.groupBy(*by, "i").agg(F.sum("v").alias("v"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("m"))


def _centred(row, pairs, size: int) -> tuple[float, np.ndarray]:
    a = np.zeros((size, size))
    for (i, j), x in zip(pairs, row["m"]):
        a[i, j] = a[j, i] = x
    n = a[0, 0]
    return n, a[1:, 1:] - np.outer(a[0, 1:], a[0, 1:]) / n


def multiple_regression(units: DataFrame, perms: DataFrame, p: int, q: int, *keys: str, ridge: float = 0.001) -> DataFrame:
    """(perm_id, keys, q, n, r2, f): share that all predictors explain together (ridge regression of centred values),
    and its F value. The moments of each permutation are summed by Spark; the algebra is done row by row of the result."""
    m, pairs, size = _moments(units, perms, p, q, *keys)

    def solve(row):
        n, c = _centred(row, pairs, size)
        beta = np.linalg.solve(c[:p, :p] + ridge * np.eye(p), c[:p, p:])
        sse = np.diag(c[p:, p:]) - 2 * (beta * c[:p, p:]).sum(0) + np.einsum("ij,ik,kj->j", beta, c[:p, :p], beta)
        r2 = 1 - sse / np.diag(c[p:, p:])
        return [(j, n, r2[j], (r2[j] / p) / ((1 - r2[j]) / (n - p))) for j in range(q)]

    return _rowwise(m, keys, solve, "q int, n double, r2 double, f double")


def manova(units: DataFrame, perms: DataFrame, groups: int, q: int, *keys: str) -> DataFrame:
    """(perm_id, keys, wilks, f): Wilks' lambda of one-hot groups in d against r, with the approximate F."""
    m, pairs, size = _moments(units, perms, groups, q, *keys)

    def solve(row):
        n, c = _centred(row, pairs, size)
        explained = c[:groups, groups:].T @ np.linalg.pinv(c[:groups, :groups]) @ c[:groups, groups:]
        total = c[groups:, groups:]
        # determinants of many outcomes are beyond the range of doubles
        wilks = float(np.exp(np.linalg.slogdet(total - explained)[1] - np.linalg.slogdet(total)[1]))
        df1, df2 = groups * q, n - 0.5 * (q + groups + 1)
        return [(wilks, (1 - wilks) / max(wilks, 1e-300) * df2 / df1)]

    return _rowwise(m, keys, solve, "wilks double, f double")


def canonical(units: DataFrame, perms: DataFrame, p: int, q: int, components: int = 1, *keys: str) -> DataFrame:
    """(perm_id, keys, component, r): canonical correlations, largest first."""
    m, pairs, size = _moments(units, perms, p, q, *keys)

    def root(a):
        val, vec = np.linalg.eigh(a)
        keep = val > 1e-10 * max(val.max(), 1e-300)
        return vec[:, keep] / np.sqrt(val[keep])

    def solve(row):
        _, c = _centred(row, pairs, size)
        s = np.linalg.svd(root(c[:p, :p]).T @ c[:p, p:] @ root(c[p:, p:]), compute_uv=False)
        return [(i, float(min(s[i], 1.0)) if i < len(s) else 0.0) for i in range(components)]

    return _rowwise(m, keys, solve, "component int, r double")


def _rowwise(m: DataFrame, keys, solve, schema: str) -> DataFrame:
    import pandas as pd

    kinds = dict(m.dtypes)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            rows = [(r["perm_id"], *(r[k] for k in keys), *x) for r in f.to_dict("records") for x in solve(r)]
            yield pd.DataFrame(rows, columns=["perm_id", *keys, *names])

    return m.mapInPandas(run, ", ".join(["perm_id int", *(f"{k} {kinds[k]}" for k in keys), schema]))


def state_vs_rest(path: DataFrame, value: str = "value", how: str = "mean") -> DataFrame:
    """(state, difference): the signal in a state less that outside it."""
    if how == "mean":
        s = path.groupBy("state").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
        t = s.select("*", F.sum("s").over(Window.partitionBy()).alias("ts"), F.sum("n").over(Window.partitionBy()).alias("tn"))
        return t.select("state", (F.col("s") / F.col("n") - (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("difference"))
    states = F.array(*(F.lit(r["state"]) for r in path.select("state").distinct().collect()))  # one for each state
    v, k = F.col(value), F.col("k")
    rows = path.withColumn("k", F.explode(states))
    medians = quantiles.quantiles(rows.select("k", (F.col("state") == k).alias("inside"), v.alias("v")), "v", [0.5], "k", "inside")
    middle = F.col("quantiles")[0]
    return medians.groupBy(k.alias("state")).agg((F.max(F.when(F.col("inside"), middle)) - F.max(F.when(~F.col("inside"), middle))).alias("difference"))


def state_pairs(path: DataFrame, value: str = "value", how: str = "mean") -> DataFrame:
    """(state_a, state_b, difference) for a < b."""
    if how == "mean":
        s = path.groupBy("state").agg(F.avg(value).alias("v"))
    else:
        s = quantiles.quantiles(path, value, [0.5], "state").select("state", F.col("quantiles")[0].alias("v"))
    a, b = s.select(F.col("state").alias("state_a"), F.col("v").alias("va")), s.select(F.col("state").alias("state_b"), F.col("v").alias("vb"))
    return a.join(b, F.col("state_a") < F.col("state_b")).select("state_a", "state_b", (F.col("va") - F.col("vb")).alias("difference"))


def column_kinds(units: DataFrame, column: str, n: int, limit: int = 10) -> list[str]:
    """For each element: 't' with two distinct values, 'groups' with fewer than the limit, else 'regression'."""
    row = units.agg(*(F.countDistinct(F.col(column)[i]).alias(str(i)) for i in range(n))).first()
    return ["t" if row[i] == 2 else "groups" if 2 < row[i] < limit else "regression" for i in range(n)]


def deconfound(units: DataFrame, column: str, confounds: str) -> DataFrame:
    """A vector column, centred, less its regression on centred confounds."""
    from . import preprocess

    both = units
    for c in (column, confounds):
        n = preprocess.width(both, c)
        means = both.agg(*(F.avg(F.col(c)[i]).alias(str(i)) for i in range(n))).first()
        both = both.withColumn(c, F.array(*(F.col(c)[i] - F.lit(float(means[i])) for i in range(n))))
    return preprocess.regress_out(both, column, confounds, ridge=1e-9)


# Relabelled visits

#: Relabellings of a session that one task makes at once.
PERM_CHUNK = 64


def relabelled_runs(path: DataFrame, n: int, k: int, seed: int = 0) -> DataFrame:
    """(perm_id, session_id, onset, length, state): every visit gets a random state other than the new one before it, and
    all states occur in a session that has visits enough; perm_id 0 is the path itself. The draw runs over visits, one
    row each, a session and permutation at a time."""
    import pandas as pd

    from . import summary

    kind = dict(path.dtypes)["session_id"]
    made = relabelled(n, k, seed)

    def draw(frames):
        for f in frames:
            for sid, first, rows in zip(f["session_id"], f["chunk"], f["rows"]):
                onset, length, state = (np.array([r[c] for r in rows]) for c in ("onset", "length", "state"))
                perms, new = made(sid, first, state)
                yield pd.DataFrame({"perm_id": np.repeat(perms, len(rows)), "session_id": sid, "onset": np.tile(onset, len(perms)), "length": np.tile(length, len(perms)), "state": new.ravel()})

    # a row holds a session's visits, and makes PERM_CHUNK of its relabellings
    starts = F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(PERM_CHUNK)))
    listed = F.sort_array(F.collect_list(F.struct("onset", "length", "state"))).alias("rows")
    packed = summary.visits(path).groupBy("session_id").agg(listed).withColumn("chunk", starts)
    return packed.mapInPandas(draw, f"perm_id int, session_id {kind}, onset int, length long, state int")


def relabelled(n: int, k: int, seed: int):
    """A function of (session, first permutation of a chunk, its visits' states) that gives the chunk's permutations and, a
    row for each, the new states."""

    def labels(m: int, r: np.random.Generator) -> np.ndarray:
        steps = r.integers(1, max(2, k), m)
        for _ in range(100):
            new = (r.integers(k) + np.cumsum(steps)) % k
            if len(np.unique(new)) >= min(k, m):
                return new
            steps = r.integers(1, max(2, k), m)
        # a random stretch takes all states in random order, and the rest goes on from it to both sides
        need = min(k, m)
        at, order = int(r.integers(m - need + 1)), r.permutation(k)[:need]
        left = (order[0] + np.cumsum(steps[:at])[::-1]) % k
        right = (order[-1] + np.cumsum(steps[at + need :])) % k
        return np.concatenate([left, order, right]).astype(int)

    def made(sid, first: int, state: np.ndarray):
        import zlib

        perms = range(first, min(first + PERM_CHUNK, n))
        return perms, np.stack([labels(len(state), np.random.default_rng([seed, p, zlib.crc32(str(sid).encode())])) if p else state for p in perms])

    return made


def _rows_of(runs: DataFrame) -> DataFrame:
    """A row for each t of a run."""
    return runs.withColumn("t", F.explode(F.sequence(F.col("onset"), (F.col("onset") + F.col("length") - 1).cast("int"))))


def relabelled_visits(path: DataFrame, n: int, k: int, seed: int = 0) -> DataFrame:
    """(perm_id, session_id, t, state): the rows of `relabelled_runs`."""
    return _rows_of(relabelled_runs(path, n, k, seed)).select("perm_id", "session_id", "t", "state")


# p-values and corrections


def p_values(stats: DataFrame, stat: str, *keys: str, two_sided: bool = True) -> DataFrame:
    """(keys, observed, p): share of permutations, the identity included, whose statistic reaches the observed one."""
    v = F.abs(stat) if two_sided else F.col(stat)
    # made once: sums that are made again differ in the last digits, and the identity would not reach itself
    s = cut(stats.select("perm_id", *keys, F.col(stat).alias("raw"), v.alias("v")))
    observed = s.where("perm_id = 0").select(*keys, F.col("raw").alias("observed"), F.col("v").alias("v0"))
    j = s.join(observed, list(keys)) if keys else s.crossJoin(F.broadcast(observed))  # one row
    return j.groupBy(*keys).agg(F.first("observed").alias("observed"), F.avg((F.col("v") >= F.col("v0")).cast("double")).alias("p"))


def max_p_values(stats: DataFrame, stat: str, over: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """(within, over, observed, p): family-wise corrected by the largest statistic of each permutation among all tests
    `over`; (count + 1) / (permutations + 1), the identity left out of the count."""
    s = cut(stats.select("perm_id", *within, *over, F.col(stat).alias("raw"), F.abs(stat).alias("v")))
    top = s.groupBy("perm_id", *within).agg(F.max("v").alias("top"))
    observed = s.where("perm_id = 0").select(*within, *over, F.col("raw").alias("observed"), F.col("v").alias("v0"))
    # a row of as many numbers as there are permutations
    null = top.where("perm_id > 0").groupBy(*within).agg(F.collect_list("top").alias("nulls"))
    j = observed.join(null, list(within), "left") if within else observed.crossJoin(F.broadcast(null))
    reached = F.size(F.filter("nulls", lambda x: x >= F.col("v0")))
    return j.select(*within, *over, "observed", ((reached + 1) / (F.size("nulls") + 1)).alias("p"))


def benjamini_hochberg(p: DataFrame, column: str = "p") -> DataFrame:
    """Adds q: false discovery rate over all rows that have a p."""
    return results.corrected(p, "fdr_bh", column)


def bonferroni(p: DataFrame, column: str = "p") -> DataFrame:
    return results.corrected(p, "bonferroni", column)


def holm(p: DataFrame, column: str = "p") -> DataFrame:
    return results.corrected(p, "holm", column)


def cluster_masses(stats: DataFrame, threshold: float, stat: str = "stat", *keys: str) -> DataFrame:
    """(keys, cluster, start, end, mass): runs of tau whose absolute statistic passes the threshold, and their sum."""
    w = Window.partitionBy(*keys).orderBy("tau") if keys else Window.orderBy("tau")
    on = stats.where(F.abs(stat) > threshold).withColumn("run", F.col("tau") - F.row_number().over(w))
    c = on.groupBy(*keys, "run").agg(F.min("tau").alias("start"), F.max("tau").alias("end"), F.sum(F.abs(stat)).alias("mass"))
    order = Window.partitionBy(*keys).orderBy("start") if keys else Window.orderBy("start")
    return c.withColumn("cluster", F.row_number().over(order) - 1).drop("run")


def cluster_p_values(stats: DataFrame, stat: str = "stat", alpha: float = 0.05, *keys: str) -> DataFrame:
    """(keys, cluster, start, end, mass, p): clusters above the (1 - alpha) percentile of all permutations' statistics,
    against the largest cluster of each permutation; (count + 1) / (permutations + 1)."""
    stats = cut(stats.select("perm_id", *keys, "tau", stat))
    at = quantiles.quantiles(stats, F.abs(stat), [1 - alpha], *keys).select(*keys, F.col("quantiles")[0].alias("limit"))
    s = stats.join(at, list(keys)) if keys else stats.crossJoin(F.broadcast(at))  # one row
    over = s.withColumn("stat", F.abs(stat)).withColumn("stat", F.when(F.col("stat") > F.col("limit"), F.col("stat")).otherwise(0.0))
    c = cluster_masses(over, 0.0, "stat", "perm_id", *keys)
    perms = stats.select("perm_id", *keys).where("perm_id > 0").distinct()
    top = perms.join(c.groupBy("perm_id", *keys).agg(F.max("mass").alias("top")), ["perm_id", *keys], "left").fillna(0.0, ["top"])
    found = c.where("perm_id = 0").drop("perm_id")
    null = top.groupBy(*keys).agg(F.collect_list("top").alias("nulls"))
    j = found.join(null, list(keys)) if keys else found.crossJoin(F.broadcast(null))
    reached = F.size(F.filter("nulls", lambda x: x >= F.col("mass")))
    return j.select(*keys, "cluster", "start", "end", "mass", ((reached + 1) / (F.size("nulls") + 1)).alias("p"))


def combined_p(p: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, p, z): geometric mean of p-values clipped at 1e-15, and its normal quantile."""
    g = p.groupBy(*keys).agg(F.exp(F.avg(F.ln(F.greatest(F.col(column), F.lit(1e-15))))).alias("p"))

    @F.pandas_udf("double")
    def z(v):
        return v.map(lambda x: special.normal_ppf(1 - x))

    return g.withColumn("z", z("p"))


def parametric(stats: DataFrame, statistic: str, df1=None, df2=None) -> DataFrame:
    """Adds p of the column t (two-sided, df2) or f (df1, df2). Degrees of freedom are columns or numbers."""
    one = lambda v: v if hasattr(v, "alias") else F.lit(float(v))

    @F.pandas_udf("double")
    def p(v, a, b):
        import pandas as pd

        f = special.t_two_sided if statistic == "t" else None
        return pd.Series([None if x != x else f(x, d2) if f else special.f_sf(x, d1, d2) for x, d1, d2 in zip(v, a, b)])

    return stats.withColumn("p", p(F.col(statistic), one(df1 if df1 is not None else 1.0).cast("double"), one(df2).cast("double")))


# Tests


def across_units(units: DataFrame, n: int = 1000, method: str = "univariate", block: str | None = None, how: str = "free", fwer: bool = False, seed: int = 0, chunk: int = 200, keys: tuple[str, ...] = (), levels: tuple[str, ...] = ()) -> DataFrame:
    """Test of d against r over units. how: free, within, between or both (of block), or tree (of nested blocks, whose
    columns are levels, as `tree_permutations` takes them), or distinct (the same without repeats) or exact (each shuffle
    of the tree once, whatever n says; for both, no levels: all orders of the units). method: univariate (a correlation
    for each pair), multivariate (all predictors, an outcome at a time) or cca. n = 0: parametric p. Permutations are
    made `chunk` at a time and only their statistics kept."""
    from . import preprocess

    p, q = preprocess.width(units, "d"), preprocess.width(units, "r")
    kept = units.where(F.forall("d", lambda v: v.isNotNull() & ~F.isnan(v))) if method != "univariate" else units
    one = cut(kept.select("unit_id", *([block] if block else []), *(c for c in levels if c != block)).distinct())
    make = {
        "free": lambda a, b: permutations(one, b, seed, None, a),
        "within": lambda a, b: permutations(one, b, seed, block, a),
        "between": lambda a, b: block_permutations(one, b, seed, block, a),
        "both": lambda a, b: both_permutations(one, b, seed, block, a),
        "tree": lambda a, b: tree_permutations(one, list(levels), b, seed, True, a),
    }
    if how == "exact" and n:
        every = exchange.Shuffles(one, list(levels))
        n, make[how] = every.total, every.between
    elif how == "distinct" and n:
        ids, made = exchange.without_repeats(one, list(levels), n, seed)
        n, make[how] = ids.count(), lambda a, b: made(ids.where(F.col("perm_id").between(a, b - 1)))
    elif how in ("exact", "distinct"):
        how = "free"  # the identity alone
    if how not in make or (how == "tree" and not levels) or (how in ("within", "between", "both") and not block):
        raise ValueError("how is free, exact or distinct, with a block within, between or both, or with levels tree")
    of = {"univariate": (lambda s: correlation_stats(kept, s, *keys), "t", ("p", "q")), "multivariate": (lambda s: multiple_regression(kept, s, p, q, *keys), "f", ("q",)), "cca": (lambda s: canonical(kept, s, p, q, 1, *keys), "r", ("component",))}
    if method not in of:
        raise ValueError(f"method is one of {sorted(of)}")
    stat_of, stat, tests = of[method]
    if not n:
        base = stat_of(make[how](0, 1))
        if method == "univariate":
            return parametric(base, "t", df2=F.col("n") - 2)
        return parametric(base, "f", df1=p, df2=F.col("n") - p) if method == "multivariate" else base
    # each chunk makes its own permutations only, and leaves a row for each of them and test
    parts = [stat_of(make[how](a, min(a + chunk, n))).select("perm_id", *keys, *tests, stat) for a in range(0, n, chunk)]
    stats = reduce(DataFrame.unionByName, map(cut, parts)) if len(parts) > 1 else parts[0]
    return max_p_values(stats, stat, tests, keys) if fwer else p_values(stats, stat, *keys, *tests)


def across_columns(units: DataFrame, n: int = 1000, seed: int = 0, block: str | None = None, limit: int = 10, confounds: str | None = None, combine: bool = False) -> DataFrame:
    """(p, q, kind, observed, pv): each predictor with each outcome by the statistic that fits it: t of two groups for
    two distinct values, one-way F for fewer than `limit`, correlation t for others. Two-group t and correlation t of a
    coded predictor are one statistic, so both come from `correlation_stats`. confounds: a vector column that outcomes
    are freed of first. combine: one row (q, kind, p, z) for each outcome and kind, the combined p."""
    from . import preprocess

    p = preprocess.width(units, "d")
    clean = deconfound(units, "r", confounds) if confounds else units
    one = clean.select("unit_id", *([block] if block else [])).distinct()
    perms = permutations(one, max(1, n), seed, block)
    kinds = column_kinds(clean, "d", p, limit)
    plain = [i for i, k in enumerate(kinds) if k != "groups"]
    grouped = [i for i, k in enumerate(kinds) if k == "groups"]
    parts = []
    if plain:
        s = correlation_stats(clean, perms).where(F.col("p").isin(plain))
        parts.append(_column_p(s, "t"))
    if grouped:
        rows = _pairs(clean, perms).where(F.col("p").isin(grouped)).select("perm_id", "p", "q", F.col("x").alias("group"), F.col("y").alias("value"))
        parts.append(_column_p(one_way_f(rows, "perm_id", "p", "q"), "f"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = F.array(*map(F.lit, kinds))
    out = out.select("p", "q", F.get(names, F.col("p")).alias("kind"), "observed", "pv")
    return combined_p(out, "pv", "q", "kind") if combine else out


def _column_p(stats: DataFrame, stat: str) -> DataFrame:
    """(p, q, observed, pv); p-values of `p_values` under a name that leaves the predictor's."""
    s = stats.select("perm_id", F.col("p").alias("i"), "q", F.col(stat).alias("stat"))
    return p_values(s, "stat", "i", "q").select(F.col("i").alias("p"), "q", "observed", F.col("p").alias("pv"))


def across_visits(path: DataFrame, k: int, n: int = 200, pairs: bool = False, how: str = "mean", seed: int = 0, mirrored: bool = False) -> DataFrame:
    """(state[, state_b], observed, p): the signal (value) in a state against the rest, or between states, with visits
    relabelled at random. Means are taken from sums by visit, so a permutation costs a row for each visit; medians need
    all rows. mirrored: one-sided p of pairs, in both orders."""
    from . import summary

    values = path.select("session_id", "t", "value")
    if how == "mean":
        visits = _rows_of(summary.visits(path.select("session_id", "t", "state"))).select("session_id", "onset", "t")
        sums = visits.join(values, ["session_id", "t"]).groupBy("session_id", "onset").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
        runs = summary.visits(path.select("session_id", "t", "state")).join(sums, ["session_id", "onset"])
        s = _relabelled_sums(runs, n, k, seed).groupBy("perm_id", "state").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).withColumn("v", F.col("s") / F.col("c"))
        s = cut(s)
    else:
        labelled = relabelled_visits(path.select("session_id", "t", "state"), n, k, seed).join(values, ["session_id", "t"])
        s = quantiles.quantiles(labelled, "value", [0.5], "perm_id", "state").select("perm_id", "state", F.col("quantiles")[0].alias("v"))
    if pairs:
        a, b = s.select("perm_id", F.col("state").alias("state_a"), F.col("v").alias("va")), s.select("perm_id", F.col("state").alias("state_b"), F.col("v").alias("vb"))
        stats = a.join(b, "perm_id").where("state_a < state_b").withColumn("stat", F.col("va") - F.col("vb"))
        return results.mirrored_p(stats, "stat") if mirrored else p_values(stats, "stat", "state_a", "state_b")
    w = Window.partitionBy("perm_id")
    stats = s.withColumn("stat", F.col("s") / F.col("c") - (F.sum("s").over(w) - F.col("s")) / (F.sum("c").over(w) - F.col("c")))
    return p_values(stats, "stat", "state")


def _relabelled_sums(runs: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """(perm_id, state, s, c): sums of s and c by relabelled state, a task's own: relabelled visits are never rows."""
    import pandas as pd

    made = relabelled(n, k, seed)
    listed = F.sort_array(F.collect_list(F.struct("onset", "state", "s", "c"))).alias("rows")
    packed = runs.groupBy("session_id").agg(listed)
    starts = F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(PERM_CHUNK)))

    def run(batches):
        import pyarrow as pa

        size = k
        total = np.zeros((3, n, size))  # sums, counts, visits
        for b in batches:
            column = b.column(2)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            if not len(ends):
                continue
            _, state, s, c = (v.to_numpy(zero_copy_only=False) for v in column.flatten().flatten())
            s = np.where(c > 0, s.astype(float), 0.0)  # a visit without values has no sum
            for sid, first, a, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                perms, new = made(sid, first, state[a:e])
                most = int(new.max()) + 1
                if most > size:
                    total, size = np.pad(total, ((0, 0), (0, 0), (0, most - size))), most
                at = (np.arange(len(perms))[:, None] * size + new).ravel()
                for i, v in enumerate((s[a:e], c[a:e], np.ones(e - a))):
                    total[i, perms.start : perms.stop] += np.bincount(at, np.tile(v, len(perms)), len(perms) * size).reshape(len(perms), size)
        perm, of = np.nonzero(total[2])
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"perm_id": perm.astype(np.int32), "state": of.astype(np.int32), "s": total[0][perm, of], "c": total[1][perm, of].astype(np.int64)}), preserve_index=False)

    return packed.select("session_id", starts.alias("chunk"), "rows").mapInArrow(run, "perm_id int, state int, s double, c long")


def session_halves(units: DataFrame, seed: int = 0) -> DataFrame:
    """Adds train: every other unit of a session in hash order."""
    w = Window.partitionBy("session_id").orderBy(order_key(seed, F.col("session_id"), F.col("unit_id")), "unit_id")
    return units.withColumn("train", F.row_number().over(w) % 2 == 1)


def across_sessions(units: DataFrame, p: int, q: int, n: int = 200, seed: int = 0, ridge: float = 0.001) -> DataFrame:
    """(q, observed, p): coefficients are fitted on half of each session and given to sessions at random; the
    statistic is the share of variance they explain in the other halves. Sessions are shuffled, not units."""
    import pandas as pd

    # moments of each half about its means, as one aggregation; the algebra is done for a batch of sessions at once
    halves = session_halves(units, seed).where(F.col("session_id").isNotNull())
    d, r = [F.col("d")[i] for i in range(p)], [F.col("r")[i] for i in range(q)]

    def moment(a, b, half: bool):
        a, b = (F.coalesce(v.cast("double"), F.lit(float("nan"))) for v in (a, b))
        on = F.col("train") == half
        return F.coalesce(F.covar_pop(F.when(on, a), F.when(on, b)) * F.count_if(on), F.lit(0.0))

    def moments(half: bool, *pairs):
        return F.array(*(moment(a, b, half) for a, b in pairs))

    dd, dr = [(a, b) for a in d for b in d], [(a, b) for a in d for b in r]
    m = halves.groupBy("session_id").agg(moments(True, *dd).alias("a"), moments(True, *dr).alias("b"), moments(False, *dd).alias("dd"), moments(False, *dr).alias("dr"), moments(False, *((b, b) for b in r)).alias("rr"))
    stack = lambda column, *shape: np.stack(column.to_numpy()).astype(float).reshape(-1, *shape)

    @F.pandas_udf("array<double>")
    def solved(a, b):
        if not len(a):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.linalg.solve(stack(a, p, p) + ridge * np.eye(p), stack(b, p, q)).reshape(len(a), -1)))

    fits = cut(m.select("session_id", solved("a", "b").alias("beta"), "dd", "dr", "rr"))
    perms = permutations(fits.select(F.col("session_id").alias("unit_id")), n, seed)
    j = perms.join(fits.select(F.col("session_id").alias("dst"), "dd", "dr", "rr"), "dst").join(fits.select(F.col("session_id").alias("src"), "beta"), "src")

    def score(frames):
        for f in frames:
            if not len(f):
                continue
            b, rr = stack(f["beta"], p, q), stack(f["rr"], q)
            sse = rr - 2 * (b * stack(f["dr"], p, q)).sum(1) + np.einsum("nij,nik,nkj->nj", b, stack(f["dd"], p, p), b)
            ids, at = np.unique(f["perm_id"].to_numpy(), return_inverse=True)
            sums = np.zeros((2, len(ids), q))
            np.add.at(sums[0], at, sse)
            np.add.at(sums[1], at, rr)
            yield pd.DataFrame({"perm_id": np.repeat(ids, q), "q": np.tile(np.arange(q), len(ids)), "sse": sums[0].ravel(), "sst": sums[1].ravel()})

    s = j.mapInPandas(score, "perm_id int, q int, sse double, sst double").groupBy("perm_id", "q").agg((1 - F.sum("sse") / F.sum("sst")).alias("stat"))
    return p_values(s, "stat", "q", two_sided=False)
