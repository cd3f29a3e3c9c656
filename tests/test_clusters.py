"""Exact quantiles, components and cluster correction against brute force."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateloom.operators import clusters, graph, quantiles

AT = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]


def brute_quantiles(values, at=AT):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    return [None] * len(at) if not v else [float(x) for x in np.quantile(np.array(v), at)]


@pytest.mark.parametrize("few", [4096, 3])
def test_quantiles(spark, monkeypatch, few):
    """Ties, a heavy value, wide spreads, infinite values, NaN, nulls, null keys, a single value and none."""
    monkeypatch.setattr(quantiles, "FEW", few)
    r = np.random.default_rng(2)
    groups = {
        "normal": r.normal(size=500), "ties": r.integers(0, 4, 300).astype(float), "heavy": np.append(np.zeros(400), [1e300, -1e300, 5.0]),
        "wide": np.exp(r.normal(size=300) * 80) * r.choice([-1, 1], 300), "tiny": np.array([5e-324, 1e-323, 0.0, -5e-324] * 5), "one": np.array([7.0]),
        "same": np.full(50, 3.5), None: r.normal(size=40), "nothing": np.array([math.nan, math.nan]), "pair": np.array([1.0, 2.0]),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("normal", None), ("ties", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    out = {x["k"]: (x["n"], x["quantiles"]) for x in quantiles.quantiles(df, "v", AT, "k").collect()}
    assert out.keys() == groups.keys()
    for k, v in groups.items():
        want = brute_quantiles(v)
        assert out[k][0] == sum(not math.isnan(x) for x in v)
        assert all(a == b if a is None or b is None else math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300) for a, b in zip(out[k][1], want)), (k, out[k], want)


def test_quantiles_of_infinite_values_and_without_keys(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 2)
    v = [-math.inf] * 3 + [float(i) for i in range(20)] + [math.inf] * 2 + [1.7e308, -1.7e308]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = quantiles.quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]).first()
    s = sorted(v)
    assert got["n"] == 27 and got["quantiles"][:1] == [-math.inf] and got["quantiles"][2] == s[13] and got["quantiles"][3] == math.inf
    assert math.isclose(got["quantiles"][1], (s[6] + s[7]) / 2)
    empty = quantiles.quantiles(df.limit(0), "v", [0.5])
    assert [tuple(r) for r in empty.collect()] == [(0, [None])]
    assert quantiles.quantiles(df.limit(0).withColumn("k", F.lit(1)), "v", [0.5], "k").count() == 0
    with pytest.raises(ValueError):
        quantiles.quantiles(df, "v", [1.5])


def test_large_groups_are_not_gathered(spark, monkeypatch):
    """The last step ranks at most FEW rows of each target."""
    monkeypatch.setattr(quantiles, "FEW", 100)
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.abs(F.xxhash64("id")).cast("double").alias("v"))
    out = {r["k"]: r["quantiles"] for r in quantiles.quantiles(df, "v", AT, "k").collect()}
    for k, got in out.items():
        v = [r["v"] for r in df.where(F.col("k") == k).collect()]
        assert np.allclose(got, brute_quantiles(v), rtol=1e-12)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    r = np.random.default_rng(1)
    edges = chain + [(int(a), int(b)) for a, b in r.integers(0, 90, (50, 2))] + [(500, 500), (None, 3), (7, None)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in list(root)}


def brute_correction(maps, alpha, how):
    """maps: (permutations, cells...) with NaN for missing cells."""
    n, shape = len(maps), maps.shape[1:]
    limit = np.nanquantile(maps, 1 - alpha, axis=0)
    sd = np.nanstd(maps, axis=0)
    if how == "raw":
        passed = np.where((maps >= limit) & (maps > 0), maps, 0)
    else:
        z = (maps - np.nanmean(maps, axis=0)) / np.where(sd > 0, sd, np.nan)
        passed = np.where(z >= NormalDist().inv_cdf(1 - alpha), z, 0)
    passed = np.nan_to_num(passed)
    tops, observed = [], None
    for k in range(n):
        left, found = {tuple(c) for c in np.argwhere(passed[k] > 0)}, []
        while left:
            todo, part = [min(left)], set()
            while todo:
                c = todo.pop()
                if c in left:
                    left.discard(c)
                    part.add(c)
                    todo += [tuple(np.add(c, d)) for d in np.ndindex(*[3] * len(shape)) for d in [np.array(d) - 1]]
            found.append(part)
        mass = [sum(passed[k][c] for c in p) for p in found]
        tops.append(max(mass, default=0.0))
        if k == 0:
            observed = [(min(p), p, m) for p, m in zip(found, mass)]
    at = np.quantile(tops, 1 - alpha)
    out = {}
    for number, (_, part, m) in enumerate(sorted(observed, key=lambda x: x[0])):
        p = (sum(t >= m for t in tops[1:]) + 1) / n
        for c in part:
            out[c] = (passed[0][c], number, m, m >= at, p)
    return out, at


@pytest.mark.parametrize(("shape", "how", "alpha"), [((9, 7), "raw", 0.2), ((9, 7), "z", 0.05), ((4, 5, 3), "raw", 0.3), ((25,), "z", 0.1)])
def test_cluster_correction(spark, shape, how, alpha):
    r = np.random.default_rng(len(shape))
    maps = r.normal(size=(12, *shape))
    maps[0][tuple(slice(0, 3) for _ in shape)] += 1.5
    maps[:, *(0 for _ in shape)] = 2.0  # does not vary
    maps[3, *(1 for _ in shape)] = np.nan
    axes = ("a", "b", "c")[: len(shape)]
    rows = [(k, "x", *map(int, c), float(maps[(k, *c)])) for k in range(12) for c in np.ndindex(*shape)]
    rows += [(k, None, *map(int, c), -float(maps[(k, *c)])) for k in range(12) for c in np.ndindex(*shape)]
    df = spark.createDataFrame(rows, "perm_id int, part string, " + ", ".join(f"{a} int" for a in axes) + ", s double")
    out = clusters.cluster_correction(df, axes, "s", alpha, how, "part").collect()
    for part, m in (("x", maps), (None, -maps)):
        want, at = brute_correction(m, alpha, how)
        got = {tuple(x[a] for a in axes): x for x in out if x["part"] == part}
        assert got.keys() == want.keys() and (part is None or got)
        for c, (value, number, mass, kept, p) in want.items():
            x = got[c]
            assert math.isclose(x["value"], value, rel_tol=1e-9) and math.isclose(x["mass"], mass, rel_tol=1e-9) and math.isclose(x["limit"], at, rel_tol=1e-9, abs_tol=1e-12)
            assert (x["cluster"], x["kept"]) == (number, kept) and math.isclose(x["cluster_p"], p)


def test_corrected_p(spark):
    found = spark.createDataFrame([(3, 2.0, True), (4, 1.8, True), (9, 1.7, False)], "tau int, value double, kept boolean")
    cells = spark.createDataFrame([(t, 0.01) for t in range(10)], "tau int, p double")
    own = {r["tau"]: r["q"] for r in clusters.corrected_p(found, cells, "p").collect()}
    assert own == {t: 0.01 if t in (3, 4) else 1.0 for t in range(10)}
    tail = {r["tau"]: r["q"] for r in clusters.corrected_p(found, cells).collect()}
    assert math.isclose(tail[3], 0.5 * math.erfc(2 / math.sqrt(2))) and tail[9] == 1.0


def test_nothing(spark):
    df = spark.createDataFrame([], "perm_id int, tau int, stat double")
    assert clusters.cluster_correction(df).count() == 0
