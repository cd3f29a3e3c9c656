"""Shuffles of nested blocks by number, against brute force."""

import itertools
import math

import pytest

from stateloom.operators import exchange, testing

# two blocks of two pairs change places and so do their pairs; block -3 keeps its pairs in place
ROWS = [(i, b, p) for i, (b, p) in enumerate([(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (-3, 1), (-3, 1), (-3, 2), (-3, 2)])]


def maps(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.perm_id, {})[r.dst] = r.src
    return {k: tuple(v[i] for i in sorted(v)) for k, v in out.items()}


def brute(rows):
    """Shuffles of ROWS[:8] by trying all that keep pairs and blocks."""
    n = len(rows)
    pair, block = [r[1:] for r in rows], [r[1] for r in rows]
    keep = lambda m, of: len({(of[i], of[m[i]]) for i in range(n)}) == len(set(of))
    return {m for m in itertools.permutations(range(n)) if keep(m, pair) and keep(m, block)}


def test_every_shuffle_once(spark):
    u = spark.createDataFrame(ROWS[:8], "unit_id long, block int, pair int")
    found = maps(exchange.every_shuffle(u, ["block", "pair"]))
    theirs = brute(ROWS[:8])
    assert sorted(found) == list(range(len(theirs))) and found[0] == tuple(range(8))
    assert set(found.values()) == theirs and len(theirs) == 2 * 2 * 2 * 2**4
    assert exchange.log_shuffles(u, ["block", "pair"]) == pytest.approx(math.log(len(theirs)))


def test_signs_and_free_orders(spark):
    u = spark.createDataFrame(ROWS, "unit_id long, block int, pair int")
    s = exchange.Shuffles(u, ["block", "pair"])
    assert s.total == 128 * 4
    some = maps(s.between(100, 140))
    assert sorted(some) == list(range(100, 140)) and len(set(some.values())) == 40
    assert all({m[8], m[9]} == {8, 9} and {m[10], m[11]} == {10, 11} for m in some.values())
    still = exchange.Shuffles(u, ["block", "pair"], whole=False)
    assert still.total == 256
    four = u.where("unit_id < 4")
    assert sorted(maps(exchange.every_shuffle(four)).values()) == sorted(itertools.permutations(range(4)))
    assert list(maps(exchange.every_shuffle(four)).items())[:1] and maps(exchange.every_shuffle(four))[1] == (0, 1, 3, 2)
    with pytest.raises(ValueError):
        exchange.every_shuffle(u, ["block", "pair"], most=511)
    assert exchange.log_shuffles(spark.range(1000).toDF("unit_id")) == pytest.approx(math.lgamma(1001), rel=1e-12)


def test_no_units_and_one(spark):
    u = spark.createDataFrame(ROWS, "unit_id long, block int, pair int")
    none, one = u.where("unit_id < 0"), u.where("unit_id = 3")
    assert exchange.log_shuffles(none, ["block"]) == 0 and exchange.every_shuffle(none, ["block"]).count() == 0
    assert maps(exchange.every_shuffle(one, ["block", "pair"])) == {0: (3,)}
    assert exchange.distinct_shuffles(none, ["block"], 3).count() == 0 and maps(exchange.distinct_shuffles(one, [], 3)) == {0: (3,)}


def test_random_sets_do_not_repeat(spark, monkeypatch):
    u = spark.createDataFrame(ROWS[:8], "unit_id long, block int, pair int")
    theirs = brute(ROWS[:8])
    # few shuffles: by number
    for n in (50, 500):
        found = maps(exchange.distinct_shuffles(u, ["block", "pair"], n, 3))
        assert sorted(found) == list(range(min(n, 128))) and found[0] == tuple(range(8)) and len(set(found.values())) == len(found)
    # many: drawn, and drawn anew where they repeat
    monkeypatch.setattr(exchange.math, "log", lambda v: -1.0)
    drawn = maps(exchange.distinct_shuffles(u, ["block", "pair"], 60, 3))
    assert sorted(drawn) == list(range(60)) and drawn[0] == tuple(range(8))
    assert len(set(drawn.values())) == 60 and set(drawn.values()) <= theirs


def test_exact_and_distinct_p(spark):
    x, y = [1.0, 2.0, 4.0, 3.0, 6.0], [2.0, 1.0, 3.5, 5.0, 4.5]
    u = spark.createDataFrame([(i, [a], [b]) for i, (a, b) in enumerate(zip(x, y))], "unit_id long, d array<double>, r array<double>")
    dot = lambda m: abs(sum(a * y[j] for a, j in zip(x, m)) - sum(x) * sum(y) / 5)
    share = sum(dot(m) >= dot(range(5)) - 1e-9 for m in itertools.permutations(range(5))) / 120
    for how, n in (("exact", 7), ("distinct", 1000)):
        assert testing.across_units(u, n, how=how, chunk=50).toDF("i", "q", "observed", "p").first()["p"] == pytest.approx(share, abs=1.5 / 120)
    assert testing.across_units(u, 0, how="exact").collect() == testing.across_units(u, 0).collect()
