"""Families of twin tables against brute force over random pedigrees."""

import itertools
import random

from stateloom.operators import exchange, families, testing

TABLE = "unit_id long, mother string, father string, zygosity string"


def kinds(rows):
    """(mother, father, kind) of each subject; missing parents are their own, lone twins ordinary."""
    key = {u: (m or f"?{u}", f or f"?{u}") for u, m, f, _ in rows}
    of = {u: z if z in ("MZ", "DZ") else "" for u, _, _, z in rows}
    count = lambda u: sum(key[v] == key[u] and of[v] == of[u] for v in key)
    return {u: (*key[u], of[u] if of[u] and count(u) > 1 else "") for u in key}


def family_of(told):
    group = {u: {u} for u in told}
    for a, b in itertools.combinations(told, 2):
        if (told[a][0] == told[b][0] or told[a][1] == told[b][1]) and group[a] is not group[b]:
            both = group[a] | group[b]
            for v in both:
                group[v] = both
    return {u: frozenset(g) for u, g in group.items()}


def same(told, a, b):
    """Whether units a, in this order, stand to each other as units b do."""
    return all(len({(told[x][i], told[y][i]) for x, y in zip(a, b)}) == len({told[x][i] for x in a}) == len({told[y][i] for y in b}) for i in (0, 1)) and all(told[x][2] == told[y][2] for x, y in zip(a, b))


def test_random_pedigrees(spark):
    r = random.Random(5)
    rows = []
    for family in range(40):
        for _ in range(r.randint(1, 5)):
            parent = lambda s: None if r.random() < 0.05 else f"{s}{family}.{r.randint(0, 2)}"
            rows.append((len(rows), parent("m"), parent("f"), r.choice(["MZ", "mz ", "DZ", "NotTwin", None])))
    clean = [(u, m, f, (z or "").strip().upper()) for u, m, f, z in rows]
    told = kinds(clean)
    of = family_of(told)
    out = {x.unit_id: x for x in families.family_blocks(spark.createDataFrame(rows + rows[:3] + [(None, "a", "b", "MZ")], TABLE)).collect()}
    assert sorted(out) == list(range(len(rows)))
    for a, b in itertools.combinations(out, 2):
        assert (out[a].family == out[b].family) == (of[a] == of[b])
        assert ((out[a].family, out[a].sibship) == (out[b].family, out[b].sibship)) == (told[a] == told[b])
    # one type exactly where some order of one family stands as the other
    groups = sorted(map(sorted, set(of.values())))
    assert len(groups) > 20
    for a, b in itertools.combinations(groups, 2):
        alike = len(a) == len(b) and any(same(told, a, p) for p in itertools.permutations(b))
        assert (out[a[0]].type == out[b[0]].type) == alike


def test_shuffles_keep_pedigrees(spark):
    # a chain of half-siblings twice, a pair of twins twice, a mother of three by three fathers, an only child
    chain = lambda n, k: [(n, f"a{k}", f"x{k}", "MZ"), (n + 1, f"a{k}", f"x{k}", "MZ"), (n + 2, f"a{k}", f"y{k}", ""), (n + 3, f"b{k}", f"y{k}", "")]
    twins = lambda n, k: [(n, f"c{k}", f"z{k}", "DZ"), (n + 1, f"c{k}", f"z{k}", "DZ")]
    rows = chain(0, 0) + chain(4, 1)[::-1] + twins(8, 0) + twins(10, 1) + [(12 + i, "d", f"w{i}", "") for i in range(3)] + [(15, None, None, None)]
    told = kinds(rows)
    blocks = families.family_blocks(spark.createDataFrame(rows, TABLE))
    all_of = exchange.Shuffles(blocks, families.LEVELS, whole=False)
    assert all_of.total == 2 * 2 * 2 * 2 * 2 * 2  # two swaps of families, four of twins
    seen = {}
    for x in all_of.between(0, 64).collect():
        seen.setdefault(x.perm_id, {})[x.dst] = x.src
    units = sorted(told)
    assert len({tuple(m[u] for u in units) for m in seen.values()}) == 64
    assert all(same(told, units, [m[u] for u in units]) for m in seen.values())
    drawn = {}
    for x in testing.tree_permutations(blocks, families.LEVELS, 5, 1, whole=False).collect():
        drawn.setdefault(x.perm_id, {})[x.dst] = x.src
    assert all(same(told, units, [m[u] for u in units]) for m in drawn.values())


def test_no_subjects(spark):
    assert families.family_blocks(spark.createDataFrame([], TABLE)).count() == 0
