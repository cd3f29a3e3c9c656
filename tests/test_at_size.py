"""Steps that failed on larger tables: sums made twice, joins that multiply, groups of rows in Python objects."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateloom.operators import testing as T
from stateloom.plans import inference, registry


def test_identity_reaches_itself_where_sums_differ_in_the_last_digits(spark):
    noisy = F.udf(lambda k: 1.0 + random.random() * 1e-12, "double").asNondeterministic()
    s = spark.range(64).select(F.lit(0).alias("perm_id"), F.col("id").alias("tau")).withColumn("t", noisy("tau"))
    assert [r["p"] for r in T.p_values(s, "t", "tau").collect()] == [1.0] * 64


def test_fixed_predictors_give_the_statistics_of_the_full_grid(spark):
    r = np.random.default_rng(3)
    units = spark.createDataFrame([(u, [float(r.integers(9)), None if u % 7 == 0 else float(r.normal())]) for u in range(40)], "unit_id long, d array<double>")
    rows = [(u, c, [float(r.normal() + 1e6), float("nan") if (u + c) % 5 == 0 else float(u * c)]) for u in range(40) for c in range(3) if (u + c) % 4]
    cells = spark.createDataFrame([*rows, (1, 9, [2.0, 3.0]), (2, 9, [2.0, 3.0]), (3, 9, [2.0, 3.0])], "unit_id long, c int, r array<double>")
    perms = T.permutations(units, 4, 5).cache()
    grid = units.crossJoin(cells.select("c").distinct()).join(cells, ["unit_id", "c"], "left")
    key = lambda x: (x["perm_id"], x["c"], x["p"], x["q"])
    want = {key(x): x for x in T.correlation_stats(grid, perms, "c").collect()}
    got = {key(x): x for x in T.fixed_predictor_stats(units, cells, perms, "c").collect()}
    assert set(got) == set(want) and len(got) > 40
    for k, w in want.items():
        assert got[k]["n"] == w["n"] and (got[k]["r"] is None) == (w["r"] is None)
        assert w["r"] is None or abs(got[k]["r"] - w["r"]) < 1e-8
    # no row of a permuted outcome: a row for each unit goes into the sums
    plan = T.fixed_predictor_stats(units, cells, perms, "c")._jdf.queryExecution().toString()
    assert "ArrayJoin" not in plan and "MapInArrow" in plan


def test_packed_sessions_stay_in_arrow_buffers(spark, monkeypatch):
    from stateloom.operators import blocks, hmm
    from stateloom.plans.series import fixed_model

    m, r = fixed_model(), np.random.default_rng(1)
    rows = [(s, t, [float(r.normal())]) for s in range(7) for t in range(1 + 5 * s)]
    obs = spark.createDataFrame(rows, "session_id long, t int, y array<double>")
    # no row of a session becomes a Python object, no group of rows a pandas frame
    for f in (hmm.decode, hmm.viterbi, hmm.loglik, hmm.entropy, lambda o, m: blocks.decode(o, m, 4), lambda o, m: blocks.viterbi(o, m, 4)):
        plan = f(obs, m)._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan and "FlatMapGroups" not in plan
    one = {(x["session_id"], x["t"]): x["gamma"] for x in hmm.decode(obs, m).collect()}
    two = {(x["session_id"], x["t"]): x["gamma"] for x in blocks.decode(obs, m, 4).collect()}
    assert len(one) == len(rows) and all(np.allclose(one[k], two[k]) for k in one)
    alone = [x["stats"] for x in hmm.statistics(hmm.packed(obs), m, per_session=True).collect()]
    total = hmm.statistics(hmm.packed(obs), m)
    layout = hmm.Layout(m.spec, m.p, m.q)
    assert all(np.allclose(v, total[k]) for k, v in layout.read(np.sum(alone, 0)).items())


def test_tests_of_sessions_and_visits_make_no_group_of_rows(spark):
    r = np.random.default_rng(2)
    path = spark.createDataFrame([(s, t, int(r.integers(3)), float(r.normal())) for s in range(6) for t in range(30)], "session_id long, t int, state int, value double")
    plans = [T._relabelled_sums(path.selectExpr("session_id", "t as onset", "state", "value as s", "1L as c"), 5, 3, 0), T.relabelled_runs(path, 5, 3)]
    assert all("FlatMapGroups" not in p._jdf.queryExecution().toString() for p in plans)
    sums = {(x["perm_id"], x["state"]): (x["s"], x["c"]) for x in plans[0].groupBy("perm_id", "state").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).collect()}
    rows = path.collect()
    for k in range(3):
        own = [x["value"] for x in rows if x["state"] == k]
        assert abs(sums[0, k][0] - sum(own)) < 1e-9 and sums[0, k][1] == len(own)
    assert sum(c for (p, _), (_, c) in sums.items() if p == 4) == len(rows)


def test_values_travel_with_permutations(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(u, u % 3, [float(r.normal()), None if u % 9 == 0 else float(u)], [float(r.normal()) if u % 5 else float("nan")]) for u in range(90)]
    units = spark.createDataFrame(rows, "unit_id long, block int, d array<double>, r array<double>")
    for most in (100_000, 20):
        monkeypatch.setattr(T, "RANK_ROWS", most)
        perms = T.permutations(units, 6, 5, "block", carry=True)
        alone = T.permutations(units, 6, 5, "block")
        ids = lambda p: sorted(map(tuple, p.select("perm_id", "dst", "src").collect()))
        assert ids(perms) == ids(alone) and len(ids(perms)) == 540
        key = lambda x: (x["perm_id"], x["p"], x["q"])
        want = {key(x): x for x in T.correlation_stats(units, alone).collect()}
        got = {key(x): x for x in T.correlation_stats(units, perms).collect()}
        assert set(got) == set(want) and all(got[k]["n"] == want[k]["n"] and abs(got[k]["t"] - want[k]["t"]) < 1e-9 for k in want)
    # the only joins are by place and of the buckets' sizes, and no key crosses a shuffle
    plan = T.correlation_stats(units, perms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4 < T.correlation_stats(units, alone)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert not any("key" in line for line in perms._jdf.queryExecution().sparkPlan().toString().splitlines() if "Exchange" in line)


def test_outcomes_of_fixed_predictors_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(u):
        made.add(1)
        return float(u % 5)

    units = spark.range(30).select(F.col("id").alias("unit_id"), F.array(F.col("id").cast("double")).alias("d")).cache()
    outcomes = units.select("unit_id", F.lit(1).alias("c"), F.array(F.udf(counted, "double").asNondeterministic()("unit_id")).alias("r"))
    perms = T.permutations(units, 3, 5, carry=True)
    assert set(perms.columns) == {"perm_id", "dst", "src", "d"}
    got = T.fixed_predictor_stats(units, outcomes, perms, "c")
    assert got.count() == 3 and made.value == 30
    # predictors came with the permutations: the joins are by place and by unit
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def rows_by_sql(query, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    out = con.execute(registry.SQL[query])
    return [c[0] for c in out.description], out.fetchall()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("query", ["bonferroni", "combine_p", "corrections", "holm", "mean_of_p", "sig_intervals", "test_summary"])
def test_tests_by_hour_where_sums_differ_in_the_last_digits(spark, query, monkeypatch):
    # many executors add in another order each time that a statistic is made
    noisy = F.udf(lambda t: t * (1 + random.random() * 1e-12), "double").asNondeterministic()
    made = inference._hour_stats
    monkeypatch.setattr(inference, "_hour_stats", lambda *a: made(*a).withColumn("t", noisy("t")))
    columns, want = rows_by_sql(query, "/root/testdata/sf0.001")
    told = lambda rs: sorted((tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r) for r in rs), key=repr)
    assert told(registry.QUERIES[query](spark, "/root/testdata/sf0.001").select(*(f"`{c}`" for c in columns)).collect()) == told(want)


def test_kernel_blocks_meet_as_rows(spark, monkeypatch):
    from stateloom.operators import predict

    monkeypatch.setattr(predict, "PIECE", 64)
    r = np.random.default_rng(8)
    v = r.normal(size=(90, 3))
    f = spark.createDataFrame([(f"s{i:02d}", [float(x) for x in v[i]]) for i in range(90)], "session_id string, features array<double>")
    for shape in ("linear", "gaussian"):
        got = {(x["a"], x["b"]): x["value"] for x in predict.kernel(f, shape, 2.0, block=16).collect()}
        want = v @ v.T if shape == "linear" else np.exp(-((v[:, None] - v[None]) ** 2).sum(2) / 8)
        assert len(got) == 90 * 91 // 2 and all(abs(got[f"s{i:02d}", f"s{j:02d}"] - want[i, j]) < 1e-9 for i in range(90) for j in range(i, 90))
    # blocks are rows: no session is sent for each pair of blocks
    plan = predict.kernel(f, block=16)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "BroadcastHashJoin" not in plan
    assert predict.kernel(f.limit(0)).count() == 0


def test_sweep_trains_all_runs_together_and_until_they_converge(spark, monkeypatch):
    from stateloom.operators import hmm, summary

    r = np.random.default_rng(4)
    rows = [(s, t, [float(r.normal() + 3 * (t // 6 % 3))]) for s in range(5) for t in range(30 + s)]
    obs = spark.createDataFrame(rows, "session_id long, t int, y array<double>")
    of, passes = hmm._statistics_of, []
    monkeypatch.setattr(hmm, "_statistics_of", lambda sessions, models, seeds=None: passes.append(len(models)) or of(sessions, models, seeds))
    o = hmm.Options(cycles=12, starts=2, start_cycles=2, least=2.0)
    got = {(x["n_states"], x["repeat"]): x for x in hmm.sweep(obs, [2, 3, 4], 2, hmm.Spec(2, "diag", "state", "no"), o).collect()}
    # six runs: their starts together, then themselves
    assert passes[:3] == [12, 12, 12] and max(passes[3:]) == 6 and len(passes) <= 3 + 12
    for k in (2, 3):  # as each alone
        alone = []
        for rep in (0, 1):
            one = hmm.copy.copy(o)
            one.seed = 97 * rep
            m = hmm.train(obs, hmm.Spec(k, "diag", "state", "no"), one)
            alone.append(hmm.decode(obs, m))
            assert abs(m.trace[-1] - got[k, rep]["free_energy"]) < 1e-6 and len(m.trace) == got[k, rep]["cycles"]
        assert got[k, 0]["similarity"] is None and abs(got[k, 1]["similarity"] - summary.similarity(*alone)[0]) < 1e-6
    chosen = {x["n_states"]: x for x in hmm.selection(spark.createDataFrame(list(got.values()), "n_states int, repeat int, free_energy double, cycles int, converged boolean, similarity double")).collect()}
    fe = [chosen[k]["free_energy"] for k in (2, 3, 4)]
    # the first run's likeness to itself is no evidence, and there is a bend
    assert chosen[3]["similarity"] == got[3, 1]["similarity"] and abs(chosen[3]["bend"] - (fe[0] - 2 * fe[1] + fe[2])) < 1e-9
    asked = {}
    monkeypatch.setattr(hmm, "sweep", lambda obs, states, repeats, spec, options=None: asked.update(states=states, repeats=repeats, options=options or hmm.Options()) or spark.createDataFrame(list(got.values()), "n_states int, repeat int, free_energy double, cycles int, converged boolean, similarity double"))
    registry.QUERIES["model_selection"](spark, "/root/testdata/sf0.001")
    assert len(asked["states"]) >= 3 and asked["repeats"] >= 2 and asked["options"].cycles == 100
