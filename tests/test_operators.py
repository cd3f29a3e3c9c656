"""Hand-checkable cases and invariants of the library's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateloom.functions import chain, dsp, special
from stateloom.operators import hmm, index, predict, preprocess, results, spectral, summary, testing


def path_of(spark, *sessions):
    return spark.createDataFrame([(s, t, "AB".index(c)) for s, p in enumerate(sessions) for t, c in enumerate(p)], "session_id int, t int, state int")


def series(spark, *sessions):
    return spark.createDataFrame([(s, t, np.atleast_1d(v).astype(float).tolist()) for s, p in enumerate(sessions) for t, v in enumerate(p)], "session_id int, t int, y array<double>")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_visits_and_life_times(spark):
    p = path_of(spark, "AABAAA", "BB")
    assert rows(summary.visits(p).where("session_id = 0 and state = 0"), "onset", "length") == [(0, 2), (3, 3)]
    assert rows(summary.life_times(p, 2, threshold=2).where("session_id = 0"), "state", "mean", "max") == [(0, 3.0, 3.0), (1, 0.0, 0.0)]
    assert rows(summary.transition_counts(p), "source", "target", "n") == [(0, 0, 3), (0, 1, 1), (1, 0, 1), (1, 1, 1)]


def test_occupancy_and_switching(spark):
    g = path_of(spark, "AABAAA", "BB").select("session_id", "t", F.array((F.col("state") == 0).cast("double"), (F.col("state") == 1).cast("double")).alias("gamma"))
    assert rows(summary.occupancy(g).where("session_id = 0"), "state", "fo") == [(0, 5 / 6), (1, 1 / 6)]
    assert rows(summary.switching_rate(g).where("session_id = 0"), "state", "rate") == [(0, 0.4), (1, 0.4)]
    assert summary.similarity(g, g)[0] == pytest.approx(1)
    assert index.is_one_hot(g) and rows(index.labels_of(g).where("session_id = 1"), "state") == [(1,), (1,)]
    with pytest.raises(ValueError):
        summary.evoked_response(g)


def test_assignment_is_the_cheapest():
    from itertools import permutations

    r = np.random.default_rng(0)
    for n in (1, 2, 5, 6):
        c = r.random((n, n))
        to = summary.assign(c)
        assert sorted(to) == list(range(n))
        assert c[np.arange(n), to].sum() == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def test_embeddings(spark):
    o = series(spark, [1, 2, 3, 4, 5])
    assert [(r.t, r.y) for r in preprocess.embed_lags(o, (-1, 0, 1)).orderBy("t").collect()] == [(0, [3, 2, 1]), (1, [4, 3, 2]), (2, [5, 4, 3])]
    a = preprocess.autoregress(o, 2, center=False).orderBy("t").collect()
    assert [(r.y, r.x) for r in a] == [([3], [2, 1]), ([4], [3, 2]), ([5], [4, 3])]


def test_epochs_drop_close_events_and_those_that_leave(spark):
    o = series(spark, range(30))
    at = lambda *t: sorted({r.event_t for r in index.event_epochs(o, spark.createDataFrame([(0, x) for x in t], "session_id int, t int"), 0, 4).collect()})
    assert at(2, 10, 12, 20, 28) == [2, 10, 20]
    assert at(2, 4, 20) == [20]


def test_padding_goes_back_to_the_original_rows(spark):
    p = path_of(spark, "ABB")
    assert [r.state for r in index.pad_path(p, (-1, 0, 2)).orderBy("t").collect()] == [0, 0, 0, 1, 1, 1]


def test_special_functions():
    assert float(special.digamma(2.5)) == pytest.approx(0.7031566406452432, abs=1e-12)
    assert float(special.gammaln(0.3)) == pytest.approx(math.lgamma(0.3), rel=1e-12)
    assert special.normal_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert special.f_sf(4.0, 1, 10) == pytest.approx(special.t_two_sided(2.0, 10), rel=1e-10) == pytest.approx(0.0733880347707404, rel=1e-8)
    a = np.array([[2.0, 0.3], [0.3, 1.0]])
    assert special.wishart_kl(5.0, a, 5.0, a) == pytest.approx(0, abs=1e-9) and special.gauss_kl(np.ones(2), a, np.ones(2), a) == pytest.approx(0, abs=1e-9)
    assert special.dirichlet_kl(np.array([2.0, 3.0]), np.array([1.0, 1.0])) > 0


def test_filters_pass_and_stop():
    t = np.arange(2000) / 100
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 30 * t)
    for band, keeps in (((0, 8), slow), ((10, None), fast), ((1, 5), slow)):
        y = dsp.sos_filter(dsp.butterworth_sos(6 if band[0] in (0, 10) else 3, band, 100), (slow + fast)[:, None])[1000:, 0]
        assert y.std() == pytest.approx(keeps.std(), rel=0.05)
    assert np.abs(dsp.analytic(slow)).std() < 0.01 and len(dsp.resample(slow, 2, 5)) == 800
    w = dsp.slepian(64, 2.5, 4)
    assert np.allclose(w @ w.T, np.eye(4), atol=1e-8)


def brute_posterior(loglik, p, pi):
    from itertools import product

    n, k = loglik.shape
    g, total, best = np.zeros((n, k)), 0.0, (-np.inf, None)
    for s in product(range(k), repeat=n):
        v = math.log(pi[s[0]]) + sum(math.log(p[a, b]) for a, b in zip(s, s[1:])) + sum(loglik[t, x] for t, x in enumerate(s))
        best = max(best, (v, tuple(-x for x in s)))
        total += math.exp(v)
        for t, x in enumerate(s):
            g[t, x] += math.exp(v)
    return g / total, math.log(total), [-x for x in best[1]]


def test_recursions_on_ragged_sessions():
    r = np.random.default_rng(3)
    p, pi = np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([0.4, 0.6])
    parts = [r.normal(size=(n, 2)) for n in (3, 7, 1, 5)]
    padded, lengths, order = chain.pad(parts)
    gamma, xi, ll = chain.smooth(padded, lengths, p, pi)
    paths = chain.best_path(padded, lengths, p, pi)
    for i, j in enumerate(order):
        g, v, best = brute_posterior(parts[j], p, pi)
        n = len(parts[j])
        assert np.allclose(gamma[i, :n], g) and ll[i] == pytest.approx(v) and paths[i, :n].tolist() == best
        assert np.allclose(xi[i].sum(1), g[:-1].sum(0)) and np.allclose(xi[i].sum(0), g[1:].sum(0))


@pytest.mark.parametrize(("covariance", "mean", "beta"), [("diag", "state", "no"), ("full", "state", "state"), ("sharedfull", "shared", "state"), ("shareddiag", "state", "shared"), ("identity", "no", "state"), ("full", "shared", "shared"), ("diag", "shared", "state")])
def test_statistics_give_the_updates_of_the_rows(spark, covariance, mean, beta):
    """The update from summed statistics against residuals taken row by row."""
    r = np.random.default_rng(1)
    n, q, p = 60, 2, 2
    y, x = r.normal(size=(n, q)) + 1, r.normal(size=(n, p))
    gamma = r.dirichlet(np.ones(2), n)
    m = hmm.Model(hmm.Spec(2, covariance, mean, beta))
    m.set_up(p, q, np.ones(q))
    m.set_dynamics()
    layout = hmm.Layout(m.spec, m.p, q)
    st = layout.read(layout.collect(y, x if m.p else None, gamma, np.ones((2, 2)), gamma[:1], 0.0, m.spec.diagonal))
    for _ in range(2):
        m.update(st)
    for k in range(2):
        d = y - (m.mu[m._of("mean", k)] if m.mu is not None else 0) - (x @ m.beta[m._of("beta", k)] if m.beta is not None else 0)
        want = (d * gamma[:, [k]]).T @ d
        if m.mu is not None:
            s = m.mu_cov[m._of("mean", k)] * gamma[:, k].sum()
            want = want + (np.diag(s) if m.spec.diagonal else s)
        if m.beta is not None:
            b = m._of("beta", k)
            for a in range(n):
                cov = np.diag([x[a] @ m.beta_cov[b, j] @ x[a] for j in range(q)]) if m.spec.diagonal else np.kron(x[a], np.eye(q)) @ m.beta_cov[b] @ np.kron(x[a], np.eye(q)).T
                want = want + gamma[a, k] * cov
        got = m._scatter(st, k)
        assert np.allclose(got, np.diag(want) if m.spec.diagonal else want)
    if covariance != "identity" and mean == "state":
        free = [y - (x @ m.beta[0] if beta == "shared" else sum(gamma[:, [j]] * (x @ m.beta[j]) for j in range(2)) if beta == "state" else 0)]
        assert free[0].shape == y.shape
    assert np.isfinite(m.loglik(y, x)).all()


def test_training_recovers_simulated_regimes(spark):
    spec = hmm.Spec(2, "diag", "state", "no")
    true = hmm.Model(spec)
    true.set_up(0, 2, np.ones(2))
    true.mu, true.mu_cov = np.array([[2.0, 0.0], [-2.0, 1.0]]), np.zeros((2, 2))
    true.sigma_rate, true.sigma_shape = np.full((2, 2), 50.0), np.full(2, 100.0)
    true.alpha, true.alpha2 = np.ones(2) * 50, np.array([[90.0, 10.0], [10.0, 90.0]])
    drawn = hmm.sample(spark, spark.createDataFrame([(i, 60 + i) for i in range(8)], "session_id int, n int"), true, seed=1).cache()
    obs = drawn.select("session_id", "t", "y")
    m = hmm.train(obs, spec, hmm.Options(cycles=15, starts=2, start_cycles=2))
    assert m.trace[-1] <= m.trace[0] and np.isfinite(m.trace).all()
    order = np.argsort(-m.mu[:, 0])
    assert np.allclose(m.mu[order], true.mu, atol=0.3) and m.moves[0, 0] > 0.8
    g = hmm.decode(obs, m)
    assert g.select(F.max(F.abs(F.aggregate("gamma", F.lit(0.0), lambda a, b: a + b) - 1)).alias("e")).first()["e"] < 1e-9
    same = hmm.viterbi(obs, m).join(drawn.select("session_id", "t", F.col("state").alias("true")), ["session_id", "t"])
    assert same.where(F.col("true") == F.create_map(*[F.lit(int(x)) for i, k in enumerate(order) for x in (k, i)])[F.col("state")]).count() / same.count() > 0.95
    again = hmm.Model.from_json(m.to_json())
    assert np.allclose(again.loglik(np.ones((3, 2)), None), m.loglik(np.ones((3, 2)), None))
    assert hmm.explained_variance(obs, g, m).where("r2 > 0.2").count() > 0
    each = {r.session_id: hmm.Model.from_json(r.model) for r in hmm.session_models(obs, m).collect()}
    assert set(each) == set(range(8)) and all(np.allclose(x.mu, m.mu, atol=1.5) for x in each.values())


def test_model_is_kept_as_text(spark, tmp_path):
    m = hmm.Model(hmm.Spec(2, "full", "state", "state"))
    m.set_up(2, 2, np.ones(2))
    m.set_dynamics()
    m.save(spark, str(tmp_path / "m"))
    again = hmm.Model.load(spark, str(tmp_path / "m"))
    assert np.allclose(again.beta_cov, m.beta_cov) and np.allclose(again.moves, m.moves) and again.spec.covariance == "full"


def test_permutations_keep_blocks(spark):
    u = spark.createDataFrame([(i, i // 4) for i in range(16)], "unit_id long, block int")
    for p in (testing.permutations(u, 5, 1, "block"), testing.block_permutations(u, 5, 1), testing.both_permutations(u, 5, 1)):
        out = {}
        for r in p.collect():
            out.setdefault(r.perm_id, {})[r.dst] = r.src
        assert out[0] == {i: i for i in range(16)} and all(sorted(v.values()) == list(range(16)) for v in out.values())
        assert all(len({v[i] // 4 for i in range(b, b + 4)}) == 1 for v in out.values() for b in range(0, 16, 4))


def test_ranks_in_many_tasks_are_those_of_one(spark, monkeypatch):
    u = spark.createDataFrame([(i * 7 % 101, i % 3) for i in range(101)], "unit_id long, block int")
    for block in (None, "block"):
        whole = sorted(map(tuple, testing.permutations(u, 4, 5, block).collect()))
        monkeypatch.setattr(testing, "RANK_ROWS", 9)
        assert sorted(map(tuple, testing.permutations(u, 4, 5, block).collect())) == whole and len(whole) == 404
        monkeypatch.undo()
    assert [tuple(r) for r in testing.permutations(u.where("unit_id < 0"), 3).collect()] == []


def test_tree_permutations(spark, monkeypatch):
    # two families of three and one of two may change places; the parts of family 4 stay, their units don't
    rows = [(0, 1, 1), (1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 2, 2), (5, 2, 2), (6, 3, 1), (7, 3, 1), (8, -4, 1), (9, -4, 1), (10, -4, 2), (11, -4, 2)]
    u = spark.createDataFrame(rows, "unit_id long, family int, part int")
    family, part = {r[0]: r[1] for r in rows}, {r[0]: r[1:] for r in rows}

    def shuffled(n):
        out = {}
        for r in testing.tree_permutations(u, ["family", "part"], n, 3).collect():
            out.setdefault(r.perm_id, {})[r.dst] = r.src
        return out

    found = shuffled(40)
    assert found[0] == {i: i for i in range(12)} and len(found) == 40
    for m in found.values():
        assert sorted(m.values()) == list(range(12)), "every unit once"
        assert all(len({family[m[i]] for i in family if family[i] == f}) == 1 for f in (1, 2, 3, -4)), "families stay whole"
        assert all(part[m[i]] == part[i] for i in (8, 9, 10, 11)) and {family[m[i]] for i in (6, 7)} == {3}
        assert len({part[m[i]] for i in (0, 1)}) == 1 and len({part[m[i]] for i in (4, 5)}) == 1, "pairs stay together"
    assert {family[m[0]] for m in found.values()} == {1, 2} and {m[8] for m in found.values()} == {8, 9}
    monkeypatch.setattr(testing, "RANK_ROWS", 3)
    assert shuffled(40) == found
    assert testing.tree_permutations(u.where("unit_id < 0"), ["family"], 3).count() == 0


def test_p_values(spark):
    s = spark.createDataFrame([(p, 0, float(10 - p)) for p in range(10)], "perm_id int, q int, stat double")
    assert testing.p_values(s, "stat", "q").first()["p"] == pytest.approx(1 / 10)
    assert testing.max_p_values(s, "stat", ("q",)).first()["p"] == pytest.approx(1 / 10)


def test_spectra_peak_where_the_wave_is(spark):
    t = np.arange(1024) / 100
    y = np.stack([np.sin(2 * np.pi * 12.5 * t), np.sin(2 * np.pi * 12.5 * t + 1)], 1)
    s = spectral.state_spectra(series(spark, y), None, 100.0, 128, 2.0, 3).cache()
    top = s.where("i = 0 and j = 0").orderBy(F.desc("re")).first()
    assert abs(top.f - 12.5) < 1.0
    c = spectral.coherence(s, "session_id", "state", "f").where((F.col("i") < F.col("j")) & (F.abs(F.col("f") - 12.5) < 0.5))
    assert c.first()["coherence"] > 0.99


def test_cross_validation_keeps_groups_whole(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.1 * r.normal(size=120)
    u = spark.createDataFrame([(i, i // 5, list(map(float, v)), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(500, 0, [0.0] * 3, None)], "unit_id long, family long, features array<double>, target double")
    out = predict.cross_validate(u, 4, "family").cache()
    assert out.count() == 120 and predict.scores(out).first()["r"] > 0.95
    f = predict.folds_of(u, 4, "family")
    assert f.groupBy("family").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    k = predict.kernel(u.select(F.col("unit_id").alias("session_id"), "features").where("session_id < 9"), block=4).collect()
    assert len(k) == 45 and all(v.value == pytest.approx(float(x[v.a] @ x[v.b])) for v in k)


def test_preprocessing_steps(spark):
    r = np.random.default_rng(2)
    y = np.cumsum(r.normal(size=(80, 3)), 0)
    o = series(spark, y[:50], y[50:])
    z = preprocess.standardise(o).where("session_id = 0").agg(F.avg(F.col("y")[1]), F.stddev_pop(F.col("y")[1])).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    out = preprocess.preprocess(o, fs=10, trend=True, lags=(-1, 0, 1), pca=2)
    assert out.count() == 76 and preprocess.width(out) == 2
    scores, axes = preprocess.apply_pca(o, 0.9)
    assert axes.shape[0] == 3 and np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-9)
    src = np.stack([np.sign(np.sin(np.arange(400) / 7)), r.uniform(-1, 1, 400)], 1)
    ica, _ = preprocess.apply_ica(series(spark, src @ np.array([[1.0, 0.5], [0.3, 1.0]])), 2)
    got = np.stack([v.y for v in ica.orderBy("t").collect()])
    c = np.abs(np.corrcoef(got.T, src.T)[:2, 2:])
    assert c.max(0).min() > 0.95
    a = preprocess.autoregress(o, 2)
    kept = preprocess.partial_connectivity(a, np.array([[1, 1, 1]] * 3 + [[0, 0, 0]] * 3)).first()
    assert len(kept.x) == 3


def test_session_halves_and_visit_tests(spark):
    r = np.random.default_rng(0)
    u = spark.createDataFrame([(i, i % 4, [float(v := r.normal())], [2 * v + 0.1 * float(r.normal())]) for i in range(80)], "unit_id long, session_id long, d array<double>, r array<double>")
    assert testing.across_sessions(u, 1, 1, n=5).first()["observed"] > 0.9
    p = spark.createDataFrame([(0, t, (t // 5) % 3, 5.0 * ((t // 5) % 3 == 1)) for t in range(150)], "session_id int, t int, state int, value double")
    out = {x.state: x for x in testing.across_visits(p, 3, n=40).collect()}
    assert out[1].observed == 5.0 and out[1].p <= 0.1


def test_padded_batches_are_bounded(monkeypatch):
    """A long session among short ones isn't padded with them."""
    monkeypatch.setattr(hmm, "BATCH_ROWS", 100)
    row = lambda n: [{"t": i, "y": [0.0], "x": None} for i in range(n)]
    sizes = [90, *[3] * 60, 200, 1]
    batches = list(hmm._batches([{"session_id": list(range(len(sizes))), "rows": [row(n) for n in sizes]}]))
    assert [s for b in batches for s, *_ in b] == list(range(len(sizes)))
    assert all(len(b) == 1 or len(b) * max(len(y) for _, y, _, _ in b) <= 100 for b in batches)


def brute_corrections(p, method):
    n, order = len(p), np.argsort(p, kind="stable")
    r = np.arange(1, n + 1)
    raw = {"holm": p[order] * (n - r + 1), "holm-sidak": 1 - (1 - p[order]) ** (n - r + 1), "simes-hochberg": p[order] * (n - r + 1), "fdr_bh": p[order] * n / r, "fdr_by": p[order] * n / r * (1 / r).sum(), "bonferroni": p[order] * n, "sidak": 1 - (1 - p[order]) ** n}[method]
    if method.startswith("holm"):
        raw = np.maximum.accumulate(raw)
    elif method in ("simes-hochberg", "fdr_bh", "fdr_by"):
        raw = np.minimum.accumulate(raw[::-1])[::-1]
    out = np.empty(n)
    out[order] = np.minimum(raw, 1)
    return out


@pytest.mark.parametrize("method", ["bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by"])
def test_corrections_over_many_ranges(spark, monkeypatch, method):
    monkeypatch.setattr(results, "RANGE_ROWS", 7)
    p = np.round(np.random.default_rng(3).random(60), 2)  # with ties
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(90, None), (91, float("nan"))], "i int, p double")
    got = {r.i: r.q for r in results.corrected(df, method).collect()}
    want = brute_corrections(p, method)
    assert set(got) == set(range(60)) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert len({(p[i], round(got[i], 12)) for i in got}) == len(set(p)), "equal p-values get equal q"
    with pytest.raises(ValueError):
        results.corrected(df, "none")


def test_relabelled_visits_hold_all_states(spark):
    path = spark.createDataFrame([(s, t, (t // 2) % 5) for s in range(3) for t in range(10)], "session_id int, t int, state int")
    rows = testing.relabelled_runs(path, 70, 5, 1).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.onset):
        by.setdefault((r.perm_id, r.session_id), []).append(r.state)
    assert len(by) == 210 and all(len(set(v)) == 5 for v in by.values()), "five visits, five states"
    assert all(a != b for v in by.values() for a, b in zip(v, v[1:])) and by[0, 0] == [0, 1, 2, 3, 4]


def test_visit_sums_give_what_rows_give(spark):
    r = np.random.default_rng(0)
    rows = [(s, t, int(r.integers(3)), float(r.normal())) for s in range(4) for t in range(25)]
    path = spark.createDataFrame(rows, "session_id int, t int, state int, value double")
    got = {x.state: x for x in testing.across_visits(path, 3, 12, seed=2).collect()}
    for k in range(3):
        v = np.array([x[3] for x in rows])
        m = np.array([x[2] == k for x in rows])
        assert abs(got[k].observed - (v[m].mean() - v[~m].mean())) < 1e-9 and 0 < got[k].p <= 1
    pairs = {(x.state_a, x.state_b): x for x in testing.across_visits(path, 3, 12, pairs=True, seed=2, mirrored=True).collect()}
    assert len(pairs) == 6 and all(abs(pairs[a, b].p + pairs[b, a].p - 1) < 1e-12 for a, b in pairs)


def test_confounds_are_removed_on_training_folds(spark):
    r = np.random.default_rng(4)
    n = 200
    x, c = r.normal(size=(n, 3)), r.normal(size=(n, 1))
    y = x @ [1.0, -2.0, 0.5] + 5 * c[:, 0] + 3 + 0.1 * r.normal(size=n)
    units = spark.createDataFrame([(i, x[i].tolist(), c[i].tolist(), float(y[i])) for i in range(n)], "unit_id int, features array<double>, confounds array<double>, target double")
    out = {q.unit_id: q for q in predict.cross_validate(units, 4).collect()}
    fold = np.array([out[i].fold for i in range(n)])
    for k in range(4):
        t = fold != k
        beta = np.linalg.solve(c[t].T @ c[t] + 1e-5 * np.eye(1), c[t].T @ (y[t] - y[t].mean()))
        clean = y - y[t].mean() - c @ beta
        assert all(abs(out[i].clean_target - clean[i]) < 1e-8 for i in np.flatnonzero(fold == k)), "what the training folds say of the confound"
    assert np.corrcoef([out[i].clean_prediction for i in range(n)], [out[i].clean_target for i in range(n)])[0, 1] > 0.98
    assert np.corrcoef([out[i].prediction for i in range(n)], y)[0, 1] > 0.98
    with pytest.raises(ValueError):
        predict.cross_validate(units, 4, classify=True)
    mean, beta = predict.fit_confounds(units)
    back = predict.reconfound(predict.deconfound(units, mean, beta), mean, beta).collect()
    assert all(abs(q.target - y[q.unit_id]) < 1e-9 for q in back)


def test_kernels_in_folds_and_in_sql(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 2))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2).tolist()
    units = spark.createDataFrame([(i, x[i].tolist(), y[i]) for i in range(120)], "unit_id int, features array<double>, target double")
    score = lambda d: d.agg(F.corr("prediction", "target")).first()[0]
    assert score(predict.kernel_cross_validate(units, 4, shape="gaussian")) > 0.95 > 0.5 > score(predict.kernel_cross_validate(units, 4))
    predict.register_kernel(spark, "near", shape="gaussian", tau=2.0)
    predict.register_kernel(spark, "mine", lambda a, b: (a * b).sum(1) ** 2)
    units.createOrReplaceTempView("units_of_kernels")
    row = spark.sql("SELECT near(a.features, b.features) AS g, mine(a.features, b.features) AS m FROM units_of_kernels a, units_of_kernels b WHERE a.unit_id = 1 AND b.unit_id = 2").first()
    assert abs(row.g - np.exp(-((x[1] - x[2]) ** 2).sum() / 8)) < 1e-12 and abs(row.m - (x[1] @ x[2]) ** 2) < 1e-12
    said = units.where("unit_id = 1").select(predict.kernel_function()("features", "features").alias("k")).first().k
    assert abs(said - x[1] @ x[1]) < 1e-12


def test_logistic_classes_in_folds(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(90, 2))
    units = spark.createDataFrame([(i, x[i].tolist(), float(x[i, 0] > 0)) for i in range(90)], "unit_id int, features array<double>, target double")
    out = predict.cross_classify(units, 3, penalties=(1e-3,))
    assert out.count() == 90 and out.where("prediction = target").count() > 80


def test_columns_are_tested_by_their_kind(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(i % 2), float(i % 4), float(r.normal())], [float(i % 2 + r.normal()), float(r.normal())], [float(r.normal())]) for i in range(80)]
    units = spark.createDataFrame(rows, "unit_id int, d array<double>, r array<double>, c array<double>")
    out = {(x.p, x.q): x for x in testing.across_columns(units, 40, confounds="c").collect()}
    assert [out[p, 0].kind for p in range(3)] == ["t", "groups", "regression"] and len(out) == 6
    assert out[0, 0].pv <= 0.05 and all(0 < x.pv <= 1 for x in out.values())
    assert testing.across_columns(units, 10, combine=True).count() == 6
    told = results.named(testing.across_columns(units, 5).withColumnRenamed("p", "predictor_id"), ["a", "b"], ["y"]).collect()
    assert {(x.predictor, x.outcome) for x in told if x.q == 0} == {("a", "y"), ("b", "y"), ("Predictor 3", "y")}
