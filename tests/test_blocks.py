"""Recursions over blocks of a session against those over whole sessions."""

import numpy as np
import pytest

from stateloom.operators import blocks, hmm, preprocess


@pytest.fixture(scope="module")
def model():
    moves = np.array([[1, 1, 0], [0, 1, 1], [1, 0, 1]], bool)
    m = hmm.Model(hmm.Spec(3, "diag", "state", "no", transitions=moves, starts=np.array([True, True, False])))
    m.set_up(0, 2, np.ones(2))
    m.mu, m.mu_cov = np.array([[-1.0, 0.5], [0.6, -0.2], [2.0, 1.0]]), np.full((3, 2), 0.01)
    m.set_dynamics()
    return m


@pytest.fixture(scope="module")
def obs(spark):
    """Ragged sessions: a single row, ends of blocks, a gap of several blocks in t, values far from all states."""
    r = np.random.default_rng(4)
    rows = []
    for s, n in enumerate((1, 15, 16, 17, 300, 47, 32)):
        for t in range(n):
            far = 60.0 if s == 5 and t == 20 else 0.0
            rows.append((f"s{s}", t + (200 if s == 4 and t >= 150 else 0), [float(v) + far for v in r.normal(size=2)]))
    r.shuffle(rows)
    return spark.createDataFrame([(s, int(t), list(map(float, y))) for s, t, y in rows], "session_id string, t int, y array<double>").repartition(5).cache()


def told(df, value):
    return {(r["session_id"], r["t"]): np.atleast_1d(r[value]) for r in df.collect()}


@pytest.mark.parametrize(("rows", "fan"), [(16, 1024), (16, 3), (7, 2), (1000, 2)])
def test_same_as_whole_sessions(obs, model, monkeypatch, rows, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    for ours, theirs, value in (
        (blocks.decode(obs, model, rows), hmm.decode(obs, model), "gamma"),
        (blocks.viterbi(obs, model, rows), hmm.viterbi(obs, model), "state"),
        (blocks.filtered(obs, (0.05, 0.2), 1.0, 3, rows), preprocess.filtered(obs, (0.05, 0.2), 1.0, 3), "y"),
    ):
        a, b = told(ours, value), told(theirs, value)
        assert a.keys() == b.keys()
        assert max(np.abs(a[k] - b[k]).max() for k in a) < 1e-9, value
    a, b = ({r["session_id"]: r["loglik"] for r in f.collect()} for f in (blocks.loglik(obs, model, rows), hmm.loglik(obs, model)))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-7


def test_empty_and_bad_rows(spark, obs, model):
    none = obs.limit(0)
    assert blocks.decode(none, model).count() == blocks.viterbi(none, model).count() == blocks.loglik(none, model).count() == 0
    with pytest.raises(Exception, match="whole number"):
        blocks.decode(spark.createDataFrame([("a", -1, [0.0, 0.0])], obs.schema), model).collect()


def test_no_session_is_gathered(obs):
    sizes = blocks.cut_rows(obs, 16).selectExpr("max(size(rows)) AS most", "sum(size(rows)) AS n").first()
    assert sizes["most"] == 16 and sizes["n"] == obs.count()
