"""The driver's contract: the flagship query, and registered queries against their SQL on the smallest tables."""

import math
import os

import numpy as np
import pytest

import __spark_entry__ as entry
from stateloom.plans import registry

DATA = "/root/testdata/sf0.001"
NEEDS = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@NEEDS
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["session_id", "state", "fo"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.SQL) >= 40


def told(v):
    return round(float(v), 4) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@NEEDS
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    theirs = con.execute(registry.SQL[name])
    columns = [c[0] for c in theirs.description]
    ours = registry.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(ours.columns)
    quote = [f"`{c}`" for c in columns]
    rows = lambda rs: sorted((tuple(map(told, r)) for r in rs), key=repr)
    assert rows(ours.select(*quote).collect()) == rows(theirs.fetchall())


@NEEDS
def test_manova_takes_all_labels_and_coordinates(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    y, label = np.array([r["embedding"] for r in e], float), np.array([r["label"] for r in e])
    within = sum(np.cov(y[label == v].T, bias=True) * (label == v).sum() for v in set(label))
    ratio = np.linalg.slogdet(within)[1] - np.linalg.slogdet(np.cov(y.T, bias=True) * len(y))[1]
    out = {r["perm_id"]: r["wilks"] for r in registry.QUERIES["manova_f"](spark, DATA).collect()}
    assert len(out) == 5 and math.isclose(out[0], math.exp(ratio), rel_tol=1e-6)


@NEEDS
def test_predictions_and_factors_take_all_coordinates(spark, monkeypatch):
    from stateloom.operators import predict, spectral

    seen = {}
    for name in ("cross_validate", "split_predict", "split_classify"):
        monkeypatch.setattr(predict, name, lambda u, *a, name=name, **k: seen.setdefault((name, k.get("classify", False)), len(u.first()["features"])) and u)
    monkeypatch.setattr(spectral, "state_spectra", lambda e, *a, **k: seen.setdefault("nmf", len(e.first()["y"])) and e)
    monkeypatch.setattr(spectral, "coherence", lambda c, *a: c)
    monkeypatch.setattr(spectral, "factorise", lambda c, n: (c, c))
    for name in ("cv_predict", "cv_classify", "split_sample", "split_classes", "nmf_components"):
        registry.QUERIES[name](spark, DATA)
    assert seen == {("cross_validate", False): 63, ("cross_validate", True): 64, ("split_predict", False): 63, ("split_classify", False): 64, "nmf": 64}


@NEEDS
def test_cluster_nulls_come_from_permuted_units(spark, monkeypatch):
    from stateloom.operators import testing as T

    seen, real = [], T.cluster_p_values
    monkeypatch.setattr(T, "cluster_p_values", lambda s: seen.append(s) or real(s))
    registry.QUERIES["cluster_pvalue"](spark, DATA)
    stat = {(r["perm_id"], r["tau"]): r["stat"] for r in seen[0].collect()}
    hours = {t for p, t in stat if p == 0}
    assert {p for p, _ in stat} == set(range(50))
    higher = sum(abs(v) > abs(stat[0, t]) for (p, t), v in stat.items() if p and t in hours)
    assert 0.1 < higher / (49 * len(hours)) < 0.9
