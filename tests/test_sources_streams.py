import numpy as np
import pytest

from stateloom.operators import hmm
from stateloom.sources import timeseries as ts
from stateloom.streaming import online


def test_array_files(spark, tmp_path):
    y = np.arange(12.0).reshape(6, 2)
    np.savez(tmp_path / "a.npz", Y=y, X=y[:, :1], indices=np.array([[0, 2], [2, 6]]))
    np.savez(tmp_path / "b.npz", X=y, T=np.array([4, 2]))
    np.save(tmp_path / "c.npy", y)
    out = ts.read_arrays(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.session_id, r.t)):
        by.setdefault(r.session_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"a#0": 2, "a#1": 4, "b#0": 4, "b#1": 2, "c": 6}
    assert by["a#1"][0].y == [4.0, 5.0] and by["a#1"][0].x == [4.0] and by["b#1"][0].y == [8.0, 9.0] and by["c"][0].x is None


def test_text_and_results(spark, tmp_path):
    (tmp_path / "s1.txt").write_text("1 2\n3 4\n\n")
    assert [(r.session_id, r.t, r.y) for r in ts.read_text(spark, str(tmp_path / "s1.txt")).collect()] == [("s1", 0, [1.0, 2.0]), ("s1", 1, [3.0, 4.0])]
    df = spark.createDataFrame([("k", 0.5)], "name string, p double")
    ts.write_result(df, str(tmp_path / "r"), {"method": "x"})
    back, about = ts.read_result(spark, str(tmp_path / "r"))
    assert back.collect() == df.collect() and about == {"method": "x"}
    b = spark.createDataFrame([(i, -1, i % 7 + 1, 100 - i) for i in range(50)], "unit_id long, a int, b int, c int").repartition(5)
    ts.write_blocks(b, str(tmp_path / "eb"))
    back = ts.read_blocks(spark, str(tmp_path / "eb"))
    assert back.columns == ["unit_id", "c0", "c1", "c2"] and sorted(map(tuple, back.collect())) == sorted(map(tuple, b.collect()))
    p = spark.createDataFrame([("/d/s_10.npy",), ("/d/s_2.npy",), ("/e/s_2.npy",)], "path string")
    assert [r.path for r in ts.sorted_paths(p).collect()] == ["/d/s_2.npy", "/e/s_2.npy", "/d/s_10.npy"]
    assert {r.path: r.name for r in ts.short_names(p).collect()} == {"/d/s_10.npy": "s_10.npy", "/d/s_2.npy": "d/s_2.npy", "/e/s_2.npy": "e/s_2.npy"}


def test_columns_and_sessions(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, float("nan")), ("b", 1, 3.0)], "s string, k int, v double")
    obs = ts.read_columns(df, "s", ["k"], ["v"])
    assert sorted((r.session_id, r.t, r.y) for r in obs.collect()) == [("a", 0, [None]), ("a", 1, [1.0]), ("b", 0, [3.0])]
    ts.write_sessions(obs.drop("x"), str(tmp_path / "o"))
    assert ts.read_sessions(spark, str(tmp_path / "o")).count() == 3


@pytest.fixture
def model():
    m = hmm.Model(hmm.Spec(2, "identity", "state", "no"))
    m.set_up(0, 1, np.ones(1))
    m.mu, m.mu_cov = np.array([[-1.0], [1.0]]), np.zeros((2, 1))
    m.set_dynamics()
    return m


def test_streamed_filter_is_the_forward_recursion(spark, tmp_path, model):
    from stateloom.functions import chain

    r = np.random.default_rng(0)
    y = {s: r.normal(size=n) for s, n in (("a", 20), ("b", 7))}
    rows = [(s, i, [float(x)]) for s, v in y.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "session_id string, i long, y array<double>").selectExpr("session_id", "timestamp_seconds(i) as ts", "y")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = online.filtered(stream, model).writeStream.format("memory").queryName("filtered").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    for s, v in y.items():
        got = np.array([x.gamma for x in spark.sql(f"SELECT * FROM filtered WHERE session_id = '{s}' ORDER BY at").collect()])
        want, _, _ = chain.forward(model.loglik(v[:, None], None)[None], np.array([len(v)]), model.moves, model.starts)
        assert np.allclose(got, want[0])


def test_mini_batch_moves_the_model(spark, model):
    m = hmm.Model(hmm.Spec(2, "diag", "state", "no"))
    m.set_up(0, 1, np.ones(1))
    m.mu = np.array([[-0.1], [0.1]])
    m.set_dynamics()
    step = online.MiniBatch(m)
    r = np.random.default_rng(1)
    for epoch in range(4):
        data = [(f"{epoch}-{s}", t, [float(r.normal() * 0.2 + (2 if (t // 10) % 2 else -2))]) for s in range(3) for t in range(60)]
        step(spark.createDataFrame(data, "session_id string, t int, y array<double>"), epoch)
    assert m.mu[0, 0] < -0.2 and m.mu[1, 0] > 0.2


def streamed(spark, tmp_path, df, of, name, files=1):
    """Rows of a streaming query over the files of df."""
    df.repartition(files).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = of(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_taper_windows_of_a_stream(spark, tmp_path):
    from stateloom.functions import dsp

    y = np.random.default_rng(3).normal(size=(70, 2))
    df = spark.createDataFrame([("a", i, y[i].tolist()) for i in range(70)], "session_id string, i long, y array<double>").selectExpr("session_id", "timestamp_seconds(i) as ts", "y").coalesce(1)
    out = streamed(spark, tmp_path, df, lambda s: online.taper_windows(s, 10.0, 32, 2.0, 3), "tapered")
    assert {r.window for r in out} == {0, 1} and len(out) == 2 * 17 * 3, "two windows are full; 17 frequencies, 3 pairs"
    table = dsp.slepian(32, 2.0, 3)
    want = np.mean([np.abs(np.fft.rfft(y[32:64, 0] * t)) ** 2 for t in table], 0) * 2 / 10
    got = np.array([r.re for r in sorted(out, key=lambda r: r.f) if r.window == 1 and r.i == r.j == 0])
    assert np.allclose(got, want)


def test_running_occupancy_and_visits_of_a_stream(spark, tmp_path):
    rows = [("a", i * 600, [1.0, 0.0] if i < 4 else [0.0, 1.0], 0 if i < 4 else 1) for i in range(9)] + [("a", 100_000, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "session_id string, i long, gamma array<double>, state int").selectExpr("session_id", "timestamp_seconds(i) as ts", "gamma", "state")
    (tmp_path / "x").mkdir(), (tmp_path / "y").mkdir()
    fo = {r.window.start.timestamp() // 3600: r.fo for r in streamed(spark, tmp_path / "x", df.coalesce(1), lambda s: online.running_occupancy(s, 2), "occupied")}
    assert len(fo) == 2 and fo[min(fo)] == [4 / 6, 2 / 6] and fo[max(fo)] == [0.0, 1.0]
    stays = {r.state: r.n for r in streamed(spark, tmp_path / "y", df.coalesce(1), lambda s: online.visit_sessions(s), "stays")}
    assert stays == {0: 4, 1: 5}


def test_files_by_list_manifest_and_folder(spark, tmp_path):
    (tmp_path / "list.txt").write_text("/d/a.npy\n\n /d/b.npy \n")
    np.save(tmp_path / "c.npy", np.ones(3))
    paths = lambda f: sorted(r.path for r in ts.resolve_files(spark, f).collect())
    assert paths(["/x", "/y"]) == ["/x", "/y"] and paths(str(tmp_path / "list.txt")) == ["/d/a.npy", "/d/b.npy"]
    assert [p.rsplit("/", 1)[-1] for p in paths(str(tmp_path))] == ["c.npy"]
    assert ts.read_arrays(spark, [str(tmp_path / "c.npy")]).count() == 3


def test_a_model_back_in_the_channels(spark, model):
    axes = np.array([[1.0], [2.0], [-1.0]])
    t = {(r.name, r.state, r.i, r.j): r.value for r in hmm.channel_table(spark, model, axes, np.array([5.0, 0.0, 0.0])).collect()}
    assert t["mean", 0, 0, 0] == 4.0 and t["mean", 1, 1, 0] == 2.0 and t["covariance", 0, 0, 1] == 2 * t["covariance", 0, 0, 0]
