"""MAT files, .npy files read by ranges of rows, and models from MATLAB."""

import struct

import numpy as np
import pytest

from stateloom.operators import hmm
from stateloom.sources import arrayfile, matfile
from stateloom.sources import timeseries as ts


def same(a, b):
    if isinstance(b, dict):
        return isinstance(a, dict) and a.keys() == b.keys() and all(same(a[k], b[k]) for k in b)
    if isinstance(b, np.ndarray) and b.dtype == object:
        return a.shape == b.shape and all(same(x, y) for x, y in zip(a.ravel(), b.ravel()))
    return a == b if isinstance(b, str) else a.dtype == b.dtype and a.shape == b.shape and bool(np.array_equal(a, b, equal_nan=True))


@pytest.mark.parametrize("compress", [True, False])
def test_mat_round_trip(compress):
    r = np.random.default_rng(0)
    cell = np.empty((2, 2), object)
    cell[:] = [[np.ones((1, 3)), "text é"], [{"a": np.zeros((0, 2)), "long_name": "b"}, np.array([[True, False]])]]
    structs = np.empty((1, 3), object)
    structs[0] = [{"x": np.array([[float(i)]]), "y": "s" * i} for i in range(3)]
    values = {"y": r.normal(size=(5, 4)), "cube": r.integers(0, 9, (2, 3, 4)).astype("i2"), "single": r.normal(size=(2, 2)).astype("f4"), "z": r.normal(size=(3, 1)) + 1j, "b": np.array([[True], [False]]), "u": np.array([[2**63]], "u8"), "s": "", "cell": cell, "one": {"inner": {"k": np.array([[np.nan]])}}, "many": structs, "none": np.zeros((0, 0))}
    back = matfile.read(matfile.write(values, compress))
    assert back.keys() == values.keys()
    assert all(same(back[k], v) for k, v in values.items())


def test_mat_forms_of_other_writers():
    """Small elements, the other byte order, integers that stand for doubles, sparse arrays, characters of two bytes, rows."""

    def file(order, *elements):
        return b"x".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI") + b"".join(elements)

    def element(order, kind, data):
        return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def small(order, kind, data):
        return struct.pack(order + "I", kind | len(data) << 16) + data.ljust(4, b"\0")

    for o in "<>":
        head = lambda cls, shape, name: element(o, 6, struct.pack(o + "II", cls, 0)) + element(o, 5, struct.pack(f"{o}{len(shape)}i", *shape)) + small(o, 1, name)  # noqa: E731, B023
        doubles = element(o, 14, head(6, (1, 2), b"a") + small(o, 3, struct.pack(o + "2h", 1, -2)))
        sparse = element(o, 14, head(5, (3, 2), b"sp") + element(o, 5, struct.pack(o + "3i", 0, 2, 1)) + element(o, 5, struct.pack(o + "3i", 0, 2, 3)) + element(o, 9, struct.pack(o + "3d", 1, 2, 3)))
        chars = element(o, 14, head(4, (2, 2), b"c") + element(o, 17, "".join("acbd").encode("utf-16-le" if o == "<" else "utf-16-be")))
        got = matfile.read(file(o, doubles, sparse, chars, element(o, 14, b"")))
        assert got["a"].dtype == float and got["a"].tolist() == [[1.0, -2.0]]
        assert got["sp"].tolist() == [[1.0, 0.0], [0.0, 3.0], [2.0, 0.0]]
        assert got["c"] == ["ab", "cd"]


def test_mat_errors():
    whole = matfile.write({"y": np.ones((9, 9))}, False)
    for bad in (b"", b"x" * 200, b"MATLAB 7.3 MAT-file".ljust(200), b"\x89HDF" + b"x" * 200, whole[:-8]):
        with pytest.raises(ValueError):
            matfile.read(bad)


def test_mat_sessions(spark, tmp_path):
    y = np.arange(12.0).reshape(6, 2)
    (tmp_path / "a.mat").write_bytes(matfile.write({"Y": y, "X": y[:, :1], "indices": np.array([[0, 2], [2, 6]]), "note": "no array"}))
    (tmp_path / "b.mat").write_bytes(matfile.write({"X": y, "T": np.array([4, 2], "i4")}))
    rows = ts.read_arrays(spark, str(tmp_path)).collect()
    got = {(r["session_id"], r["t"]): (r["y"], r["x"]) for r in rows}
    assert len(rows) == 12 and got["a#1", 0] == ([4.0, 5.0], [4.0]) and got["b#1", 1] == ([10.0, 11.0], None)


@pytest.mark.parametrize(("shape", "order", "kind"), [((1000, 3), "C", "<f8"), ((1000, 3), "F", "<f4"), ((50, 4, 5), "C", ">i2"), ((50, 4, 5), "F", "<i8"), ((700,), "C", "<f8"), ((0, 3), "C", "<f8"), ((4, 0), "C", "<f8")])
def test_npy_by_ranges(spark, tmp_path, shape, order, kind):
    a = np.asarray(np.random.default_rng(1).normal(size=shape) * 100, kind, order=order)
    np.save(tmp_path / "s1.npy", a)
    np.save(tmp_path / "other.npz", a)
    df = arrayfile.read_npy(spark, str(tmp_path), part_bytes=2000)
    rows = {r["t"]: r for r in df.collect()}
    assert len(rows) == shape[0] and all(r["session_id"] == "s1" and r["x"] is None for r in rows.values())
    assert all(rows[t]["y"] == a[t].ravel().astype(float).tolist() for t in rows)
    if a.nbytes > 4000:
        assert df.rdd.getNumPartitions() > 1


def test_npy_paths(spark, tmp_path):
    for n in ("b", "a"):
        np.save(tmp_path / f"{n}.npy", np.ones((2, 2)))
    assert arrayfile.read_npy(spark, [f"{tmp_path}/a.npy", f"file://{tmp_path}/b.npy"]).count() == 4
    assert arrayfile.read_npy(spark, str(tmp_path), "a*").count() == 2
    assert arrayfile.read_npy(spark, str(tmp_path), "none*").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        arrayfile.read_npy(spark, f"{tmp_path}/nowhere").count()


@pytest.mark.parametrize("cov", ["full", "diag", "sharedfull", "shareddiag"])
@pytest.mark.parametrize(("mean", "beta"), [("state", "no"), ("state", "state"), ("no", "state")])
def test_model_through_matlab(spark, cov, mean, beta):
    r = np.random.default_rng(2)
    m = hmm.Model(hmm.Spec(2, cov, mean, beta, transitions=np.array([[1, 1], [1, 1]], bool)))
    m.set_up(3 if beta == "state" else 0, 2, np.ones(2))
    if m.mu is not None:
        m.mu = r.normal(size=m.mu.shape)
    if m.beta is not None:
        m.beta = r.normal(size=m.beta.shape)
    m.set_dynamics(np.array([3.0, 1.0]), np.array([[5.0, 1.0], [2.0, 7.0]]))
    back = hmm.Model.from_mat(matfile.read(matfile.write(m.to_mat())))
    rows = [("s", t, r.normal(size=2).tolist(), r.normal(size=3).tolist()) for t in range(40)]
    obs = spark.createDataFrame(rows, "session_id string, t int, y array<double>, x array<double>")
    a, b = ({x["t"]: x["gamma"] for x in hmm.decode(obs, k).collect()} for k in (m, back))
    assert max(abs(p - q) for t in a for p, q in zip(a[t], b[t])) < 1e-12
    assert np.allclose(back.prior_rate, m.prior_rate) and back.prior_shape == m.prior_shape and back.spec.beta == beta
