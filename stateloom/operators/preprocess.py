"""Preprocessing of session tables.

Statistics are partial aggregations of array elements (one row for each session or for all), embeddings are window
functions, and only recursions and transforms over a whole session (filters, Hilbert, resampling) run in Python, a
session at a time."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp


def _in_session():
    return Window.partitionBy("session_id").orderBy("t")


def width(obs: DataFrame, column: str = "y") -> int:
    row = obs.select(F.size(column).alias("n")).first()
    return row["n"] if row else 0


def _moments(obs: DataFrame, q: int, *keys: str) -> DataFrame:
    """Mean and population deviation of each channel."""
    return obs.groupBy(*keys).agg(F.array(*(F.avg(F.col("y")[i]) for i in range(q))).alias("m"), F.array(*(F.stddev_pop(F.col("y")[i]) for i in range(q))).alias("s"))


def standardise(obs: DataFrame, scale: bool = True, by: str | None = "session_id") -> DataFrame:
    """Channels less their mean, over their population deviation if scale; by session, or over all if by is None. A
    channel without spread is only centred."""
    m = _moments(obs, width(obs), *([by] if by else []))
    j = obs.join(m, by) if by else obs.crossJoin(F.broadcast(m))  # one row
    y = F.zip_with("y", "m", lambda a, b: a - b)
    if scale:
        y = F.zip_with(y, F.col("s"), lambda a, s: F.when(s > 0, a / s).otherwise(a))
    return j.withColumn("y", y).drop("m", "s")


def dampen_peaks(obs: DataFrame, strength: float | bool = 5, by: str | None = None) -> DataFrame:
    """Values beyond twice the deviation of all values are drawn in: sign * (2s - log(2s) + log|v|), logarithms to the
    base `strength` (True is 5). The deviation is of all sessions, or of each with by."""
    base = 5.0 if strength is True else float(strength)
    v = obs.select(*([by] if by else []), F.explode("y").alias("v"))
    limit = v.groupBy(*([by] if by else [])).agg((2 * F.stddev_pop("v")).alias("limit"))
    j = obs.join(limit, by) if by else obs.crossJoin(F.broadcast(limit))  # one row
    log = lambda x: F.ln(x) / math.log(base)
    lim = F.col("limit")
    drawn = F.transform("y", lambda a: F.when(F.abs(a) > lim, F.signum(a) * (lim - log(lim) + log(F.abs(a)))).otherwise(a))
    return j.withColumn("y", drawn).drop("limit")


def detrend(obs: DataFrame) -> DataFrame:
    """Channels less their least-squares line over the session."""
    q = width(obs)
    lines = obs.groupBy("session_id").agg(F.array(*(F.coalesce(F.regr_slope(F.col("y")[i], F.col("t")), F.lit(0.0)) for i in range(q))).alias("a"), F.array(*(F.avg(F.col("y")[i]) for i in range(q))).alias("m"), F.avg("t").alias("c"))
    at = F.col("t") - F.col("c")
    trend = F.zip_with("a", "m", lambda a, m: m + a * at)
    return obs.join(lines, "session_id").withColumn("y", F.zip_with("y", trend, lambda v, w: v - w)).drop("a", "m", "c")


def per_session(obs: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Applies a function to each session's matrix (rows in order of t). The result may have another number of rows,
    then numbered from 0. A session is held in one task's memory."""
    cols = "session_id {}, t int, y array<double>".format(dict(obs.dtypes)["session_id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out = change(np.stack(pdf["y"].to_numpy()))
        t = pdf["t"].to_numpy() if len(out) == len(pdf) else np.arange(len(out))
        return pd.DataFrame({"session_id": [pdf["session_id"].iloc[0]] * len(out), "t": t.astype("int32"), "y": list(out)})

    return obs.select("session_id", "t", "y").groupBy("session_id").applyInPandas(run, cols)


def filtered(obs: DataFrame, band: tuple[float | None, float | None], fs: float, order: int = 6) -> DataFrame:
    """Causal Butterworth filter of each session from a zero state."""
    sos = dsp.butterworth_sos(order, band, fs)
    return per_session(obs, lambda y: dsp.sos_filter(sos, y))


def hilbert(obs: DataFrame, power: bool = True, phase: bool = False) -> DataFrame:
    """Power and phase (unwrapped over time) of each channel's analytic signal; both double the channels."""

    def run(y: np.ndarray) -> np.ndarray:
        a = dsp.analytic(y)
        parts = ([np.abs(a)] if power else []) + ([np.unwrap(np.angle(a), axis=0)] if phase else [])
        return np.concatenate(parts, axis=1)

    if not (power or phase):
        raise ValueError("power, phase or both")
    return per_session(obs, run)


def downsample(obs: DataFrame, fs: int, to: int) -> DataFrame:
    """Polyphase resampling of each session; its length becomes ceil(n * to / fs)."""
    return per_session(obs, lambda y: dsp.resample(y, to, fs))


def embed_lags(obs: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Time-delay embedding: channel by channel, the values at t - lag for each lag. Rows without all of them go, and t
    is counted anew. Not standardised."""
    lags = tuple(sorted(lags))
    if any(int(x) != x for x in lags) or not lags:
        raise ValueError("lags are whole numbers")
    w, q = _in_session(), width(obs)
    shifted = {x: F.lag("y", x).over(w) if x >= 0 else F.lead("y", -x).over(w) for x in lags}
    wide = obs.select("session_id", "t", *(c.alias(f"l{i}") for i, c in enumerate(shifted.values())))
    full = wide.dropna(subset=[f"l{i}" for i in range(len(lags))])
    y = F.array(*(F.col(f"l{i}")[c] for c in range(q) for i in range(len(lags))))
    before = max(0, lags[-1])
    return full.select("session_id", (F.col("t") - before).cast("int").alias("t"), y.alias("y"))


def autoregress(obs: DataFrame, order: int, center: bool = True) -> DataFrame:
    """(session_id, t, y, x): x holds the channels at t-1, then at t-2, and so on to the order. Centred over all rows."""
    if order < 1:
        raise ValueError("the order is 1 at least")
    obs = standardise(obs, scale=False, by=None) if center else obs
    w = _in_session()
    wide = obs.select("session_id", "t", "y", *(F.lag("y", k).over(w).alias(f"l{k}") for k in range(1, order + 1))).where(f"l{order} is not null")
    return wide.select("session_id", (F.col("t") - order).cast("int").alias("t"), "y", F.concat(*(F.col(f"l{k}") for k in range(1, order + 1))).alias("x"))


def gram(obs: DataFrame, a: str = "y", b: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(a'b, sum of a, sum of b, rows): cross products summed on the executors, one partial sum for each task."""
    b = b or a
    p, q = width(obs, a), width(obs, b)
    if not p:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0

    def sums(frames):
        total = np.zeros(p * q + p + q + 1)
        for f in frames:
            if len(f):
                x, y = np.stack(f["a"].to_numpy()), np.stack(f["b"].to_numpy())
                total += np.concatenate([(x.T @ y).ravel(), x.sum(0), y.sum(0), [len(f)]])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    parts = obs.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(sums, "i int, v double")
    flat = np.zeros(p * q + p + q + 1)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # p * q + p + q + 1 rows
        flat[r["i"]] = r["v"]
    return flat[: p * q].reshape(p, q), flat[p * q : p * q + p], flat[p * q + p : -1], int(flat[-1])


def covariance(obs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(population covariance, mean) of y."""
    g, s, _, n = gram(obs)
    m = s / n
    return g / n - np.outer(m, m), m


def gram_table(obs: DataFrame, column: str = "y") -> DataFrame:
    """(i, j, value): cross products of channels i <= j, without Python. Each row meets its own elements only."""
    v = obs.select(F.posexplode(column).alias("i", "a"), F.col(column).alias("all"))
    pairs = v.select("i", "a", F.posexplode("all").alias("j", "b")).where("i <= j")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def principal_axes(cov: np.ndarray, d: float | int) -> tuple[np.ndarray, np.ndarray]:
    """(axes as columns, variances): d axes, or as many as reach the share d < 1 of the variance. Each axis' largest
    entry is positive."""
    val, vec = np.linalg.eigh(cov)
    val, vec = val[::-1], vec[:, ::-1]
    k = int(d) if d >= 1 else int(np.searchsorted(np.cumsum(val) / val.sum(), d) + 1)
    vec = vec[:, :k]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])
    return vec, val[:k]


def project(obs: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None, column: str = "y") -> DataFrame:
    """The column times a matrix (channels x components) as vectors, a batch at a time."""

    @F.pandas_udf("array<double>")
    def times(y: pd.Series) -> pd.Series:
        a = np.stack(y.to_numpy())
        return pd.Series(list((a if mean is None else a - mean) @ matrix))

    return obs.withColumn(column, times(column))


def apply_pca(obs: DataFrame, d: float | int | np.ndarray, whiten: bool = False) -> tuple[DataFrame, np.ndarray]:
    """Scores on the principal axes and the projection; a matrix d is used as it is."""
    if isinstance(d, np.ndarray):
        return project(obs, d), d
    cov, mean = covariance(obs)
    axes, var = principal_axes(cov, d)
    axes = axes / np.sqrt(np.maximum(var, 1e-300)) if whiten else axes
    return project(obs, axes, mean), axes


def apply_ica(obs: DataFrame, d: float | int, steps: int = 200, tol: float = 1e-6, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Independent components of unit variance (symmetric FastICA with tanh on whitened scores): each step is one
    aggregation of d * d + d numbers."""
    white, axes = apply_pca(obs, d, whiten=True)
    white = white.select("session_id", "t", "y").persist()
    k = axes.shape[1]
    w = dsp.orthonormal_rows(np.random.default_rng(seed).standard_normal((k, k)))
    try:
        for _ in range(steps):
            now = w

            def sums(frames, w=now):
                total = np.zeros(k * k + k + 1)
                for f in frames:
                    if len(f):
                        x = np.stack(f["y"].to_numpy())
                        g = np.tanh(x @ w.T)
                        total += np.concatenate([(g.T @ x).ravel(), (1 - g**2).sum(0), [len(f)]])
                yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

            flat = np.zeros(k * k + k + 1)
            for r in white.select("y").mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
                flat[r["i"]] = r["v"]
            new = dsp.orthonormal_rows((flat[: k * k].reshape(k, k) - flat[k * k : -1, None] * w) / flat[-1])
            moved = np.max(np.abs(np.abs((new * w).sum(1)) - 1))
            w = new
            if moved < tol:
                break
    finally:
        white.unpersist()
    _, mean = covariance(obs)
    return project(obs, axes @ w.T, mean), axes @ w.T


def regress_out(obs: DataFrame, target: str, design: str, ridge: float = 1e-5) -> DataFrame:
    """The target vectors less their ridge regression on the design vectors: one aggregation and a projection."""
    xx, *_ = gram(obs, design)
    xy, *_ = gram(obs, design, target)
    beta = np.linalg.solve(xx + ridge * np.eye(len(xx)), xy)
    fit = project(obs.withColumn("_fit", F.col(design)), beta, column="_fit")
    return fit.withColumn(target, F.zip_with(target, "_fit", lambda a, b: a - b)).drop("_fit")


def partial_connectivity(obs: DataFrame, connectivity: np.ndarray, ridge: float = 0.001) -> DataFrame:
    """For each target channel, regresses out of it the regressors that the (p x q) mask leaves out (0), and drops
    regressors that no target uses."""
    xx, *_ = gram(obs, "x")
    xy, *_ = gram(obs, "x", "y")
    mask = np.asarray(connectivity).astype(bool)
    beta = np.zeros(mask.shape)
    for j in range(mask.shape[1]):
        out = np.flatnonzero(~mask[:, j])
        if len(out):
            beta[out, j] = np.linalg.solve(xx[np.ix_(out, out)] + ridge * np.eye(len(out)), xy[out, j])
    fit = project(obs.withColumn("_fit", F.col("x")), beta, column="_fit")
    used = [int(i) for i in np.flatnonzero(mask.any(1))]
    return fit.withColumn("y", F.zip_with("y", "_fit", lambda a, b: a - b)).withColumn("x", F.array(*(F.col("x")[i] for i in used))).drop("_fit")


def preprocess(obs: DataFrame, fs: float = 1, dampen=False, standard: bool = True, band=None, trend: bool = False, power: bool = False, phase: bool = False, lags=None, order: int | None = None, pca=None, whiten: bool = False, ica=None, post_standard: bool | None = None, rate: float | None = None) -> DataFrame:
    """The steps that are asked for, in this order: dampen, standardise, filter, detrend, Hilbert, lags or
    autoregression, PCA or ICA, standardise again, downsample."""
    if lags is not None and order is not None:
        raise ValueError("lags or an autoregression, not both")
    if dampen:
        obs = dampen_peaks(standardise(obs, scale=False), dampen)
    if standard:
        obs = standardise(obs)
    if band:
        obs = filtered(obs, band, fs)
    if trend:
        obs = detrend(obs)
    if power or phase:
        obs = hilbert(obs, power, phase)
    if lags is not None:
        obs = standardise(embed_lags(obs, tuple(lags)), by=None)
    if order is not None:
        obs = autoregress(obs, order)
    if pca is not None:
        obs, _ = apply_pca(obs, pca, whiten)
    if ica is not None:
        obs, _ = apply_ica(obs, ica)
    if post_standard if post_standard is not None else (pca is not None or ica is not None):
        obs = standardise(obs)
    if rate and rate != fs:
        obs = downsample(obs, int(fs), int(rate))
    return obs
