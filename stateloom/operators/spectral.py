"""Multitaper spectra of states, coherence, bands and factorisation.

The Fourier transforms run over one session and state at a time; everything after them is keyed by
(session_id, state, f, i, j) and done by Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp

# fixed values: the named bands of power and of coherence, in Hz; None is the end of the grid
POWER_BANDS = (("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 12.0), ("beta", 13.0, 30.0), ("gamma", 30.0, None))
COHERENCE_BANDS = (("delta", 0.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 12.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 50.0))


def grid(fs: float, window: int, band: tuple[float, float] | None = None) -> np.ndarray:
    """Frequencies of the transform of a window, both ends of the band included."""
    f = np.fft.rfftfreq(window, 1 / fs)
    lo, hi = band or (0.0, fs / 2)
    return f[(f >= lo) & (f <= hi)]


def cross_spectra(x: np.ndarray, tapers: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """(frequencies, channels, channels) mean over windows and tapers of a (rows, channels) series. Half a window of
    zeros stands at either end."""
    n = tapers.shape[1]
    padded = np.concatenate([np.zeros((n // 2, x.shape[1])), x, np.zeros((n // 2, x.shape[1]))])
    windows = padded[: len(padded) // n * n].reshape(-1, n, x.shape[1])
    out = np.zeros((int(keep.sum()), x.shape[1], x.shape[1]), complex)
    for taper in tapers:
        s = np.fft.rfft(windows * taper[None, :, None], axis=1)[:, keep]
        out += np.einsum("wfi,wfj->fij", np.conj(s), s)
    return out / (len(tapers) * max(1, len(windows)))


def state_spectra(obs: DataFrame, gamma: DataFrame | None, fs: float, window: int, half_bandwidth: float = 4.0, tapers: int = 7, band: tuple[float, float] | None = None, standardised: bool = False) -> DataFrame:
    """(session_id, state, f, i, j, re, im), i <= j: spectra of the series weighted by each state's probability, scaled
    by 2 / fs and by the rows over the summed squares of the weights. Without gamma there is one state."""
    table = dsp.slepian(window, half_bandwidth, tapers)
    freqs = np.fft.rfftfreq(window, 1 / fs)
    lo, hi = band or (0.0, fs / 2)
    keep = (freqs >= lo) & (freqs <= hi)
    j = obs.select("session_id", "t", "y")
    j = j.join(gamma, ["session_id", "t"]) if gamma is not None else j.withColumn("gamma", F.array(F.lit(1.0)))
    kind = dict(obs.dtypes)["session_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, g = np.stack(pdf["y"].to_numpy()), np.stack(pdf["gamma"].to_numpy())
        if standardised:
            y = (y - y.mean(0)) / np.where(y.std(0) > 0, y.std(0), 1)
        i, k = np.triu_indices(y.shape[1])
        parts = []
        for s in range(g.shape[1]):
            c = cross_spectra(y * g[:, [s]], table, keep) * (2 / fs) * len(y) / max((g[:, s] ** 2).sum(), 1e-12)
            v = c[:, i, k]
            m = len(i)
            parts.append(pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "state": s, "f": np.repeat(freqs[keep], m), "i": np.tile(i, len(v)), "j": np.tile(k, len(v)), "re": v.real.ravel(), "im": v.imag.ravel()}))
        return pd.concat(parts)

    return j.groupBy("session_id").applyInPandas(run, f"session_id {kind}, state int, f double, i int, j int, re double, im double")


def coherence(cross: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, j, coherence): squared cross spectrum over the product of the power spectra."""
    power = cross.where("i = j").select(*keys, "i", F.col("re").alias("p"))
    a, b = power.withColumnRenamed("p", "pi"), power.select(*keys, F.col("i").alias("j"), F.col("p").alias("pj"))
    c = cross.join(a, [*keys, "i"]).join(b, [*keys, "j"])
    return c.select(*keys, "i", "j", ((F.col("re") ** 2 + F.col("im") ** 2) / (F.col("pi") * F.col("pj"))).alias("coherence"))


def in_bands(df: DataFrame, value: str, keys: tuple[str, ...], bands=POWER_BANDS, how: str = "mean") -> DataFrame:
    """(keys, band, value): mean, sum or integral (trapezoids) of a value over named bands, ends included. The bands are
    a few rows, given as literals."""
    top = F.lit(None).cast("double")
    rows = F.array(*(F.struct(F.lit(n).alias("band"), F.lit(a).alias("lo"), (F.lit(b) if b is not None else top).alias("hi")) for n, a, b in bands))
    j = df.withColumn("b", F.explode(rows)).where((F.col("f") >= F.col("b.lo")) & (F.col("b.hi").isNull() | (F.col("f") <= F.col("b.hi"))))
    j = j.select(*keys, F.col("b.band").alias("band"), "f", value)
    if how == "integral":
        w = Window.partitionBy(*keys, "band").orderBy("f")
        j = j.withColumn(value, (F.col(value) + F.lag(value).over(w)) / 2 * (F.col("f") - F.lag("f").over(w)))
    return j.groupBy(*keys, "band").agg({"mean": F.avg, "sum": F.sum, "integral": F.sum}[how](value).alias(value))


def band_power(psd: DataFrame, *keys: str, bands=POWER_BANDS, how: str = "mean") -> DataFrame:
    return in_bands(psd, "power", keys, bands, how)


def band_coherence(coh: DataFrame, *keys: str, bands=COHERENCE_BANDS) -> DataFrame:
    return in_bands(coh, "coherence", keys, bands)


def frequency_range(f: np.ndarray, lo: float, hi: float) -> tuple[int, int]:
    """First and last place of the grid inside [lo, hi]."""
    if hi > f.max():
        raise ValueError("the upper bound is beyond the grid")
    at = np.flatnonzero((f >= lo) & (f <= hi))
    return int(at[0]), int(at[-1])


def factorise(coh: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors of coherence over frequency: (component, f, weight), in order of their peaks, and maps
    (session_id, state, i, j, component, weight). The factors are fitted on the mean over sessions and states, whose
    size is the number of frequencies and channel pairs; the maps are computed where the rows are."""
    off = coh.where("i < j")
    mean = off.groupBy("f", "i", "j").agg(F.avg("coherence").alias("c")).orderBy("i", "j", "f").collect()
    f = np.array(sorted({r["f"] for r in mean}))
    m = np.array([r["c"] for r in mean]).reshape(-1, len(f))
    _, h, _ = dsp.nmf(m, min(n, *m.shape), seed=seed)
    h = h / np.maximum(h.max(1, keepdims=True), 1e-12)
    h = h[np.argsort(h.argmax(1), kind="stable")]
    spark = coh.sparkSession
    comps = spark.createDataFrame([(k, float(f[i]), float(v)) for (k, i), v in np.ndenumerate(h)], "component int, f double, weight double")
    share = comps.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("component")))
    maps = off.join(share, "f").groupBy("session_id", "state", "i", "j", "component").agg(F.sum(F.col("coherence") * F.col("share")).alias("weight"))
    return comps, maps


def component_intervals(comps: DataFrame) -> DataFrame:
    """(component, f): where each component but the last first falls below the next one, after its own peak."""
    w = Window.partitionBy("component")
    peak = comps.withColumn("peak", F.max_by("f", "weight").over(w))
    nxt = comps.select((F.col("component") - 1).alias("component"), "f", F.col("weight").alias("other"))
    return peak.join(nxt, ["component", "f"]).where((F.col("f") > F.col("peak")) & (F.col("other") >= F.col("weight"))).groupBy("component").agg(F.min("f").alias("f"))
