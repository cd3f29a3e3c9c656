"""Leading principal axes of very wide vectors by subspace iteration: no table of all pairs of channels anywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import preprocess

#: Triangles that one task (and at last the driver) stacks.
FAN = 64
_PART = "kind int, i int, v array<double>"


def _triangle(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def _combined(parts: DataFrame, k: int) -> np.ndarray:
    """The triangle R of all rows from the tasks' triangles, stacked FAN at a time in a tree."""
    tree = parts.select("i", "v")
    n = tree.count()

    def stacked(g: pd.DataFrame) -> pd.DataFrame:
        r = _triangle(np.vstack([np.asarray(v).reshape(-1, k) for v in g["v"]]))
        return pd.DataFrame({"i": [int(g["i"].iloc[0]) // FAN], "v": [r.ravel()]})

    while n > FAN:
        tree = cut(tree.groupBy(F.floor(F.col("i") / FAN).alias("g")).applyInPandas(stacked, "i int, v array<double>"))
        n = -(-n // FAN)
    return _triangle(np.vstack([np.zeros((k, k)), *(np.asarray(r["v"]).reshape(-1, k) for r in tree.orderBy("i").collect())]))


def _pass(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Z, R) of one pass over the centred rows X: Z = X'(X basis), and R of X basis = QR."""
    q, k = basis.shape

    def run(frames):
        z, r = np.zeros((q, k)), np.zeros((0, k))
        for f in frames:
            if len(f):
                x = np.stack(f["y"].to_numpy()) - mean
                y = x @ basis
                z += x.T @ y
                r = _triangle(np.vstack([r, y]))
        if len(r):
            yield pd.DataFrame({"kind": 0, "i": np.arange(q), "v": list(z)})
            yield pd.DataFrame({"kind": [1], "i": [0], "v": [r.ravel()]})

    parts = cut(rows.mapInPandas(run, _PART).withColumn("i", F.when(F.col("kind") == 1, F.spark_partition_id()).otherwise(F.col("i"))))
    sums = parts.where("kind = 0").groupBy("i").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(k))).alias("v"))
    z = np.zeros((q, k))
    for s in sums.collect():  # q rows of k numbers
        z[s["i"]] = s["v"]
    return z, _combined(parts.where("kind = 1"), k)


def leading_axes(obs: DataFrame, d: int, extra: int = 16, steps: int = 60, tol: float = 1e-9, seed: int = 0, tasks: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes as columns, their population variances, mean) of the vectors y, at most d: fewer where they span fewer. A step
    is one pass: each task turns its rows into a channels x (d + extra) sum and a triangle, sums go by channel, triangles up
    a tree. The driver holds channels x (d + extra) numbers. Steps end once the axes' space turns by less than tol (steps of
    them at most). tasks: partial sums that a pass leaves, four for each core by default. Rows without y are left out; each
    axis' largest entry is positive."""
    rows = obs.where(F.col("y").isNotNull()).select("y")
    q = preprocess.width(rows)
    if not q:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0)
    # narrow: fewer tasks, each with more rows, so that there are few partial sums
    rows = rows.coalesce(tasks or 4 * rows.sparkSession.sparkContext.defaultParallelism)

    def sums(frames):
        total, n = np.zeros(q), 0
        for f in frames:
            if len(f):
                total, n = total + np.stack(f["y"].to_numpy()).sum(0), n + len(f)
        yield pd.DataFrame({"i": np.arange(q + 1), "v": np.append(total, n)})

    flat = np.zeros(q + 1)
    for r in rows.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # q + 1 rows
        flat[r["i"]] = r["v"]
    n, mean = flat[-1], flat[:-1] / flat[-1]
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((q, min(q, d + extra))))[0]
    last, var = None, np.zeros(0)
    for _ in range(steps):
        z, r = _pass(rows, mean, basis)
        s, v = np.linalg.svd(r)[1:]
        keep = s > 1e-12 * max(s[0], 1e-300)
        if not keep.any():  # all rows are equal
            return np.zeros((q, 0)), np.zeros(0), mean
        within = (v[keep] @ z.T) / s[keep, None]  # the rows in the basis that X basis spans
        val, axes = np.linalg.svd(within, full_matrices=False)[1:]
        basis, var = axes.T, val**2 / n
        now = basis[:, :d]
        if last is not None and last.shape == now.shape and np.linalg.norm(now - last @ (last.T @ now)) < tol:
            break
        last = now
    axes = basis[:, :d]
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]), var[:d], mean


def apply_wide_pca(obs: DataFrame, d: int, whiten: bool = False, **how) -> tuple[DataFrame, np.ndarray]:
    """Scores on the d leading axes and the projection, as `preprocess.apply_pca`, for vectors of any width."""
    axes, var, mean = leading_axes(obs, d, **how)
    if not axes.size:
        return obs.withColumn("y", F.array().cast("array<double>")), axes
    axes = axes / np.sqrt(np.maximum(var, 1e-300)) if whiten else axes
    return preprocess.project(obs, axes, mean), axes
