"""Gradient-boosted trees of depth two with logistic loss, and Platt calibration, for small feature tables (NumPy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass
class Trees:
    """One row for each tree: the root's feature and cut, each child's feature and cut, and four leaf values."""

    feature: np.ndarray  # (n, 3) int
    cut: np.ndarray  # (n, 3)
    leaf: np.ndarray  # (n, 4)
    base: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            right = x[:, f[0]] > c[0]
            deep = np.where(right, x[:, f[2]] > c[2], x[:, f[1]] > c[1])
            out += v[right * 2 + deep]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(x) + self.offset)


def _best_cut(x, grad, hess, cuts, lam):
    """(gain, feature, cut) of the split that lowers the loss most."""
    best = (-1.0, 0, np.inf)
    g, h = grad.sum(), hess.sum()
    for j, cs in enumerate(cuts):
        if not len(cs):
            continue
        bin_ = np.searchsorted(cs, x[:, j], "left")  # bin b: cs[b-1] < x <= cs[b]
        gl = np.cumsum(np.bincount(bin_, grad, len(cs) + 1))[:-1]
        hl = np.cumsum(np.bincount(bin_, hess, len(cs) + 1))[:-1]
        gain = gl**2 / (hl + lam) + (g - gl) ** 2 / (h - hl + lam) - g**2 / (h + lam)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), j, float(cs[i]))
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 16, lam: float = 1.0) -> Trees:
    """Fit on all rows but every fourth, and calibrate on those. Deterministic."""
    held = np.arange(len(y)) % 4 == 3
    xt, yt = x[~held], y[~held].astype(float)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in xt.T]
    base = float(np.log((yt.sum() + 1) / (len(yt) - yt.sum() + 1)))
    raw = np.full(len(yt), base)
    feats, cs, leaves = [], [], []
    for _ in range(rounds):
        p = sigmoid(raw)
        grad, hess = p - yt, np.maximum(p * (1 - p), 1e-6)
        _, f0, c0 = _best_cut(xt, grad, hess, cuts, lam)
        right = xt[:, f0] > c0
        sides = [_best_cut(xt[m], grad[m], hess[m], cuts, lam) if m.any() else (0, 0, np.inf) for m in (~right, right)]
        deep = np.where(right, xt[:, sides[1][1]] > sides[1][2], xt[:, sides[0][1]] > sides[0][2])
        at = right * 2 + deep
        leaf = -rate * np.bincount(at, grad, 4) / (np.bincount(at, hess, 4) + lam)
        raw += leaf[at]
        feats.append([f0, sides[0][1], sides[1][1]])
        cs.append([c0, sides[0][2], sides[1][2]])
        leaves.append(leaf)
    trees = Trees(np.array(feats), np.array(cs), np.array(leaves), base)
    trees.slope, trees.offset = platt(trees.raw(x[held]), y[held])
    return trees


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-out scores (Newton steps of bounded length, smoothed targets,
    the slope drawn a little towards 1)."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * raw + b)
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = (raw * (p - t)).sum() + (a - 1), (p - t).sum()
        haa, hab, hbb = (w * raw * raw).sum() + 1, (w * raw).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det < 1e-12:
            break
        a -= float(np.clip((hbb * ga - hab * gb) / det, -0.5, 0.5))
        b -= float(np.clip((haa * gb - hab * ga) / det, -0.5, 0.5))
    return float(a), float(b)
