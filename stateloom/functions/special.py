"""Special functions and distributions in NumPy."""

from __future__ import annotations

import math

import numpy as np

_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gammaln(x):
    """Logarithm of the gamma function for positive arguments (Lanczos, and reflection below 0.5)."""
    x = np.asarray(x, float)
    small = x < 0.5
    z = np.where(small, 1 - x, x) - 1
    s = _LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = z + 7.5
    out = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(s)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(small, np.log(np.pi / np.abs(np.sin(np.pi * x))) - out, out)


def digamma(x):
    """Logarithmic derivative of the gamma function for positive arguments (recurrence, then the series)."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132)))))
    return out + np.log(x) - 0.5 / x - series


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (continued fraction)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(float(gammaln(a + b) - gammaln(a) - gammaln(b)) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def f_sf(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    if not f > 0:
        return 1.0
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Quantile of the standard normal distribution (bisection refined by Newton steps)."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    z = (lo + hi) / 2
    for _ in range(3):
        d = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        if d > 0:
            z -= (normal_cdf(z) - p) / d
    return z


# Divergences


def gauss_kl(mu_q, cov_q, mu_p, cov_p) -> float:
    inv = np.linalg.inv(cov_p)
    d = mu_q - mu_p
    return 0.5 * float(np.linalg.slogdet(cov_p)[1] - np.linalg.slogdet(cov_q)[1] - len(d) + np.trace(inv @ cov_q) + d @ inv @ d)


def gauss1d_kl(mu_q, var_q, mu_p, var_p):
    """Elementwise, with the constant of the multivariate form."""
    return 0.5 * (np.log(var_p / var_q) + ((mu_q - mu_p) ** 2 + var_q) / var_p - 1)


def gamma_kl(shape_q, rate_q, shape_p, rate_p):
    return shape_p * np.log(rate_q / rate_p) + gammaln(shape_p) - gammaln(shape_q) + (shape_q - shape_p) * digamma(shape_q) - (rate_q - rate_p) * shape_q / rate_q


def wishart_kl(shape_q: float, rate_q, shape_p: float, rate_p) -> float:
    n = len(rate_q)
    j = np.arange(n)
    ld_q, ld_p = np.linalg.slogdet(rate_q)[1], np.linalg.slogdet(rate_p)[1]
    norm = lambda a, ld: 0.5 * a * (ld - n * math.log(2)) - gammaln((a - j) / 2).sum()
    expected = digamma((shape_q - j) / 2).sum() + n * math.log(2) - ld_q
    return float(norm(shape_q, ld_q) - norm(shape_p, ld_p) + 0.5 * (shape_q - shape_p) * expected - 0.5 * shape_q * n + 0.5 * shape_q * np.trace(rate_p @ np.linalg.inv(rate_q)))


def dirichlet_kl(q, p) -> float:
    on = (q > 0) & (p > 0)
    q, p = q[on], p[on]
    return float(gammaln(q.sum()) - gammaln(p.sum()) + (gammaln(p) - gammaln(q)).sum() + ((q - p) * (digamma(q) - digamma(q.sum()))).sum())
