"""Signal processing in NumPy: Butterworth filters, Hilbert transform, resampling, Slepian tapers, ICA, NMF."""

from __future__ import annotations

import math

import numpy as np


def butterworth_sos(order: int, band: tuple[float | None, float | None], fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a Butterworth filter. band: (0 or None, h) passes below h, (l, None)
    above l, (l, h) between."""
    lo, hi = band
    warp = lambda f: 2 * fs * math.tan(math.pi * f / fs)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if not lo and hi:
        w = warp(hi)
        poles, zeros, gain = proto * w, np.zeros(0, complex), w**order
    elif lo and hi is None:
        w = warp(lo)
        poles, zeros, gain = w / proto, np.zeros(order, complex), 1.0 / np.real(np.prod(-proto))
    elif lo and hi:
        a, b = warp(lo), warp(hi)
        half, mid = (b - a) / 2 * proto, a * b
        root = np.sqrt(half**2 - mid)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), (b - a) ** order
    else:
        raise ValueError("a filter needs a lower or an upper frequency")
    c = 2 * fs
    gain = float(np.real(gain * np.prod(c - zeros) / np.prod(c - poles)))
    z = np.concatenate([(c + zeros) / (c - zeros), -np.ones(len(poles) - len(zeros))])
    p = (c + poles) / (c - poles)
    return _sections(np.real(z), p, gain)


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    upper = poles[poles.imag > 1e-12]
    real = np.sort(poles[np.abs(poles.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[0::2], real[1::2])]
    if len(real) % 2:
        pairs.append((-real[-1], 0.0))
    zeros = np.sort(zeros)
    # the smallest and the largest zero meet in a section, which keeps band-pass sections of unit scale
    out, lo, hi = [], 0, len(zeros) - 1
    for a1, a2 in pairs:
        if a2 == 0.0 and lo == hi:
            b = (1.0, -zeros[lo], 0.0)
            lo += 1
        else:
            b = (1.0, -(zeros[lo] + zeros[hi]), zeros[lo] * zeros[hi])
            lo, hi = lo + 1, hi - 1
        out.append([*b, 1.0, a1, a2])
    out = np.array(out)
    out[0, :3] *= gain
    return out


def sos_filter(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Causal filtering along the first axis from a zero state (direct form II transposed)."""
    y = np.array(x, float)
    for b0, b1, b2, _, a1, a2 in sos:
        s1 = s2 = np.zeros(y.shape[1:])
        out = np.empty_like(y)
        for t in range(len(y)):
            v = y[t]
            o = b0 * v + s1
            s1 = b1 * v - a1 * o + s2
            s2 = b2 * v - a2 * o
            out[t] = o
        y = out
    return y


def sos_blocks(sos: np.ndarray, y: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters blocks (n, T, q) of the given lengths, longest first, from a state (n, sections, 2, q) each: the outcome and
    the state after each block's last row."""
    y, state = np.array(y, float), np.array(state, float)
    for t in range(y.shape[1]):
        m = int(np.searchsorted(-lengths, -t, "left"))  # lengths above t
        v = y[:m, t]
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            o = b0 * v + state[:m, i, 0]
            state[:m, i, 0] = b1 * v - a1 * o + state[:m, i, 1]
            state[:m, i, 1] = b2 * v - a2 * o
            v = o
        y[:m, t] = v
    return y, state


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal along the first axis (Hilbert transform by FFT)."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=0) * h.reshape(-1, *[1] * (x.ndim - 1)), axis=0)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling along the first axis with a Kaiser-windowed low pass (beta 5, ten zero crossings)."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return np.array(x, float)
    most = max(up, down)
    half = 10 * most
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / most) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n_out = -(-len(x) * up // down)
    spread = np.zeros((len(x) * up, *x.shape[1:]))
    spread[::up] = x
    flat = spread.reshape(len(spread), -1)
    full = np.stack([np.convolve(c, taps) for c in flat.T], 1)[half : half + len(spread)]
    return full[::down][:n_out].reshape(n_out, *x.shape[1:])


def slepian(n: int, nw: float, k: int) -> np.ndarray:
    """The first k discrete prolate spheroidal sequences of length n, as rows of unit norm. Even ones have a positive
    sum; odd ones begin with a positive lobe."""
    i = np.arange(n)
    diag = ((n - 1 - 2 * i) / 2.0) ** 2 * math.cos(2 * math.pi * nw / n)
    off = i[1:] * (n - i[1:]) / 2.0
    _, vec = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    out = vec[:, ::-1][:, :k].T.copy()
    for j, row in enumerate(out):
        sign = row.sum() if j % 2 == 0 else row[np.flatnonzero(np.abs(row) > 1e-7 * np.abs(row).max())[0]]
        if sign < 0:
            out[j] = -row
    return out


def nmf(x: np.ndarray, k: int, steps: int = 500, tol: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """x ~ w @ h with non-negative factors (multiplicative updates); also the Frobenius error."""
    r = np.random.default_rng(seed)
    scale = math.sqrt(max(x.mean(), 1e-12) / k)
    w, h = r.random((x.shape[0], k)) * scale + 1e-3, r.random((k, x.shape[1])) * scale + 1e-3
    last = math.inf
    for step in range(steps):
        h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (x @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
        if step % 10 == 9:
            error = float(np.linalg.norm(x - w @ h))
            if last - error < tol * max(error, 1e-12):
                break
            last = error
    return w, h, float(np.linalg.norm(x - w @ h))


def orthonormal_rows(w: np.ndarray) -> np.ndarray:
    """The nearest matrix with orthonormal rows: (w wT)^-1/2 w."""
    s, u = np.linalg.eigh(w @ w.T)
    return u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-300))) @ u.T @ w
