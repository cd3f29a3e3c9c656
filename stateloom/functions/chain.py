"""Recursions over hidden state chains, for a batch of ragged sessions at once (NumPy).

Sessions are padded to (n, T, K) and ordered by length, so that those still running are a prefix at every step."""

from __future__ import annotations

import numpy as np

_TINY = np.finfo(float).tiny


def pad(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded, lengths, order): longest first; order holds the places of the given parts."""
    lengths = np.array([len(p) for p in parts])
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((len(parts), int(lengths.max(initial=0)), parts[0].shape[1]))
    for i, j in enumerate(order):
        out[i, : lengths[j]] = parts[j]
    return out, lengths[order], order


def _running(lengths: np.ndarray, t: int) -> int:
    return int(np.searchsorted(-lengths, -t, "left"))  # lengths above t


def _after(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows a times p, or times a matrix for each row."""
    return a @ p if p.ndim == 2 else (a[:, :, None] * p[: len(a)]).sum(1)


def forward(loglik: np.ndarray, lengths: np.ndarray, p: np.ndarray, pi: np.ndarray):
    """Scaled forward probabilities, step by step likelihoods (log), and the likelihoods that were used. p and pi: one for all
    sessions, or a matrix or row for each."""
    top = loglik.max(axis=2, keepdims=True)
    like = np.exp(loglik - top)
    n, steps, _ = loglik.shape
    first = np.broadcast_to(pi, (n, like.shape[2]))
    alpha, logc = np.zeros_like(like), np.zeros((n, steps))
    for t in range(steps):
        m = _running(lengths, t)
        a = like[:m, t] * (first[:m] if t == 0 else _after(alpha[:m, t - 1], p))
        c = np.maximum(a.sum(1), _TINY)
        alpha[:m, t] = a / c[:, None]
        logc[:m, t] = np.log(c) + top[:m, t, 0]
    return alpha, logc, like


def smooth(loglik: np.ndarray, lengths: np.ndarray, p: np.ndarray, pi: np.ndarray, tail: np.ndarray | None = None):
    """(gamma, summed pair probabilities of each session, log-likelihood of each session). tail: what follows a session, as
    a row of backward probabilities at its last step; by default nothing."""
    alpha, logc, like = forward(loglik, lengths, p, pi)
    n, steps, k = loglik.shape
    gamma, xi = np.zeros_like(alpha), np.zeros((n, k, k))
    beta = np.ones((n, k))
    after = np.ones((n, k)) if tail is None else tail
    for t in range(steps - 1, -1, -1):
        m = _running(lengths, t)
        ends = lengths[:m] == t + 1
        g = alpha[:m, t] * np.where(ends[:, None], after[:m], beta[:m])
        gamma[:m, t] = g / np.maximum(g.sum(1, keepdims=True), _TINY)
        if t:
            b = like[:m, t] * np.where(ends[:, None], after[:m], beta[:m])
            pair = alpha[:m, t - 1, :, None] * (p if p.ndim == 2 else p[:m]) * b[:, None, :]
            xi[:m] += pair / np.maximum(pair.sum((1, 2), keepdims=True), _TINY)
            back = _after(b, p.swapaxes(-1, -2))
            beta[:m] = back / np.maximum(back.sum(1, keepdims=True), _TINY)
    return gamma, xi, logc.sum(1)


def entropy(loglik: np.ndarray, lengths: np.ndarray, p: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Entropy of each session's state sequence given the data: that of the first state, and of each step given the state
    before it."""
    alpha, _, _ = forward(loglik, lengths, p, pi)
    gamma, _, _ = smooth(loglik, lengths, p, pi)
    told = lambda a, b: -(a * np.log(np.where(a > 0, b, 1.0)))
    out = told(gamma[:, 0], gamma[:, 0]).sum(1) if loglik.shape[1] else np.zeros(len(loglik))
    for t in range(1, loglik.shape[1]):
        m = _running(lengths, t)
        before = alpha[:m, t - 1]
        pair = before[:, :, None] * p * (gamma[:m, t] / np.maximum(before @ p, _TINY))[:, None]
        out[:m] += told(pair, pair / np.maximum(pair.sum(2, keepdims=True), _TINY)).sum((1, 2))
    return out


def best_path(loglik: np.ndarray, lengths: np.ndarray, p: np.ndarray, pi: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """Most likely states (n, T); the first state among equals. Entries past a session's end are -1. begin: a row of log
    scores of each session's first states, in place of those of pi; end: its last state, where that is set already."""
    n, steps, k = loglik.shape
    with np.errstate(divide="ignore"):
        lp, lpi = np.log(p), np.broadcast_to(np.log(pi), (n, k)) if begin is None else begin
    came, score = np.zeros((n, steps, k), np.int32), np.zeros((n, steps, k))
    for t in range(steps):
        m = _running(lengths, t)
        if t == 0:
            score[:m, 0] = lpi[:m] + loglik[:m, 0]
            continue
        via = score[:m, t - 1, :, None] + lp
        came[:m, t] = via.argmax(1)
        score[:m, t] = via.max(1) + loglik[:m, t]
    out = np.full((n, steps), -1, np.int32)
    for t in range(steps - 1, -1, -1):
        m = _running(lengths, t)
        ends = lengths[:m] == t + 1
        nxt = np.zeros(m, np.int32) if t + 1 == steps else np.maximum(out[:m, t + 1], 0)
        on = came[np.arange(m), min(t + 1, steps - 1), nxt] if t + 1 < steps else nxt
        out[:m, t] = np.where(ends, score[:m, t].argmax(1) if end is None else end[:m], on)
    return out


def transfer(loglik: np.ndarray, lengths: np.ndarray, p: np.ndarray, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each block of rows (scale, (n, K, K)): the probability to see its rows after the first and end in state j, given
    that its first row is in state i, divided by exp(scale). With best, the log score of the best path between the two
    instead, less scale."""
    n, steps, k = loglik.shape
    with np.errstate(divide="ignore"):
        lp = np.log(p)
    scale = np.zeros(n)
    out = np.broadcast_to(np.where(np.eye(k) > 0, 0.0, -np.inf) if best else np.eye(k), (n, k, k)).copy()
    for t in range(1, steps):
        m = _running(lengths, t)
        if best:
            move = (out[:m, :, :, None] + lp).max(2) + loglik[:m, t, None]
            top = move.max((1, 2), keepdims=True)
            top[~np.isfinite(top)] = 0.0
            out[:m] = move - top
            scale[:m] += top[:, 0, 0]
        else:
            most = loglik[:m, t].max(1)
            move = (out[:m] @ p) * np.exp(loglik[:m, t] - most[:, None])[:, None]
            c = np.maximum(move.sum((1, 2), keepdims=True), _TINY)
            out[:m] = move / c
            scale[:m] += np.log(c[:, 0, 0]) + most
    return scale, out


def sample_chain(n: int, p: np.ndarray, pi: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """A state path of length n."""
    u = r.random(n)
    cp, out = np.cumsum(p, 1), np.zeros(n, np.int32)
    k = len(pi) - 1
    for t in range(n):
        row = np.cumsum(pi) if t == 0 else cp[out[t - 1]]
        out[t] = min(int(np.searchsorted(row, u[t] * row[-1], "right")), k)
    return out
