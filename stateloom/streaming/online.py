"""Streaming forms of the batch operators: extensions, as the batch library has no streams.

Filtering is forward only: a state's probability given what has come so far, never the smoothed posterior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import dsp
from ..operators.hmm import Model, Options, packed, statistics


def filtered(stream: DataFrame, model: Model, time: str = "ts") -> DataFrame:
    """(session_id, at, gamma): forward probabilities of a stream (session_id, ts, y), one session's state kept as its
    last probabilities, without a timeout. Rows of a micro-batch are put in order of time; rows that come later than that
    count as new."""
    kind = dict(stream.dtypes)["session_id"]
    k, p, pi = model.spec.n_states, model.moves, model.starts

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.array(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("at")
        ll = model.loglik(np.stack(rows["y"].to_numpy()), None)
        out = np.empty((len(rows), k))
        for i, v in enumerate(ll):
            a = (pi if last is None else last @ p) * np.exp(v - v.max())
            last = out[i] = a / a.sum()
        state.update((last.tolist(),))
        yield pd.DataFrame({"session_id": [key[0]] * len(rows), "at": rows["at"], "gamma": list(out)})

    rows = stream.select("session_id", F.col(time).alias("at"), "y")
    return rows.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, at timestamp, gamma array<double>", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def running_occupancy(stream: DataFrame, n_states: int, late: str = "10 minutes", every: str = "1 hour", time: str = "ts") -> DataFrame:
    """(session_id, window, fo): shares of the states in tumbling windows; rows later than the watermark are dropped."""
    g = stream.withWatermark(time, late).groupBy("session_id", F.window(time, every))
    sums = g.agg(F.array(*(F.sum(F.col("gamma")[i]) for i in range(n_states))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, b: a + b)
    return sums.select("session_id", "window", F.transform("s", lambda v: v / total).alias("fo"))


def visit_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(session_id, state, window, n): stays in a state as session windows, closed by the watermark."""
    return stream.withWatermark(time, late).groupBy("session_id", "state", F.session_window(time, gap).alias("window")).agg(F.count(F.lit(1)).alias("n"))


def taper_windows(stream: DataFrame, fs: float, window: int, half_bandwidth: float = 4.0, tapers: int = 7, time: str = "ts") -> DataFrame:
    """(session_id, window, f, i, j, re, im), i <= j: multitaper cross spectra of each `window` consecutive rows of a
    stream (session_id, ts, y), as the window fills. A session's state is the rows of its open window."""
    kind = dict(stream.dtypes)["session_id"]
    table, freqs = dsp.slepian(window, half_bandwidth, tapers), np.fft.rfftfreq(window, 1 / fs)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, done = state.get if state.exists else ([], 0)
        y = np.stack(pd.concat(list(frames)).sort_values("at")["y"].to_numpy())
        y = np.concatenate([np.array(left, float).reshape(-1, y.shape[1]), y])
        n = len(y) // window
        i, j = np.triu_indices(y.shape[1])
        for k in range(n):
            s = np.fft.rfft(y[None, k * window : (k + 1) * window] * table[:, :, None], axis=1)
            c = np.einsum("tfi,tfj->fij", np.conj(s), s)[:, i, j] * (2 / fs / len(table))
            yield pd.DataFrame({"session_id": key[0], "window": done + k, "f": np.repeat(freqs, len(i)), "i": np.tile(i, len(freqs)), "j": np.tile(j, len(freqs)), "re": c.real.ravel(), "im": c.imag.ravel()})
        state.update((y[n * window :].ravel().tolist(), done + n))

    rows = stream.select("session_id", F.col(time).alias("at"), "y")
    columns = f"session_id {kind}, window long, f double, i int, j int, re double, im double"
    return rows.groupBy("session_id").applyInPandasWithState(step, columns, "open array<double>, done long", "append", GroupStateTimeout.NoTimeout)


class MiniBatch:
    """For foreachBatch: updates a model by each micro-batch of (session_id, t, y[, x]) with falling weight."""

    def __init__(self, model: Model, options: Options | None = None):
        self.model, self.options = model, options or Options()

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if batch.limit(1).count():
            rho = (epoch + 2) ** -self.options.forget
            st = statistics(packed(batch), self.model)
            self.model.set_dynamics(st["first"], st["xi"], rho)
            self.model.update(st, 1.0, rho)
