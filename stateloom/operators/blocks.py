"""Recursions along sessions that are larger than a task: state probabilities, best paths and filters.

A session is cut into blocks of rows by t. A first pass makes of each block what it does to whatever comes before it: a
K x K matrix of scaled transitions and likelihoods (sums of products, or best scores), or the linear map of a filter's
state. Such parts combine associatively, so a small table of them is scanned: in order where a session has few blocks,
else group by group, the groups' products first (of those again groups, if need be). What comes out is each block's carry,
the state in which it is entered. A second pass fills the rows of each block from its carries. No task holds more
than some blocks, or `FAN` parts, of a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chain, dsp
from ..plans.lineage import cut
from . import hmm

#: Rows of a block, by default.
BLOCK_ROWS = 4096
#: Parts that one task scans in order.
FAN = 1024

Step = Callable[[np.ndarray | None, np.ndarray], np.ndarray]


def scan(parts: DataFrame, step: Step, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], backwards: bool = False, fan: int | None = None) -> DataFrame:
    """(session_id, block, carry): what the blocks before each block (after it, with backwards) leave. parts: (session_id,
    block, part ARRAY<DOUBLE>), blocks numbered from 0 upwards, with gaps or not. step(carry, part) is the carry behind a
    part, from None at the start; combine(a, b) is the part that does what a and then b do. The first carry is null."""
    fan = fan or FAN
    kind = dict(parts.dtypes)["session_id"]
    schema = f"session_id {kind}, block long, carry array<double>"
    last = parts.agg(F.max("block")).first()[0]

    out = hmm._arrow(schema)

    def in_order(batches):
        for b in batches:
            rows = []
            for r, numbers, made in _listed_parts(b):
                carry = None if r.get("before") is None else np.asarray(r["before"])
                for block, part in zip(numbers, made):
                    rows.append((r["session_id"], block, carry))
                    carry = step(carry, part)
            if rows:
                yield hmm._told(out, *map(list, zip(*rows)))

    listed = F.sort_array(F.collect_list(F.struct("block", "part")), not backwards).alias("parts")
    if last is None or last < fan:
        return parts.groupBy("session_id").agg(listed).mapInArrow(in_order, schema)
    grouped = parts.withColumn("group", F.floor(F.col("block") / fan)).groupBy("session_id", "group").agg(listed)
    whole_schema = f"session_id {kind}, block long, part array<double>"
    wholes = hmm._arrow(whole_schema)

    def product(batches):
        for b in batches:
            rows = [(r["session_id"], r["group"], reduce(combine, made)) for r, _, made in _listed_parts(b)]
            if rows:
                yield hmm._told(wholes, *map(list, zip(*rows)))

    grouped = cut(grouped)
    products = cut(grouped.mapInArrow(product, whole_schema))
    entered = scan(products, step, combine, backwards, fan).select("session_id", F.col("block").alias("group"), F.col("carry").alias("before"))
    return grouped.join(entered, ["session_id", "group"]).mapInArrow(in_order, schema)


def _listed_parts(batch):
    """(the other columns, the numbers of the blocks, their parts as rows of a matrix) of each row of an Arrow batch."""
    names = [f.name for f in batch.schema if f.name != "parts"]
    column = batch.column(batch.schema.get_field_index("parts"))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    if not len(ends):
        return
    block, part = column.flatten().flatten()
    block, part = block.to_pylist(), hmm._numbers(part)
    for r, a, b in zip(batch.select(names).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
        yield r, block[a:b], part[a:b]


def cut_rows(obs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block of a session: session_id, block and rows, its (t, y, x) in order. A block holds the rows of
    `block_rows` consecutive values of t. Null or negative t raise in the job."""
    x = F.col("x") if "x" in obs.columns else F.lit(None).cast("array<double>")
    t = F.when(F.col("t") >= 0, F.col("t")).otherwise(F.raise_error(F.lit("t is a whole number from 0")))
    row = F.struct("t", F.col("y").cast("array<double>").alias("y"), x.alias("x"))
    return obs.groupBy("session_id", F.floor(t / block_rows).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _held(batches, *carries: str):
    """Lists of (session, block, y, x, t, carries) of blocks that are worked on at once."""
    held, longest = [], 0
    for b in batches:
        told = b.select(["session_id", "block", *carries]).to_pylist()
        for i, y, x, t in hmm._opened(b):
            if held and (len(held) + 1) * max(longest, len(y)) > hmm.BATCH_ROWS:
                yield held
                held, longest = [], 0
            r = told[i]
            held.append((r["session_id"], r["block"], y, x, t, *(None if r[c] is None else np.asarray(r[c], float) for c in carries)))
            longest = max(longest, len(y))
    if held:
        yield held


def _liks(model, held) -> list[np.ndarray]:
    return hmm._liks(model, [h[2:5] for h in held])


def _rows_of(schema, held, order, lengths, values):
    """A record batch (session_id, t, value) of blocks in the given order, of padded values."""
    ids = hmm._repeated([held[j][0] for j in order], lengths)
    return hmm._told(schema, ids, np.concatenate([held[j][4] for j in order]), np.concatenate([values[i, :n] for i, n in enumerate(lengths)]))


class _Chain:
    """Parts of a hidden chain: [log scale, the first row's log likelihoods (K), transfer from first to last row (K x K)].
    Carries forward: [log scale, state probabilities or scores at the row before (K)]; backward: what follows (K)."""

    def __init__(self, model, best: bool = False):
        self.model, self.k, self.p, self.best = model, len(model.starts), model.moves, best
        with np.errstate(divide="ignore"):
            self.lp, self.lpi = np.log(model.moves), np.log(model.starts)

    def parts(self, obs: DataFrame, block_rows: int) -> DataFrame:
        kind = dict(obs.dtypes)["session_id"]

        ddl = f"session_id {kind}, block long, part array<double>"
        out = hmm._arrow(ddl)

        def run(batches):
            for held in _held(batches):
                padded, lengths, order = chain.pad(_liks(self.model, held))
                scale, move = chain.transfer(padded, lengths, self.p, self.best)
                part = np.concatenate([scale[:, None], padded[:, 0], move.reshape(len(move), -1)], 1)
                yield hmm._told(out, [held[j][0] for j in order], [held[j][1] for j in order], part)

        return cut(cut_rows(obs, block_rows).mapInArrow(run, ddl))

    def _open(self, part):
        return part[0], part[1 : 1 + self.k], part[1 + self.k :].reshape(self.k, self.k)

    def enter(self, carry: np.ndarray | None) -> np.ndarray:
        """Of a block's first row: log scores (with best) or probabilities of its state before it is seen."""
        if self.best:
            return self.lpi if carry is None else (carry[1:, None] + self.lp).max(0)
        return self.model.starts if carry is None else carry[1:] @ self.p

    def step(self, carry: np.ndarray | None, part: np.ndarray) -> np.ndarray:
        scale, first, move = self._open(part)
        before = 0.0 if carry is None else carry[0]
        if self.best:
            v = ((self.enter(carry) + first)[:, None] + move).max(0)
            top = v.max() if np.isfinite(v.max()) else 0.0
            return np.concatenate([[before + scale + top], v - top])
        top = first.max()
        v = (self.enter(carry) * np.exp(first - top)) @ move
        c = max(v.sum(), np.finfo(float).tiny)
        return np.concatenate([[before + scale + top + np.log(c)], v / c])

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (sa, fa, ma), (sb, fb, mb) = self._open(a), self._open(b)
        if self.best:
            m = (((ma[:, :, None] + self.lp).max(1) + fb)[:, :, None] + mb).max(1)
            top = m.max() if np.isfinite(m.max()) else 0.0
            return np.concatenate([[sa + sb + top], fa, (m - top).ravel()])
        most = fb.max()
        m = ((ma @ self.p) * np.exp(fb - most)) @ mb
        c = max(m.sum(), np.finfo(float).tiny)
        return np.concatenate([[sa + sb + most + np.log(c)], fa, (m / c).ravel()])

    def back(self, carry: np.ndarray | None, part: np.ndarray) -> np.ndarray:
        """What follows the row before a block, given what follows the block."""
        _, first, move = self._open(part)
        b = self.p @ (np.exp(first - first.max()) * (move @ (np.ones(self.k) if carry is None else carry)))
        return b / max(b.sum(), np.finfo(float).tiny)


def decode(obs: DataFrame, model, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(session_id, t, gamma) as `hmm.decode`, for sessions of any length; t counts rows from 0 (gaps are no rows)."""
    c = _Chain(model)
    parts = c.parts(obs, block_rows)
    ahead = scan(parts, c.step, c.combine)
    behind = scan(parts, c.back, lambda a, b: c.combine(b, a), backwards=True).withColumnRenamed("carry", "tail")
    kind = dict(obs.dtypes)["session_id"]

    ddl = f"session_id {kind}, t int, gamma array<double>"
    out = hmm._arrow(ddl)

    def run(batches):
        for held in _held(batches, "carry", "tail"):
            padded, lengths, order = chain.pad(_liks(model, held))
            starts = np.array([c.enter(held[j][5]) for j in order])
            tails = np.array([np.ones(c.k) if held[j][6] is None else held[j][6] for j in order])
            gamma, _, _ = chain.smooth(padded, lengths, c.p, starts, tails)
            yield _rows_of(out, held, order, lengths, gamma)

    rows = cut_rows(obs, block_rows).join(ahead.join(behind, ["session_id", "block"]), ["session_id", "block"])
    return rows.mapInArrow(run, ddl)


def loglik(obs: DataFrame, model, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(session_id, loglik) as `hmm.loglik`: the carry behind each session's last block."""
    c = _Chain(model)
    parts = c.parts(obs, block_rows)
    ends = scan(parts, c.step, c.combine).join(parts, ["session_id", "block"])
    last = ends.groupBy("session_id").agg(F.max_by(F.struct("carry", "part"), "block").alias("last"))

    @F.pandas_udf("double")
    def behind(carry: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([c.step(None if v is None else np.asarray(v, float), np.asarray(w, float))[0] for v, w in zip(carry, part)])

    return last.select("session_id", behind("last.carry", "last.part").alias("loglik"))


def viterbi(obs: DataFrame, model, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(session_id, t, state) as `hmm.viterbi`, for sessions of any length. Going back, a block maps its last state to the
    last state of the block before; such maps combine like other parts."""
    c = _Chain(model, best=True)
    parts = c.parts(obs, block_rows)
    ahead = cut(scan(parts, c.step, c.combine))
    kind = dict(obs.dtypes)["session_id"]

    step_ddl = f"session_id {kind}, block long, part array<double>"
    told = hmm._arrow(step_ddl)

    def maps(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                carry, part = (None if r[n] is None else np.asarray(r[n], float) for n in ("carry", "part"))
                _, first, move = c._open(part)
                end = c.step(carry, part)[1:].argmax()
                # for each last state the state before the block; and which last state is best, for a session's last block
                came = np.zeros(c.k) if carry is None else (carry[1:, None] + ((c.lp + first)[:, :, None] + move).max(1)).argmax(0)
                out.append((r["session_id"], r["block"], np.append(came, end).astype(float)))
            if out:
                yield hmm._told(told, *map(list, zip(*out)))

    steps = cut(ahead.join(parts, ["session_id", "block"]).mapInArrow(maps, step_ddl))
    # the carry is the last state of the block before, as a single number
    follow = lambda carry, part: part[[int(part[-1] if carry is None else carry[0])]]
    both = lambda a, b: np.append(b[a[:-1].astype(int)], a[-1])
    ends = scan(steps, follow, both, backwards=True).withColumnRenamed("carry", "last")
    tops = steps.select("session_id", "block", F.element_at("part", -1).alias("top"))
    states = ends.join(tops, ["session_id", "block"]).select("session_id", "block", F.coalesce(F.col("last"), F.array("top")).alias("last"))

    ddl = f"session_id {kind}, t int, state int"
    paths_of = hmm._arrow(ddl)

    def run(batches):
        for held in _held(batches, "carry", "last"):
            padded, lengths, order = chain.pad(_liks(model, held))
            begin = np.array([c.enter(held[j][5]) for j in order])
            paths = chain.best_path(padded, lengths, c.p, model.starts, begin, np.array([int(held[j][6][0]) for j in order]))
            yield _rows_of(paths_of, held, order, lengths, paths)

    rows = cut_rows(obs, block_rows).join(ahead.join(states, ["session_id", "block"]), ["session_id", "block"])
    return rows.mapInArrow(run, ddl)


def filtered(obs: DataFrame, band: tuple[float | None, float | None], fs: float, order: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(session_id, t, y) as `preprocess.filtered`, for sessions of any length: a block's part is the power of the filter's
    state map and the state that its own rows leave, its carry the state in which it is entered."""
    sos = dsp.butterworth_sos(order, band, fs)
    m = 2 * len(sos)
    kind = dict(obs.dtypes)["session_id"]

    part_ddl, ddl = f"session_id {kind}, block long, part array<double>", f"session_id {kind}, t int, y array<double>"
    parts_out, rows_out = hmm._arrow(part_ddl), hmm._arrow(ddl)

    def parts_of(batches):
        for held in _held(batches):
            ys, lengths, places = chain.pad([y for _, _, y, *_ in held])
            n, steps, q = ys.shape
            _, end = dsp.sos_blocks(sos, ys, lengths, np.zeros((n, len(sos), 2, q)))
            # the same rows of zeros from each unit state: one channel for each
            unit = np.broadcast_to(np.eye(m).reshape(len(sos), 2, m), (n, len(sos), 2, m))
            _, power = dsp.sos_blocks(sos, np.zeros((n, steps, m)), lengths, unit)
            part = np.concatenate([power.reshape(n, m * m), end.reshape(n, m * q)], 1)
            yield hmm._told(parts_out, [held[j][0] for j in places], [held[j][1] for j in places], part)

    opened = lambda part: (part[: m * m].reshape(m, m), part[m * m :].reshape(m, -1))

    def step(carry, part):
        a, end = opened(part)
        return (end if carry is None else a @ carry.reshape(m, -1) + end).ravel()

    def combine(x, y):
        (a, e), (b, g) = opened(x), opened(y)
        return np.concatenate([(b @ a).ravel(), (b @ e + g).ravel()])

    parts = cut(cut_rows(obs, block_rows).mapInArrow(parts_of, part_ddl))
    entered = scan(parts, step, combine)

    def run(batches):
        for held in _held(batches, "carry"):
            ys, lengths, places = chain.pad([y for _, _, y, *_ in held])
            n, _, q = ys.shape
            state = np.stack([np.zeros((len(sos), 2, q)) if held[j][5] is None else held[j][5].reshape(len(sos), 2, q) for j in places])
            out, _ = dsp.sos_blocks(sos, ys, lengths, state)
            yield _rows_of(rows_out, held, places, lengths, out)

    return cut_rows(obs, block_rows).join(entered, ["session_id", "block"]).mapInArrow(run, ddl)
