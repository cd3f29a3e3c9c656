"""State summaries: occupancy, switching, visits and life times, evoked responses, transitions, overlap.

Occupancy and its kin sum the state vectors element by element in one partial aggregation, a row for each session
and not for each state; only the small result is unfolded to (session_id, state, ...)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.views import n_states


def _in_session():
    return Window.partitionBy("session_id").orderBy("t")


def _element_sums(gamma: DataFrame, k: int, *keys: str) -> DataFrame:
    return gamma.groupBy(*keys).agg(F.array(*(F.sum(F.col("gamma")[i]) for i in range(k))).alias("s"), F.count(F.lit(1)).alias("n"))


def _unfold(df: DataFrame, column: str, value: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(column).alias("state", value))


def occupancy(gamma: DataFrame, summation: bool = False) -> DataFrame:
    """(session_id, state, fo): summed probability of each state, as a share of the session unless summation."""
    s = _element_sums(gamma, n_states(gamma), "session_id")
    total = F.lit(1.0) if summation else F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return _unfold(s.withColumn("fo", F.transform("s", lambda x: x / total)), "fo", "fo", "session_id")


def max_occupancy(fo: DataFrame) -> DataFrame:
    return fo.groupBy("session_id").agg(F.max("fo").alias("max_fo"))


def entropy(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, entropy): sum of -p ln p over rows, with 0 ln 0 = 0."""
    p = F.col(value)
    return df.groupBy(*keys).agg(F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).alias("entropy"))


def evoked_response(gamma: DataFrame, ragged: bool = False) -> DataFrame:
    """(t, state, probability): mean over sessions of equal length. Raises if there is one session or lengths differ;
    ragged: sessions may differ, and the mean at t is over those that reach t."""
    if ragged:
        return average_by(gamma, "t")
    lengths = gamma.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("s"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    if lengths["s"] < 2 or lengths["a"] != lengths["b"]:
        raise ValueError("evoked responses need two sessions at least, all of one length")
    s = _element_sums(gamma, n_states(gamma), "t")
    return _unfold(s.withColumn("m", F.transform("s", lambda x: x / F.col("n"))), "m", "probability", "t")


def average_by(gamma: DataFrame, *keys: str) -> DataFrame:
    """(keys, state, probability): mean state probability for each key, as behind plots over time or condition."""
    s = _element_sums(gamma, n_states(gamma), *keys)
    return _unfold(s.withColumn("m", F.transform("s", lambda x: x / F.col("n"))), "m", "probability", *keys)


def condition_difference(gamma: DataFrame, condition: str = "condition", digits: int = 3) -> DataFrame:
    """(t, state, first, second, difference) of the two conditions' mean probabilities, rounded before the difference."""
    lo, hi = (r[0] for r in gamma.select(condition).distinct().orderBy(condition).limit(3).collect())
    m = average_by(gamma, condition, "t").withColumn("probability", F.round("probability", digits))
    both = m.groupBy("t", "state").agg(F.max(F.when(F.col(condition) == lo, F.col("probability"))).alias("first"), F.max(F.when(F.col(condition) == hi, F.col("probability"))).alias("second"))
    return both.withColumn("difference", F.col("first") - F.col("second") + 0.0)


def switching_rate(gamma: DataFrame) -> DataFrame:
    """(session_id, state, rate): mean absolute change of a state's probability between neighbours."""
    k = n_states(gamma)
    before = F.lag("gamma").over(_in_session())
    moved = gamma.withColumn("before", before).where("before is not null")
    m = moved.groupBy("session_id").agg(F.array(*(F.avg(F.abs(F.col("gamma")[i] - F.col("before")[i])) for i in range(k))).alias("m"))
    return _unfold(m, "m", "rate", "session_id")


def visits(path: DataFrame) -> DataFrame:
    """(session_id, state, onset, length): maximal runs of one state in a session."""
    w = _in_session()
    new = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1))
    runs = path.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("session_id", "run", "state").agg(F.min("t").alias("onset"), F.count(F.lit(1)).alias("length")).drop("run")


def life_times(path: DataFrame, k: int, threshold: int = 0) -> DataFrame:
    """(session_id, state, mean, median, max) of visits longer than the threshold; 0 for a state without any."""
    v = visits(path).where(F.col("length") > threshold)
    found = v.groupBy("session_id", "state").agg(F.avg("length").alias("mean"), F.median("length").alias("median"), F.max("length").cast("double").alias("max"))
    grid = path.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("state"))
    return grid.join(found, ["session_id", "state"], "left").fillna(0.0, ["mean", "median", "max"])


def state_onsets(path: DataFrame) -> DataFrame:
    """(session_id, state, onsets): when each visit begins, in order."""
    return visits(path).groupBy("session_id", "state").agg(F.sort_array(F.collect_list("onset")).alias("onsets"))


def transition_counts(path: DataFrame) -> DataFrame:
    """(source, target, n): steps between neighbours of one session."""
    steps = path.withColumn("target", F.lead("state").over(_in_session())).where("target is not null")
    return steps.groupBy(F.col("state").alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))


def transition_matrix(path: DataFrame, with_self: bool = True) -> DataFrame:
    """(source, target, probability); without self transitions rows are normalised over the others."""
    c = transition_counts(path)
    c = c if with_self else c.where("source <> target")
    return c.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("source"))).drop("n")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(state_a, state_b, overlap): summed minimum of two posteriors over equal (session_id, t), over the rows."""
    ka, kb = n_states(a), n_states(b)
    j = a.join(b.select("session_id", "t", F.col("gamma").alias("other")), ["session_id", "t"])
    sums = j.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.least(F.col("gamma")[i], F.col("other")[m])).alias(f"s_{i}_{m}") for i in range(ka) for m in range(kb)))
    rows = F.array(*(F.struct(F.lit(i).alias("state_a"), F.lit(m).alias("state_b"), (F.col(f"s_{i}_{m}") / F.col("n")).alias("overlap")) for i in range(ka) for m in range(kb)))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def assign(cost: np.ndarray) -> np.ndarray:
    """Columns that give the rows of a square cost matrix the smallest sum (shortest augmenting paths)."""
    n = len(cost)
    u, v, of_col = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, n)
    for i in range(n):
        of_col[n] = i
        j, least, back, done = n, np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while of_col[j] != n:
            done[j] = True
            free = ~done[:n]
            reduced = cost[of_col[j]] - u[of_col[j]] - v[:n]
            better = free & (reduced < least)
            least[better], back[better] = reduced[better], j
            nxt = int(np.argmin(np.where(free, least, np.inf)))
            step = least[nxt]
            u[of_col[done]] += step
            v[:][done] -= step
            least[free] -= step
            j = nxt
        while j != n:
            of_col[j] = of_col[back[j]]
            j = back[j]
    out = np.empty(n, int)
    out[of_col[:n]] = np.arange(n)
    return out


def similarity(a: DataFrame, b: DataFrame) -> tuple[float, list[tuple[int, int]]]:
    """Similarity of two posteriors after the best matching of their states, and the matching. The smaller one is
    filled with states of probability 0."""
    rows = overlap(a, b).collect()
    k = max(max(r["state_a"], r["state_b"]) for r in rows) + 1
    m = np.zeros((k, k))
    for r in rows:
        m[r["state_a"], r["state_b"]] = r["overlap"]
    to = assign(-m)
    return float(m[np.arange(k), to].sum()), [(i, int(j)) for i, j in enumerate(to)]


def summary_features(gamma: DataFrame, path: DataFrame, metrics: tuple[str, ...] = ("fo", "switching", "lifetimes")) -> DataFrame:
    """(session_id, features): the named summaries of each session side by side, state by state."""
    k = n_states(gamma)
    parts = {"fo": lambda: occupancy(gamma).withColumnRenamed("fo", "v"), "switching": lambda: switching_rate(gamma).withColumnRenamed("rate", "v"), "lifetimes": lambda: life_times(path, k).select("session_id", "state", F.col("mean").alias("v"))}
    if unknown := set(metrics) - set(parts):
        raise ValueError(f"unknown metrics {sorted(unknown)}; there are {sorted(parts)}")
    rows = None
    for i, name in enumerate(metrics):
        part = parts[name]().select("session_id", (F.col("state") + i * k).alias("i"), F.col("v").cast("double"))
        rows = part if rows is None else rows.unionByName(part)
    ordered = F.sort_array(F.collect_list(F.struct("i", "v")))
    return rows.groupBy("session_id").agg(F.transform(ordered, lambda s: s["v"]).alias("features"))


def significant_intervals(p: DataFrame, alpha: float = 0.05, *keys: str) -> DataFrame:
    """(keys, start, end): runs of tau, both ends included, where p < alpha. p has keys, tau and p."""
    w = Window.partitionBy(*keys).orderBy("tau") if keys else Window.orderBy("tau")
    low = p.where(F.col("p") < alpha).withColumn("run", F.col("tau") - F.row_number().over(w))
    return low.groupBy(*keys, "run").agg(F.min("tau").alias("start"), F.max("tau").alias("end")).drop("run")
