"""Index algebra on keys: session bounds, padding after embeddings, epochs around events, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def lengths(obs: DataFrame) -> DataFrame:
    return obs.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


#: Sessions whose lengths one task sums up in order.
RANGE_SESSIONS = 200_000


def bounds(obs: DataFrame) -> DataFrame:
    """(session_id, start, end): half-open rows of each session when sessions lie one after the other. Lengths are summed
    inside ranges of session_id, offset by the ranges' sums, so no task sees all sessions."""
    n = cut(lengths(obs))
    parts = max(1, -(-n.count() // RANGE_SESSIONS))
    ranged = cut(n.repartitionByRange(parts, "session_id").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = ranged.groupBy("part").agg(F.sum("n").alias("size")).select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("session_id"))
    return ranged.join(before, "part").select("session_id", (upto - F.col("n")).alias("start"), upto.alias("end"))


def tiled(obs: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """Regular tiles of a session: adds tile, the number of the tile of `size` rows that begins every `step` rows. Rows
    in the overlap of tiles are repeated."""
    step = step or size
    if step == size:
        return obs.withColumn("tile", F.floor(F.col("t") / size).cast("int"))
    first = F.greatest(F.lit(0), F.floor((F.col("t") - size) / step) + 1)
    return obs.withColumn("tile", F.explode(F.sequence(first.cast("int"), F.floor(F.col("t") / step).cast("int"))))


def renumbered(obs: DataFrame) -> DataFrame:
    """t counted anew from 0 after rows were dropped."""
    return obs.withColumn("t", (F.row_number().over(Window.partitionBy("session_id").orderBy("t")) - 1).cast("int"))


def take_sessions(obs: DataFrame, ids: DataFrame) -> DataFrame:
    return obs.join(ids.select("session_id").distinct(), "session_id", "left_semi")


def epochs_of(obs: DataFrame, n_times: int) -> DataFrame:
    """Sessions of n_times rows each cut out of longer ones: adds trial and tau."""
    return obs.withColumn("trial", F.floor(F.col("t") / n_times).cast("int")).withColumn("tau", (F.col("t") % n_times).cast("int"))


def pad_gamma(gamma: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Puts back the rows that an embedding of these lags dropped, with the session's mean probabilities. t of gamma
    counts from 0 after the embedding; t of the result counts the original rows."""
    before, after = max(0, max(lags)), max(0, -min(lags))
    k = gamma.select(F.size("gamma").alias("n")).first()["n"]
    s = gamma.groupBy("session_id").agg((F.max("t") + 1).alias("n"), F.array(*(F.avg(F.col("gamma")[i]) for i in range(k))).alias("mean"))
    grid = s.select("session_id", "mean", F.explode(F.sequence(F.lit(0), F.col("n") + before + after - 1)).alias("t"))
    moved = gamma.select("session_id", (F.col("t") + before).alias("t"), "gamma")
    return grid.join(moved, ["session_id", "t"], "left").select("session_id", F.col("t").cast("int").alias("t"), F.coalesce("gamma", "mean").alias("gamma"))


def pad_path(path: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """As pad_gamma, by repeating the first and the last state."""
    before, after = max(0, max(lags)), max(0, -min(lags))
    s = path.groupBy("session_id").agg((F.max("t") + 1).alias("n"), F.min_by("state", "t").alias("first"), F.max_by("state", "t").alias("last"))
    grid = s.select("session_id", "n", "first", "last", F.explode(F.sequence(F.lit(0), F.col("n") + before + after - 1)).alias("t"))
    moved = path.select("session_id", (F.col("t") + before).alias("t"), "state")
    state = F.coalesce("state", F.when(F.col("t") < before, F.col("first")).otherwise(F.col("last")))
    return grid.join(moved, ["session_id", "t"], "left").select("session_id", F.col("t").cast("int").alias("t"), state.alias("state"))


def event_epochs(obs: DataFrame, events: DataFrame, start: int, length: int) -> DataFrame:
    """Windows of obs around events: adds event_t and tau (0-based) to the rows of windows that begin `start` rows from
    the event. An event closer than the window to the one before is dropped; if that is the first gap of a session,
    both are. Windows that leave their session are dropped."""
    w = Window.partitionBy("session_id").orderBy("event_t")
    e = events.select("session_id", F.col("t").alias("event_t"))
    e = e.withColumn("gap", F.col("event_t") - F.lag("event_t").over(w)).withColumn("next_gap", F.lead("event_t").over(w) - F.col("event_t"))
    e = e.where(F.when(F.col("gap").isNull(), F.coalesce(F.col("next_gap") >= length, F.lit(True))).otherwise(F.col("gap") >= length))
    span = obs.groupBy("session_id").agg(F.max("t").alias("last"))
    e = e.join(span, "session_id").where((F.col("event_t") + start >= 0) & (F.col("event_t") + start + length - 1 <= F.col("last")))
    # windows are unfolded to their rows, so that the join is by equal keys and not by a range
    rows = e.select("session_id", "event_t", F.posexplode(F.sequence(F.col("event_t") + start, F.col("event_t") + (start + length - 1))).alias("tau", "t"))
    return rows.join(obs, ["session_id", "t"])


def rolled(obs: DataFrame, column: str, shift: int) -> DataFrame:
    """A column's values moved `shift` rows on, around the session's end."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    moved = obs.withColumn("_n", n).select("session_id", F.pmod(F.col("t") + shift, F.col("_n")).cast("int").alias("t"), column)
    return obs.drop(column).join(moved, ["session_id", "t"])


def is_one_hot(gamma: DataFrame) -> bool:
    """Whether every row has a single 1 and else 0."""
    bad = ~(F.aggregate("gamma", F.lit(0.0), lambda a, x: a + x) == 1.0) | F.exists("gamma", lambda x: ~x.isin(0.0, 1.0))
    return gamma.where(bad).limit(1).count() == 0


def labels_of(gamma: DataFrame) -> DataFrame:
    """State with the largest probability, the first among equals."""
    return gamma.select("session_id", "t", (F.array_position("gamma", F.array_max("gamma")) - 1).cast("int").alias("state"))
