"""Time-series views of plain tables, and ways to build the session tables that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, session: str, *order: str) -> DataFrame:
    """Adds session_id and t, the place in the session from 0 by the order columns."""
    t = F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1
    return df.withColumn("session_id", F.col(session)).withColumn("t", t.cast("int"))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ragged sessions, one for each user: session_id, t, value, event_type, y = [value]."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return numbered(e, "user_id", "ts", "event_id").select("session_id", "t", "value", "event_type", F.array("value").alias("y"))


def coded(df: DataFrame, column: str, name: str = "state") -> DataFrame:
    """Adds the 0-based rank of a label among the distinct labels, which are first reduced to one row each."""
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = labels.withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(codes, column)


def state_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, t, state, value): the event type as a state path."""
    return coded(sequence(spark, sf_dir), "event_type").select("session_id", "t", "state", "value")


#: Intercepts and slopes of the fixed scores that stand in for a model's posterior.
SOFT = ((0.0, 0.0), (0.5, -0.02), (-0.5, 0.01))
SOFT_OTHER = ((0.2, 0.0), (0.0, 0.015), (0.1, -0.01))


def soft_gamma(seq: DataFrame, scores=SOFT) -> DataFrame:
    """(session_id, t, gamma): softmax of linear scores of the value."""
    e = [F.exp(F.lit(a) + F.lit(b) * F.col("value")) for a, b in scores]
    total = sum(e[1:], e[0])
    return seq.select("session_id", "t", F.array(*(x / total for x in e)).alias("gamma"))


def one_hot(path: DataFrame, n_states: int) -> DataFrame:
    """(session_id, t, gamma) with 1 at the path's state."""
    g = F.transform(F.sequence(F.lit(0), F.lit(n_states - 1)), lambda k: (k == F.col("state")).cast("double"))
    return path.select("session_id", "t", g.alias("gamma"))


def n_states(gamma: DataFrame) -> int:
    """Length of the state vectors, from the first row; 0 for an empty table."""
    row = gamma.select(F.size("gamma").alias("n")).first()
    return row["n"] if row else 0


def renumber_rows(obs: DataFrame) -> DataFrame:
    """t counted anew from 0 in each session, in the order of t."""
    t = F.row_number().over(Window.partitionBy("session_id").orderBy("t")) - 1
    return obs.withColumn("t", t.cast("int"))
