"""SQL fragments shared by the queries' DuckDB equivalents."""

from __future__ import annotations

from .views import SOFT, SOFT_OTHER

SEQ = """seq AS (
  SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t, value, event_type
  FROM events)"""
STATES = SEQ + """,
codes AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS state FROM (SELECT DISTINCT event_type FROM events)),
path AS (SELECT session_id, t, state, value FROM seq JOIN codes USING (event_type))"""
RUNS = STATES + """,
marked AS (
  SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY session_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM path),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY t) AS run FROM marked),
visits AS (SELECT session_id, state, min(t) AS onset, count(*) AS length FROM numbered GROUP BY session_id, run, state)"""


def soft(name: str = "soft", scores=SOFT, source: str = "seq") -> str:
    """A CTE (session_id, t, g0, g1, ...) of softmax scores."""
    e = [f"exp({a} + ({b}) * value)" for a, b in scores]
    total = " + ".join(e)
    return f"{name} AS (SELECT session_id, t, " + ", ".join(f"{x} / ({total}) AS g{i}" for i, x in enumerate(e)) + f" FROM {source})"


def long(name: str, wide: str, k: int) -> str:
    """A CTE (session_id, t, state, g) from g0, g1, ..."""
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT session_id, t, {i} AS state, g{i} AS g FROM {wide}" for i in range(k)) + ")"


SOFT_LONG = SEQ + ",\n" + soft() + ",\n" + long("gl", "soft", len(SOFT))
OTHER_LONG = soft("soft2", SOFT_OTHER) + ",\n" + long("gl2", "soft2", len(SOFT_OTHER))
