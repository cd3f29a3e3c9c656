"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import inference, results, series

assert inference and results  # they register their queries in the same tables
QUERIES = series.QUERIES
SQL = series.SQL
