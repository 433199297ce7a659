"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; SQL that starts with a comment stands without the events."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if sql.startswith("--") else EVENTS_CTE + sql
        return f

    return put


#: The events with integer times and derived positions, as :func:`driftline.sources.tables.events` has them.
EVENTS_CTE = """WITH ev AS (
  SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t_us,
         12.9::DOUBLE + ((user_id * 37 + event_id * 13) % 1000) / 10000::DOUBLE AS lat,
         77.5::DOUBLE + ((user_id * 53 + event_id * 7) % 1000) / 10000::DOUBLE AS lon,
         ((event_id * 29) % 360)::DOUBLE AS bearing
  FROM events)
"""


def load() -> None:
    """Import every module of queries."""
    from . import audits, calibration, diagnostics, filters, inertial, joins, matching, models, mounts, profiles, streams, tracks, windows  # noqa: F401
