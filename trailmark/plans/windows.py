"""Event-time windows over the events table."""

from __future__ import annotations

from ..streaming import windows
from .registry import load, query


@query("""
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total
FROM events GROUP BY ALL
""")
def tumbling_window(spark, sf_dir):
    return windows.tumbling(load(spark, sf_dir, "events"))


@query("""
SELECT (time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS)::TIMESTAMP AS window_start, event_type, count(*) AS n,
  sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL
""")
def sliding_window(spark, sf_dir):
    return windows.sliding(load(spark, sf_dir, "events"))


@query("""
WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM numbered GROUP BY user_id, s
""")
def session_window(spark, sf_dir):
    return windows.sessions(load(spark, sf_dir, "events"))


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def dedup_stream(spark, sf_dir):
    """Each event once by what it says."""
    return windows.deduplicated(load(spark, sf_dir, "events"), ["user_id", "event_type", "props"]).select("user_id", "event_type", "props")
