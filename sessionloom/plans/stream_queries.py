"""Batch forms of the streaming analytics over events; the streams give the same rows."""

from __future__ import annotations

from sessionloom.plans.registry import query, table
from sessionloom.streaming import live


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS w_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def live_window_counts(spark, d):
    return live.window_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "10 minutes")


@query("""
    SELECT user_id, min(ts) AS w_start, max(ts) + INTERVAL '30 minutes' AS w_end, count(*) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh
            FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, g
""")
def live_session_windows(spark, d):
    return live.closed_sessions(table(spark, d, "events"), "ts", ["user_id"], "30 minutes", "10 minutes")
