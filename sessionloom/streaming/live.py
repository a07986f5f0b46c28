"""Structured Streaming forms of the analytics: live counts, sessions closed by inactivity, live usage dedup."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Rows with a watermark; a stream's event time has to be a timestamp with a time zone (the session's)."""
    return (rows.withColumn(ts, F.col(ts).cast("timestamp")) if rows.isStreaming else rows).withWatermark(ts, late)


def window_counts(rows: DataFrame, ts: str, keys: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows per key and tumbling (or, with slide, sliding) window; rows later than `late` are left out."""
    spans = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = _timed(rows, ts, late).groupBy(spans.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("w_start"), *keys, "n")


def closed_sessions(rows: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Runs of rows of a key without a pause of `gap`. A stream gives each out once it is closed for good."""
    runs = _timed(rows, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return runs.select(*keys, F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n")


def usage_once(rows: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first usage report of each message; the state is bounded by the watermark."""
    return _timed(rows, ts, late).dropDuplicatesWithinWatermark(keys)


def land(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet table, all that is there now; started again, it goes on where it ended."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_best(rows: DataFrame, ts: str, keys: list[str], message: str, order: list[str], value: str, late: str) -> DataFrame:
    """The usage report that counts of each step: the last message's, or the last chunk's where no message has one."""
    best = F.max_by(value, F.struct(F.col(message).cast("int"), *order))
    return _timed(rows, ts, late).groupBy(*keys).agg(best.alias(value))


def live_retries(rows: DataFrame, idle: str, late: str = "10 minutes") -> DataFrame:
    """(session, event_id, retry) of calls, as in the batch: polling, unchanged, after_state_change or none.

    rows: session, ts, event_id, is_call, print (of the call, or of the call that a result answers), mode, polls, failed, changed.
    Rows of a batch are taken in order of ts and event_id. A session's state is its epoch and what is known of each
    fingerprint; it goes when the session has been idle for that long by event time.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        epoch, known = json.loads(state.get[0]) if state.exists else (0, {})
        part = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for r in part.itertuples():
            seen, failed_at, failed_mode = known.get(r.print, (0, None, None))
            if r.is_call:
                if r.polls and seen:
                    retry = "polling"
                elif failed_at is None:
                    retry = "none"
                else:
                    retry = "after_state_change" if epoch > failed_at or r.mode != failed_mode else "unchanged"
                out.append((key[0], r.event_id, retry))
                seen += 1
            if r.failed:
                failed_at, failed_mode = epoch, r.mode
            known[r.print] = (seen, failed_at, failed_mode)
            epoch += bool(r.changed)
        state.update((json.dumps((epoch, known)),))
        last = max(int(part["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(last + idle_ms)
        yield pd.DataFrame(out, columns=["session", "event_id", "retry"])

    return _timed(rows, "ts", late).groupBy("session").applyInPandasWithState(
        step, "session string, event_id long, retry string", "known string", "append", GroupStateTimeout.EventTimeTimeout
    )
