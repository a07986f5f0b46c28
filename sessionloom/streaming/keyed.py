"""Live retries on keyed state: the state of a session is its epoch and a map by fingerprint, of which a batch reads and writes only its own entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sessionloom.streaming.live import _timed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Sets the store that keyed state needs: entries lie on disk, so a session's map may outgrow memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Retries(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.epoch = handle.getValueState("epoch", "epoch long")
        self.known = handle.getMapState("known", "print string", "seen long, failed_at long, failed_mode string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").reset_index(drop=True)
        part["print"] = part["print"].fillna("")
        epoch = self.epoch.get()[0] if self.epoch.exists() else 0
        part["epoch"] = epoch + part["changed"].cumsum() - part["changed"]
        old = {p: self.known.getValue((p,)) if self.known.containsKey((p,)) else (0, None, None) for p in part["print"].unique()}
        by = part.groupby("print", sort=False)
        part["seen"] = by["is_call"].cumsum() - part["is_call"] + part["print"].map(lambda p: old[p][0])
        for name, value in (("failed_at", part["epoch"].astype("float64")), ("failed_mode", part["mode"])):
            at = value.where(part["failed"])
            carried = at.groupby(part["print"], sort=False).ffill()
            before = carried.groupby(part["print"], sort=False).shift()
            part[name] = before.where(before.notna(), part["print"].map(lambda p, i=1 + (name == "failed_mode"): old[p][i]))
            part[f"now_{name}"] = carried.where(carried.notna(), part["print"].map(lambda p, i=1 + (name == "failed_mode"): old[p][i]))
        last = part.groupby("print", sort=False).tail(1)
        for p, seen, call, at, mode in zip(last["print"], last["seen"], last["is_call"], last["now_failed_at"], last["now_failed_mode"]):
            failed = pd.notna(at)
            self.known.updateValue((p,), (int(seen) + int(call), int(at) if failed else None, mode if failed else None))
        self.epoch.update((int(epoch + part["changed"].sum()),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        newest = max(int(part["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(newest + self.idle_ms)
        calls = part[part["is_call"]]
        told = pd.Series("unchanged", index=calls.index)
        told[(calls["epoch"] > calls["failed_at"].astype("float64")) | (calls["mode"] != calls["failed_mode"])] = "after_state_change"
        told[calls["failed_at"].isna()] = "none"
        told[calls["polls"].astype(bool) & (calls["seen"] > 0)] = "polling"
        yield pd.DataFrame({"session": key[0], "event_id": calls["event_id"], "retry": told})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.epoch.clear()
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_retries(rows: DataFrame, idle: str, late: str = "10 minutes") -> DataFrame:
    """As `live.live_retries`, with the same rows and results: (session, event_id, retry) of calls.

    A session without rows for `idle` of event time is forgotten. Rows without a fingerprint share one. The session needs `use_keyed_state`.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return _timed(rows, "ts", late).groupBy("session").transformWithStateInPandas(
        statefulProcessor=Retries(idle_ms), outputStructType="session string, event_id long, retry string", outputMode="Append", timeMode="EventTime"
    )
