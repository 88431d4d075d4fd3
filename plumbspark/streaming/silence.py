"""Alerts for entities that fall silent, also when nothing comes at all any more: state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbspark.functions.columns import quoted

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Silence(StatefulProcessor):
    """An entity's last event and number of events, and one timer that every batch with its events puts off."""

    def __init__(self, wait_ms: int, ttl_ms: int):
        self._wait, self._ttl = wait_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "last timestamp, events long", self._ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, events = self._seen.get() if self._seen.exists() else (None, 0)
        for part in rows:
            newest = part["newest"].max()
            events += int(part["n"].sum())
            if not pd.isna(newest):
                last = newest if last is None else max(pd.Timestamp(last), newest)
        self._seen.update((None if last is None else pd.Timestamp(last).to_pydatetime(), events))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._wait)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._seen.exists():
            last, events = self._seen.get()
            self._seen.clear()
            due = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame({"entity": [key[0]], "last_event": [pd.Timestamp(last)], "due_at": [due], "events": [events]})

    def close(self) -> None:
        pass


def silence_timers(stream: DataFrame, entity: str, ts: str, seconds: float, forget_seconds: float | None = None) -> DataFrame:
    """(entity, last_event, due_at, events): one row when nothing came from an entity for ``seconds`` of wall time.

    Unlike session windows, which close only when later events move the watermark, timers fire in a silent stream too.
    The alert clears the entity's state, so there is one for each silence, also after a restart from the checkpoint; state
    that no timer cleared is forgotten after ``forget_seconds`` (default: ten times the silence). Rows of a NULL
    entity are left out. Sums over a task's rows go before the shuffle, so a busy entity sends one row a task.

    The session needs the RocksDB state store (``STORE`` set to ``ROCKSDB``), which keeps state off the heap.
    """
    if ROCKSDB != stream.sparkSession.conf.get(STORE, ""):
        raise ValueError(f"set {STORE} to {ROCKSDB}")
    kind = stream.schema[entity].dataType.simpleString()
    rows = stream.where(F.col(quoted(entity)).isNotNull()).select(
        F.col(quoted(entity)).alias("entity"), F.col(quoted(ts)).cast("timestamp").alias("newest"), F.lit(1).cast("bigint").alias("n")
    )

    def gathered(batches):
        for b in batches:
            yield b.groupby("entity", as_index=False).agg({"newest": "max", "n": "sum"})

    fewer = rows.mapInPandas(gathered, f"entity {kind}, newest timestamp, n bigint")
    wait = int(seconds * 1000)
    ttl = int((10 * seconds if forget_seconds is None else forget_seconds) * 1000)
    return fewer.groupBy("entity").transformWithStateInPandas(
        statefulProcessor=_Silence(wait, max(ttl, 2 * wait)),
        outputStructType=f"entity {kind}, last_event timestamp, due_at timestamp, events bigint",
        outputMode="Append",
        timeMode="ProcessingTime",
    )
