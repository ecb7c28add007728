"""Keyed monitors whose state ends: typed state with a time to live, timers, and the RocksDB store.

Timers of processing time fire in batches of their own, so a query of these goes on until it is stopped; start it with a processing-time trigger
(``monitors.run_each``), not with ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that typed state, timers and times to live need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB: beyond an executor's heap, with change logs in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class PositionMonitor(StatefulProcessor):
    """The running peak of each open position. A trailing exit, a close by the account and a time without prices end it, and its state goes.

    Rows have ``event_type`` and ``price``; a row of the closing type ends the position, another with a price opens or marks it. A position of which nothing is heard for
    ``idle_ms`` is reported as ``expired`` by a timer of processing time, which each new price puts off.
    """

    def __init__(self, fall: float, closing: str, idle_ms: int):
        self.fall, self.closing, self.idle_ms = fall, closing, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "peak double, seen long")
        # a second line of defence: a state whose timer is lost with the query's code still goes
        self.due = handle.getValueState("due", "at long", ttlDurationMs=10 * self.idle_ms)

    def _end(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.open.clear()
        self.due.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        peak, seen = self.open.get() if self.open.exists() else (None, 0)
        out, last = [], None
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for kind, price in zip(frame.event_type, frame.price, strict=True):
            if kind == self.closing:
                if seen:
                    out.append((key[0], "closed", peak, seen))
                peak, seen = None, 0
            elif price == price and price is not None:
                peak, seen, last = price if peak is None else max(peak, price), seen + 1, price
                if price <= peak * (1 - self.fall):
                    out.append((key[0], "trailing", peak, seen))
                    peak, seen = None, 0
        if not seen:
            self._end()
        elif last is not None:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.due.update((at,))
            self.open.update((float(peak), int(seen)))
            out.append((key[0], "open", float(peak), int(seen)))
        yield pd.DataFrame(out, columns=["code", "status", "peak", "seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = []
        if self.open.exists():
            peak, seen = self.open.get()
            rows.append((key[0], "expired", float(peak), int(seen)))
        self.open.clear()
        self.due.clear()
        yield pd.DataFrame(rows, columns=["code", "status", "peak", "seen"])

    def close(self) -> None:
        pass


def position_monitor(ticks: DataFrame, fall: float = 0.04, closing: str = "error", idle_ms: int = 86_400_000) -> DataFrame:
    """``code``, ``status`` (open, trailing, closed, expired), ``peak``, ``seen`` of each position as its ticks arrive (ST-1, ST-4)."""
    return ticks.groupBy("code").transformWithStateInPandas(PositionMonitor(fall, closing, idle_ms), "code long, status string, peak double, seen long", "Update", "ProcessingTime")


class PendingReviews(StatefulProcessor):
    """Ids of a code that no review has had: a list that is emptied each time it reaches ``threshold``; old ids go by themselves after ``ttl_ms``."""

    def __init__(self, threshold: int, ttl_ms: int):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getListState("ids", "id long", ttlDurationMs=self.ttl_ms)
        self.mark = handle.getValueState("mark", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else -1
        new = sorted(int(i) for frame in rows for i in frame.event_id)
        pending = [i for (i,) in self.ids.get()] + [i for i in new if i > mark]
        out = []
        while len(pending) >= self.threshold:
            batch, pending = pending[: self.threshold], pending[self.threshold :]
            mark = max(mark, *batch)
            out.append((key[0], batch[0], batch[-1], len(batch)))
        if pending:
            self.ids.put([(i,) for i in pending])
        else:
            self.ids.clear()
        if out:
            self.mark.update((mark,))
        yield pd.DataFrame(out, columns=["code", "first_id", "last_id", "n"])

    def close(self) -> None:
        pass


def pending_reviews(ticks: DataFrame, threshold: int = 20, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """A row each time ``threshold`` ids after a code's mark are pending: ``first_id``, ``last_id``, ``n``; the mark moves on, so no id is reviewed twice (ST-3).

    Ids of a code arrive in order of their files; one at or below the mark has been reviewed and is left out.
    """
    return ticks.groupBy("code").transformWithStateInPandas(PendingReviews(threshold, ttl_ms), "code long, first_id long, last_id long, n long", "Append", "ProcessingTime")


class SlotOnce(StatefulProcessor):
    """The slots of a code that were reported: a map whose entries go after ``ttl_ms``, so the state follows the slots that can still come."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "slot timestamp", "id long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        frame = pd.concat(list(rows)).sort_values(["slot", "ts", "event_id"]).drop_duplicates("slot")
        for slot, event_id in zip(frame.slot, frame.event_id, strict=True):
            if not self.done.containsKey((slot,)):
                self.done.updateValue((slot,), (int(event_id),))
                out.append((key[0], slot, int(event_id)))
        yield pd.DataFrame(out, columns=["code", "slot", "event_id"])

    def close(self) -> None:
        pass


def reported_slots(ticks: DataFrame, slot: str = "1 day", ttl_ms: int = 2 * 86_400_000) -> DataFrame:
    """The first event of each code and slot (ST-5); a slot counts as reported for ``ttl_ms`` after its report."""
    placed = ticks.withColumn("slot", F.window("ts", slot)["start"])
    return placed.groupBy("code").transformWithStateInPandas(SlotOnce(ttl_ms), "code long, slot timestamp, event_id long", "Append", "ProcessingTime")
