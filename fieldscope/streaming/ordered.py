"""Threshold events of streams whose rows arrive late and out of order.

Rows wait in state until the watermark has passed them, are put in order then, and go through the hysteresis of the batch operator; a timer of
event time wakes each series. Rows later than the watermark allows are left out, as Spark counts them. A series holds the rows of the time
that they may be late by, and one open event; both survive a restart from the query's checkpoint.

The session needs a state store that keeps several states a key: rocks(spark) sets Spark's own for it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocks(spark: SparkSession) -> None:
    spark.conf.set(*STORE)


class Hysteresis(StatefulProcessor):
    """Events that begin below `enter` and end at `leave` or above, of rows (us, seq, value) by series."""

    def __init__(self, key: str, enter: float, leave: float):
        self.key, self.enter, self.leave = key, enter, leave

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, seq long, value double")
        self.event = handle.getValueState("event", "begin long, lowest double, n long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        new = []
        for pdf in rows:
            new += zip(*(pdf[c].tolist() for c in ("us", "seq", "value")), strict=True)
        self.waiting.appendList(new)
        self._wake(min(us for us, _, _ in new), timerValues)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        ready, rest = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        state = self.event.get() if self.event.exists() else None
        begin, lowest, n = (state[0], state[1], state[2]) if state is not None else (None, None, 0)
        out = []
        for us, _, value in ready:
            if value is None or value != value or value in (float("inf"), float("-inf")):
                continue
            if begin is None:
                if value < self.enter:
                    begin, lowest, n = us, value, n + 1
            elif value >= self.leave:
                out.append((key[0], n, begin, us, lowest))
                begin = lowest = None
            else:
                lowest = min(lowest, value)
        self.event.update((begin, lowest, n))
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self._wake(rest[0][0], timerValues)
        yield self._frame(out)

    def _wake(self, us: int, timerValues) -> None:
        """At the first whole millisecond that has passed the row's time."""
        self.handle.registerTimer(max(-(-us // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def _frame(self, rows: list):
        import pandas as pd

        return pd.DataFrame(rows, columns=[self.key, "event", "begin_us", "end_us", "lowest"]).astype({"event": "int64", "begin_us": "int64", "end_us": "int64", "lowest": "float64"})

    def close(self) -> None:
        pass


def hysteresis(stream: DataFrame, key: str, enter: float, leave: float, late: str = "10 seconds") -> DataFrame:
    """key, event (its number), begin, end (timestamps), lowest of the closed events of a stream (key, time: timestamp, seq, value).

    As hysteresis of the batch operators gives them, whatever the order of arrival within `late`.
    """
    rows = stream.withWatermark("time", late).select(key, "time", F.unix_micros("time").alias("us"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))
    kind = stream.schema[key].dataType.simpleString()
    found = rows.groupBy(key).transformWithStateInPandas(Hysteresis(key, enter, leave), f"{key} {kind}, event long, begin_us long, end_us long, lowest double", "Append", "EventTime")
    return found.select(key, "event", F.timestamp_micros("begin_us").alias("begin"), F.timestamp_micros("end_us").alias("end"), "lowest")
