"""The open of each ticker's latest minute from a stream of ticks, as keyed state that expires."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What the stream's session must set: state with timers is kept by this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LatestOpen(StatefulProcessor):
    """Per ticker the latest span so far and the first tick in it; both only move one way, so order and repeats don't matter."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "start long, us long, seq long, price double")

    def handleInputRows(self, key, rows, timerValues):
        best = self.state.get() if self.state.exists() else None
        before = best
        for pdf in rows:
            last = pdf[pdf["start"] == pdf["start"].max()].sort_values(["us", "seq", "price"], kind="stable").iloc[0]
            mine = (int(last["start"]), int(last["us"]), int(last["seq"]), float(last["price"]))
            # A later span wins; within one the earlier tick.
            if best is None or mine[0] > best[0] or (mine[0] == best[0] and mine[1:] < tuple(best)[1:]):
                best = mine
        if best is not before:
            self.state.update(tuple(best))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(best[0] // 1000 + self.keep_ms)
            yield pd.DataFrame({"ticker": [key[0]], "open": [best[3]], "start": [best[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame({"ticker": pd.Series([], dtype=str), "open": pd.Series([], dtype=float), "start": pd.Series([], dtype="int64")})


def latest(ticks: DataFrame, span: str = "1 minute", late: str = "10 minutes", keep_ms: int = 86_400_000) -> DataFrame:
    """Updates ``(ticker, open, start)`` of a stream ``(ticker, ts, seq, price)``: a row whenever a ticker's latest changes.

    The last row of a ticker is what :func:`tidepanel.sources.scans.latest` gives over all ticks, in whatever order they
    came and however often.  Ticks later than ``late`` are dropped; a ticker without ticks for ``keep_ms`` of event time is
    forgotten.  Ticks without a ticker, time, number or price don't count.  The session must set :data:`STORE`.
    """
    x = ticks.na.drop(subset=["ticker", "ts", "seq", "price"]).withWatermark("ts", late)
    x = x.select("ticker", "ts", F.unix_micros("ts").alias("us"), F.unix_micros(F.window("ts", span)["start"]).alias("start"), F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"))
    out = x.groupBy("ticker").transformWithStateInPandas(LatestOpen(keep_ms), "ticker string, open double, start long", "Update", "EventTime")
    return out.withColumn("start", F.timestamp_micros("start"))
