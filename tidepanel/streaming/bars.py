"""Minute bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_bars(ticks: DataFrame, span: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count by ticker and window of ``(ticker, ts, seq, price)``; ticks later than ``late`` are dropped.

    Works on streams and tables alike.
    """
    at = F.struct("ts", "seq")
    g = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", span))
    return g.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n")).select(
        "ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "n"
    )
