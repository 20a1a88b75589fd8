"""Filtered scans; all predicates reach the Parquet or JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single(df: DataFrame, symbol: str, start, end, key: str = "date") -> DataFrame:
    """One symbol, both ends excluded."""
    return df.where((F.col("act_symbol") == symbol) & (F.col(key) > F.lit(start).cast("date")) & (F.col(key) < F.lit(end).cast("date")))


def batch(df: DataFrame, symbols: list[str], start, end) -> DataFrame:
    """Several symbols, the end excluded."""
    return df.where(F.col("act_symbol").isin(symbols) & (F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))


def statements(df: DataFrame, symbol: str, start, end, period: str = "Quarter") -> DataFrame:
    """One symbol's statements of a period, both ends excluded; other periods raise."""
    if period not in ("Quarter", "Year"):
        raise ValueError(f"unknown period: {period}")
    return single(df, symbol, start, end).where(F.col("period") == period)


def etfs(symbols: DataFrame) -> DataFrame:
    return symbols.where("is_etf = '1'").select("act_symbol")


def info(symbols: DataFrame, symbol: str) -> DataFrame:
    return symbols.where(F.col("act_symbol") == symbol)


def without(df: DataFrame, unwanted: DataFrame) -> DataFrame:
    return df.join(unwanted.select("act_symbol"), "act_symbol", "left_anti")


def last_year(df: DataFrame, symbols: DataFrame, year: int, month: int) -> DataFrame:
    """Bars from a year before a month's first day up to it, both included, without ETFs."""
    end = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return without(df.where(F.col("date").between(F.add_months(end, -12), end)), etfs(symbols))


def latest(ticks: DataFrame, span: str = "1 minute") -> DataFrame:
    """The open of each ticker's latest bar of ``span``."""
    bars = ticks.groupBy("ticker", F.window("ts", span)["start"].alias("start")).agg(F.min_by("price", F.struct("ts", "seq")).alias("open"))
    return bars.groupBy("ticker").agg(F.max_by("open", "start").alias("open"), F.max("start").alias("start"))
