"""Comparison of assets and mixes; an asset is a table ``(date, open, high, low, close, ...)``, a portfolio has a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def by_day():
    """The order of one asset's rows, a few thousand dates."""
    return W.orderBy("date")


def by_member():
    return W.partitionBy("act_symbol").orderBy("date")


def chop(df: DataFrame, start, end) -> DataFrame:
    """Both ends included."""
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def cumulative(df: DataFrame, column: str = "log_ret", name: str = "cum_ret") -> DataFrame:
    """A running sum by member."""
    return df.withColumn(name, F.sum(column).over(by_member().rowsBetween(W.unboundedPreceding, 0)))


def on_common_dates(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.join(b.select("date"), "date", "left_semi"), b.join(a.select("date"), "date", "left_semi")


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crop each to the other's first and last date; raise if the dates then differ."""
    ends = [df.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n")).first() for df in (a, b)]
    if ends[0]["n"] != ends[1]["n"]:
        a, b = (df.where(F.col("date").between(other["lo"], other["hi"])) for df, other in ((a, ends[1]), (b, ends[0])))
    odd = a.select("date").exceptAll(b.select("date")).unionByName(b.select("date").exceptAll(a.select("date")))
    if odd.limit(1).count():
        raise ValueError("the dates differ")
    return a, b


def compared(stock: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(date, log_ret_self, log_ret_stock, diff)`` on common dates, returns taken anew between these."""
    a, b = on_common_dates(stock, baseline)
    r = F.ln(F.col("close") / F.lag("close").over(by_day()))
    a, b = a.select("date", r.alias("log_ret_self")), b.select("date", r.alias("log_ret_stock"))
    return a.join(b, "date").withColumn("diff", F.col("log_ret_self") - F.col("log_ret_stock"))


def mix(portfolio: DataFrame, members: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """The members' columns added up by date, on the dates that all have; ``weights`` scales them, without it none does.

    ``log_ret`` is the summed close's own.
    """
    p = portfolio.where(F.col("act_symbol").isin(members))
    scale = F.lit(1.0)
    for m, x in (weights or {}).items():
        scale = F.when(F.col("act_symbol") == m, x).otherwise(scale)
    cols = [c for c in ("open", "high", "low", "close", "volume") if c in p.columns]
    g = p.groupBy("date").agg(F.countDistinct("act_symbol").alias("_n"), *[F.sum(F.col(c) * scale).alias(c) for c in cols])
    g = g.where(F.col("_n") == len(set(members))).drop("_n")
    return g.withColumn("log_ret", F.ln(F.col("close") / F.lag("close").over(by_day())))


def against_mix(stock: DataFrame, mixed: DataFrame) -> DataFrame:
    """``(date, relative)``: the running sum of the stock's return less the mix's."""
    j = stock.select("date", F.col("log_ret").alias("s")).join(mixed.select("date", F.col("log_ret").alias("m")), "date")
    return j.select("date", F.sum(F.col("s") - F.col("m")).over(by_day().rowsBetween(W.unboundedPreceding, 0)).alias("relative"))


def against_mean(portfolio: DataFrame, members: list[str], stock: str) -> DataFrame:
    """A member against the equal mix of all of them."""
    own = portfolio.where(F.col("act_symbol") == stock).select("date", F.ln(F.col("close") / F.lag("close").over(by_day())).alias("log_ret"))
    return against_mix(own, mix(portfolio, members))


def percent_change(column: str = "close") -> F.Column:
    return F.try_divide(F.col(column), F.lag(column).over(by_member())) - 1
