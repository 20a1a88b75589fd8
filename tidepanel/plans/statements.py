"""Fundamentals pipelines: variables, release dates, and their place on the bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.functions import fundamentals as V
from tidepanel.functions import windows as R
from tidepanel.operators.asof import asof
from tidepanel.operators.splits import adjust


def variables(statements: DataFrame) -> DataFrame:
    """The seven variables by (symbol, period end, period)."""
    return statements.select("act_symbol", "date", "period", *[f().alias(n) for n, f in V.VARIABLES.items()])


def joined(income: DataFrame, assets: DataFrame, liabilities: DataFrame) -> DataFrame:
    """Three statement tables on their key; columns that clash get the suffixes _ast and _liab."""
    key = ["act_symbol", "date", "period"]

    def suffixed(df, have, suffix):
        return df.select(*key, *[F.col(c).alias(c + suffix if c in have else c) for c in df.columns if c not in key])

    a = suffixed(assets, set(income.columns), "_ast")
    l = suffixed(liabilities, {*income.columns, *a.columns}, "_liab")
    return income.join(a, key).join(l, key)


def with_release(statements: DataFrame, calendar: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Add ``release_date``: the first public release at or after the period end."""
    out = asof(statements, calendar, "date", "date", forward=True, payload={"date": "release_date"})
    return out if keep_unmatched else out.where("release_date is not null")


def shifted_release(statements: DataFrame, calendar: DataFrame) -> DataFrame:
    """The older attachment by place: the k-th statement gets the (k-1)-th release of its symbol."""
    w = W.partitionBy("act_symbol").orderBy("date")
    s = statements.withColumn("_k", F.row_number().over(w))
    c = calendar.select("act_symbol", (F.row_number().over(w) + 1).alias("_k"), F.col("date").alias("release_date"))
    return s.join(c, ["act_symbol", "_k"], "left").drop("_k")


def on_bars(bars: DataFrame, released: DataFrame, columns: list[str], missing: int | None = None, tasks: int | None = None) -> DataFrame:
    """Each bar with the latest release at or before it, and the days since (``missing`` where there is none).

    Here and below, bars that lie by symbol in so many ``tasks`` stay there."""
    payload = {"release_date": "release_date", **{c: c for c in columns}}
    out = asof(bars, released.select("act_symbol", "release_date", *columns), "date", "release_date", payload=payload, tasks=tasks)
    days = F.datediff("date", "release_date")
    return out.withColumn("days_since_release", days if missing is None else F.coalesce(days, F.lit(missing)))


def price_variables(bars: DataFrame) -> DataFrame:
    """``prev_close, log_ret, prev_ret``, 5 and 20 day sums of returns, 20 day volatility; by symbol."""
    b = bars.withColumn("prev_close", R.lag(F.col("close")))
    b = b.withColumn("log_ret", F.ln(F.try_divide("close", "prev_close")))
    r = F.col("log_ret")
    return b.withColumns({"prev_ret": R.lag(r), "ret_5d": R.total(r, 5), "ret_20d": R.total(r, 20), "vol_20d": R.deviation(r, 20)})


def all_data(bars: DataFrame, splits: DataFrame, statements: DataFrame, calendar: DataFrame, stock_splits: bool = True, tasks: int | None = None) -> DataFrame:
    """Variables, bars adjusted for splits with their price variables, and the variables on the bars."""
    b = price_variables(adjust(bars, splits, tasks=tasks) if stock_splits else bars)
    return on_bars(b, with_release(variables(statements), calendar), list(V.VARIABLES), tasks=tasks)


def batch(bars: DataFrame, etfs: DataFrame, statements: DataFrame, calendar: DataFrame, tasks: int | None = None) -> DataFrame:
    """Bars without ETFs, with ROIC and operating margin as released and the days since, -1 before the first."""
    s = statements.select("act_symbol", "date", V.roic().alias("ROIC"), V.operating_margin().alias("operating_margin"))
    b = bars.join(etfs.select("act_symbol"), "act_symbol", "left_anti")
    return on_bars(b, with_release(s, calendar), ["ROIC", "operating_margin"], missing=-1, tasks=tasks)
