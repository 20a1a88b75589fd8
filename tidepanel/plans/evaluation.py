"""Chronological splits and the evaluation of predictions ``(act_symbol, date, pred, target)``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators.selection import cuts_of, ranged


def by_day():
    """The order of dates, over one row each."""
    return W.orderBy("date")


def split_dates(df: DataFrame, cutoffs=(0.7, 0.85, 1.0)) -> DataFrame:
    """Add ``part``: train before the first cut, val before the second, test before the last; the last date has none."""
    days = df.select("date").distinct().withColumn("i", F.row_number().over(by_day()) - 1)
    n = days.agg(F.count("*").alias("n"))
    cut = [F.floor(F.col("n") * F.lit(c) + 1e-9) for c in cutoffs]
    part = F.when(F.col("i") < cut[0], "train").when(F.col("i") < cut[1], "val").when(F.col("i") < cut[2] - 1, "test")
    days = days.join(F.broadcast(n)).select("date", part.alias("part"))
    return df.join(days, "date")


def features_of(columns: list[str]) -> tuple[list[str], list[str]]:
    """Feature and target columns by the tokens F and T of their names."""
    return [c for c in columns if "F" in c.split("_")], [c for c in columns if "T" in c.split("_")]


def horizon(target: str, alias: str | None = None) -> int:
    """The days that a target looks ahead, from its name, else its alias, else 1."""
    for name in (target, alias or ""):
        if m := re.search(r"(\d+)d", name):
            return int(m[1])
    return 1


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


#: Rows of a range of values, which one task puts in order.
RANGE_ROWS = 1_000_000


def with_rows_before(df: DataFrame, value: str, n: str, name: str = "before", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the sum of ``n`` over all rows with a smaller ``value``, without one task that sees all rows.

    Approximate quantiles cut the values into ranges of about ``range_rows`` rows, however many there are; each is summed,
    and the running sum is taken over the ranges and inside each.  Where the cuts lie does not change the result.
    Counting the rows, and the cuts where one range is not enough, are jobs of their own.
    """
    x = ranged(df, value, cuts_of(df, value, -(-df.count() // range_rows) - 1), "_range")
    sums = x.groupBy("_range").agg(F.sum(n).alias("_n"))
    sums = sums.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.sum(n).over(W.partitionBy("_range").orderBy(value).rangeBetween(W.unboundedPreceding, 0)) - F.sum(n).over(W.partitionBy("_range", value))
    return x.withColumn(name, inside).join(F.broadcast(sums), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def metrics(df: DataFrame) -> DataFrame:
    """RMSE, directional accuracy, accuracy at 0.5 and ROC-AUC (by average ranks) of ``pred`` against ``target``."""
    p, t = F.col("pred"), F.col("target")
    positive = t > 0
    # Average ranks from counts by value: rows of one value are summed before any order is taken.
    by_value = df.groupBy("pred").agg(F.count("*").alias("n"), F.sum(positive.cast("long")).alias("pos"))
    ranked = with_rows_before(by_value, "pred", "n")
    auc = ranked.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    auc = auc.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * neg).alias("roc_auc"))
    m = df.agg(
        F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"), F.avg((F.signum(p) == F.signum(t)).cast("double")).alias("directional_accuracy"),
        F.avg(((p > 0.5) == positive).cast("double")).alias("accuracy"),
    )
    return m.join(auc)


def _average_rank(name: str):
    at = F.rank().over(W.partitionBy("date").orderBy(name))
    return at + (F.count("*").over(W.partitionBy("date", name)) - 1) / 2


def daily_ic(df: DataFrame) -> DataFrame:
    """``(date, ic)``: the rank correlation of predictions and targets by date, where it is defined."""
    r = df.where("pred is not null and target is not null").select("date", _average_rank("pred").alias("a"), _average_rank("target").alias("b"))
    g = r.groupBy("date").agg(F.count("*").alias("n"), F.covar_samp("a", "b").alias("c"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"))
    return g.where("n > 1 and va > 0 and vb > 0").select("date", (F.col("c") / F.sqrt(F.col("va") * F.col("vb"))).alias("ic"))


def robust_ic(df: DataFrame, days: int = 1) -> DataFrame:
    """Mean, deviation, information ratio, its yearly figure and the t value with overlap taken into account."""
    g = daily_ic(df).agg(F.count("*").alias("n_days"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"))
    ir = F.try_divide("mean_ic", "std_ic")
    ok = F.col("n_days") >= 2
    return g.select(
        "n_days", F.when(ok, F.col("mean_ic")).alias("mean_ic"), F.when(ok, F.col("std_ic")).alias("std_ic"), F.when(ok, ir).alias("ir"),
        F.when(ok, ir * (252 / days) ** 0.5).alias("ir_annual"), F.when(ok, ir * F.sqrt(F.col("n_days") / days)).alias("t_stat"),
    )


def binned(df: DataFrame, quantiles: int = 10) -> DataFrame:
    """Add ``bin``: 1 to ``quantiles`` by the rank of the prediction within the date; null on dates with one row."""
    d = W.partitionBy("date")
    r = F.row_number().over(d.orderBy("pred", "act_symbol"))
    x = df.where("pred is not null and target is not null").withColumns({"_r": r, "_n": F.count("*").over(d)})
    return x.withColumn("bin", F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.expr(f"((_r - 1) * {quantiles} + _n - 2) div greatest(_n - 1, 1)")))).drop("_r", "_n")


def quantile_returns(df: DataFrame, quantiles: int = 10) -> DataFrame:
    """Mean target by date and bin, a column each, on dates that have all bins."""
    bins = list(range(1, quantiles + 1))
    g = binned(df, quantiles).where("bin is not null").groupBy("date").pivot("bin", bins).agg(F.avg("target"))
    return g.select("date", *[F.col(str(b)).alias(f"q{b}") for b in bins]).na.drop()


def quantile_spread(df: DataFrame, quantiles: int = 10, days: int = 1) -> DataFrame:
    """Mean spread of top and bottom bins, win rate and yearly Sharpe ratio."""
    s = quantile_returns(df, quantiles).select((F.col(f"q{quantiles}") - F.col("q1")).alias("s"))
    return s.agg(
        F.count("*").alias("n_days"), F.avg("s").alias("mean_spread"), F.avg((F.col("s") > 0).cast("double")).alias("win_rate"),
        (F.try_divide(F.avg("s"), F.stddev_samp("s")) * (252 / days) ** 0.5).alias("sharpe"),
    )


def cumulative_spread(df: DataFrame, quantiles: int = 10) -> DataFrame:
    """``(date, spread, cumulative)``: the series that a plot would show."""
    s = quantile_returns(df, quantiles).select("date", (F.col(f"q{quantiles}") - F.col("q1")).alias("spread"))
    return s.withColumn("cumulative", F.sum("spread").over(by_day().rowsBetween(W.unboundedPreceding, 0)))
