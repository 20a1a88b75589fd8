"""Split adjustment: a fold over the splits of one gap between bars, then a running factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.operators.asof import asof

MARGIN = 0.25


def ratio(splits: DataFrame) -> F.Column:
    r = F.try_divide(F.col("to_factor").cast("double"), F.col("for_factor").cast("double"))
    return F.coalesce(r, F.col("ratio").cast("double")) if "ratio" in splits.columns else r


def accepted(bars: DataFrame, splits: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``(act_symbol, ex_date, ratio)`` of the splits that the prices bear out.

    A split counts if the drop from the last bar before it to the first on or after it, less the splits already
    counted in that gap, is within ``margin`` of its ratio; without bars on both sides it counts unseen.  Ratios of 0
    or less and of 1 are left out.
    """
    w = W.partitionBy("act_symbol").orderBy("date")
    drops = bars.select("act_symbol", "date", F.lag("close").over(w).alias("prev"), "close")
    s = splits.select("act_symbol", "ex_date", ratio(splits).alias("ratio")).where("ratio > 0 and ratio != 1")
    s = asof(s, drops, "ex_date", "date", forward=True, payload={"date": "bar", "prev": "prev", "close": "close"})
    gap = s.groupBy("act_symbol", "bar").agg(
        F.array_sort(F.collect_list(F.struct("ex_date", "ratio"))).alias("splits"),
        F.first(F.try_divide("prev", "close")).alias("drop"),
    )
    start = F.struct(F.lit(1.0).alias("applied"), F.array().cast("array<struct<ex_date:date,ratio:double>>").alias("taken"))

    def step(a, x):
        seen = F.abs(F.try_divide(F.col("drop"), a["applied"]) - x["ratio"]) / x["ratio"] <= margin
        take = F.col("drop").isNull() | seen
        return F.when(take, F.struct((a["applied"] * x["ratio"]).alias("applied"), F.concat(a["taken"], F.array(x)).alias("taken"))).otherwise(a)

    return gap.select("act_symbol", F.explode(F.aggregate("splits", start, step)["taken"]).alias("s")).select("act_symbol", "s.ex_date", "s.ratio")


def adjust(bars: DataFrame, splits: DataFrame, margin: float = MARGIN, tasks: int | None = None) -> DataFrame:
    """Prices before a split divided by its ratio, volumes multiplied, for all symbols at once; bars that lie by symbol in
    so many ``tasks`` stay there."""
    a = accepted(bars, splits, margin).groupBy("act_symbol", "ex_date").agg(F.product("ratio").alias("r"))
    w = W.partitionBy("act_symbol").orderBy(F.col("ex_date").desc())
    # The product of all ratios at or after each split applies to the bars before it.
    a = a.select("act_symbol", "ex_date", F.product("r").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("factor"), F.date_sub("ex_date", 1).alias("until"))
    out = asof(bars, a, "date", "until", forward=True, payload={"factor": "_f"}, tasks=tasks).withColumn("_f", F.coalesce("_f", F.lit(1.0)))
    prices = [c for c in ("open", "high", "low", "close", "prev_close") if c in bars.columns]
    return out.withColumns({c: F.col(c) / F.col("_f") for c in prices} | {"volume": F.col("volume") * F.col("_f")}).drop("_f")
