"""Market relations derived from the TPC-H-like tables: bars, ETFs, splits, statements, calendar, market, ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol(key) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 6, "0"))


#: Trades that a task takes on average, at any size of the table.
TASK_TRADES = 100_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks trades are dealt to; the rows of a Parquet table are counted from its files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_TRADES))


def bars(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """Daily OHLCV: one row per supplier and shipping day; a trade's price is extended price / quantity.

    Trades are dealt once, by symbol, to tasks whose number follows from their count, and sorted by symbol and date: the
    windows by symbol over bars need no other exchange or sort.  Without ``whole`` a symbol's months are dealt apart.
    """
    lines = table(spark, sf_dir, "lineitem")
    trades = lines.select(
        symbol("l_suppkey").alias("act_symbol"), F.to_date("l_shipdate").alias("date"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("at"),
    )
    keys = ["act_symbol"] if whole else ["act_symbol", "month"]
    dealt = trades.withColumn("month", F.trunc("date", "month")) if not whole else trades
    dealt = dealt.repartition(tasks(spark, sf_dir), *keys).withColumns({"q": F.col("at.l_quantity"), "p": F.try_divide("at.l_extendedprice", "at.l_quantity")})
    return dealt.groupBy(*keys, "date").agg(
        F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "at").alias("close"), F.sum("q").alias("volume"),
    ).drop("month")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(act_symbol, is_etf)``; every tenth supplier is an ETF, flagged '1'."""
    s = table(spark, sf_dir, "supplier")
    return s.select(symbol("s_suppkey").alias("act_symbol"), F.when(F.col("s_suppkey") % 10 == 0, "1").otherwise("0").alias("is_etf"))


def market(panel: DataFrame) -> DataFrame:
    """The mean close of all symbols by date, with its log return: a reference series."""
    daily = panel.groupBy("date").agg(F.avg("close").alias("close"))
    w = W.orderBy("date")  # one row a date
    return daily.withColumn("log_ret", F.ln(F.col("close") / F.lag("close").over(w)))


def splits(panel: DataFrame) -> DataFrame:
    """``(act_symbol, ex_date, to_factor, for_factor)``: at every 50th bar, by turns the ratio seen and 2 for 1; with repeats."""
    w = W.partitionBy("act_symbol").orderBy("date")
    at = panel.select("act_symbol", "date", "close", F.lag("close").over(w).alias("prev"), F.row_number().over(w).alias("rn")).where("rn % 50 = 0")
    s = at.select(
        "act_symbol", F.col("date").alias("ex_date"),
        F.when(F.col("rn") % 100 == 0, F.round(F.col("prev") / F.col("close"))).otherwise(F.lit(2.0)).alias("to_factor"), F.lit(1.0).alias("for_factor"), "rn",
    )
    return s.unionByName(s.where("rn % 200 = 0")).drop("rn")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statement measures by symbol and period end, all tables joined on their key."""
    t = table(spark, sf_dir, "lineitem").select(
        symbol("l_suppkey").alias("act_symbol"), F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2)).alias("date"),
        F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_quantity").alias("q"),
    )
    g = t.groupBy("act_symbol", "date").agg(
        F.sum("x").alias("sales"), F.sum(F.expr("x * (1 - d)")).alias("pretax_income"), F.sum(F.expr("x * t")).alias("income_taxes"),
        F.sum(F.expr("x * d")).alias("non_operating_income"), F.sum("q").alias("shares_outstanding"), F.count("*").cast("double").alias("n"),
    )
    c = F.col
    return g.select(
        "act_symbol", "date", F.lit("Quarter").alias("period"), "sales", "pretax_income", "income_taxes", "non_operating_income",
        (c("sales") * 0.9).alias("income_before_depreciation_and_amortization"), (c("sales") * 2).alias("total_assets"),
        (c("pretax_income") * 1.5).alias("total_liabilities"), (c("sales") * 0.1).alias("cash_and_equivalents"), (c("sales") * 0.3).alias("long_term_debt"),
        (c("sales") * 0.05).alias("notes_payable"), (c("n") * 10).alias("minority_interest"), "shares_outstanding",
        (c("sales") / c("shares_outstanding")).alias("book_value_per_share"), (c("n") * 5).alias("preferred_stock"),
        (c("sales") * 0.4).alias("net_cash_from_operating_activities"), (c("income_taxes") * 0.5).alias("property_and_equipment"),
        ((c("pretax_income") - c("income_taxes")) / c("shares_outstanding")).alias("diluted_net_eps"),
    )


def calendar(statements_: DataFrame) -> DataFrame:
    """``(act_symbol, date)``: public release dates, 20 to 44 days after period end; every fifth month is skipped."""
    lag = (F.substring("act_symbol", 2, 6).cast("int") % 25 + 20).cast("int")
    s = statements_.where((F.year("date") * 12 + F.month("date")) % 5 != 0)
    return s.select("act_symbol", F.date_add("date", lag).alias("date"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ticker, ts, price)`` from the events table: a ticker per event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("ticker"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))
