"""Mixes, comparisons and options."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.base import BARS, BASE, q6, r6, rounded
from tidepanel.functions import options as O
from tidepanel.operators import portfolio as M
from tidepanel.plans.features import prepare
from tidepanel.sources import panel as P

THREE = ["S000001", "S000002", "S000003"]
#: The three symbols seldom trade on one day, so each is carried to month ends.
MONTHLY = """mo AS (SELECT act_symbol, last_day(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"""
SUMMED = "mx AS (SELECT *, ln(close / lag(close) OVER (ORDER BY date)) AS log_ret FROM (SELECT date, sum(open) AS open, sum(high) AS high, sum(low) AS low, sum(close) AS close, sum(volume) AS volume FROM mo WHERE act_symbol IN ('S000001', 'S000002', 'S000003') GROUP BY 1 HAVING count(DISTINCT act_symbol) = 3))"
RETS = "mr AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY act_symbol ORDER BY date)) AS log_ret FROM mo)"


def monthly(s, d):
    return P.bars(s, d).groupBy("act_symbol", F.last_day("date").alias("date")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def returns(s, d):
    return prepare(monthly(s, d))


def asset(df, name):
    return df.where(F.col("act_symbol") == name)


def compared(s, d):
    m = monthly(s, d)
    return rounded(M.compared(asset(m, "S000001"), asset(m, "S000002")), "log_ret_self", "log_ret_stock", "diff")


def against(s, d):
    r = returns(s, d)
    return rounded(M.against_mix(asset(r, "S000001"), M.mix(monthly(s, d), THREE)), "relative")


def black_scholes(s, d):
    b = P.bars(s, d)
    p, k, rf, t, v = F.col("close"), F.col("open"), F.lit(0.06), F.lit(30 / 365), F.lit(0.4)
    return b.select("act_symbol", "date", r6(O.d1(p, k, rf, t, v)).alias("d1"), r6(O.d2(p, k, rf, t, v)).alias("d2"), r6(O.call_value(p, k, rf, t, v)).alias("call_value"), r6(O.put_value(p, k, rf, t, v)).alias("put_value"))


def phi(x):
    t = f"(1 / (1 + {O.NORMAL_P} * abs({x})))"
    poly = "0.0"
    for c in reversed(O.NORMAL):
        poly = f"({poly} + ({c})) * {t}"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


BS = f"""WITH {BARS}, q AS (SELECT *, (ln(close / open) + (0.06 + 0.4 * 0.4 / 2) * (30 / 365)) / (0.4 * sqrt(30 / 365)) AS d1 FROM bars), z AS (SELECT *, d1 - 0.4 * sqrt(30 / 365) AS d2 FROM q)
SELECT act_symbol, date, {q6('d1', 'd2')}, round(close * {phi('d1')} - open * exp(-0.06 * (30 / 365)) * {phi('d2')} + 1e-8, 6) + 0.0 AS call_value,
  round(open * exp(-0.06 * (30 / 365)) * {phi('(-d2)')} - close * {phi('(-d1)')} + 1e-8, 6) + 0.0 AS put_value FROM z"""


def contracts(s, d):
    b = prepare(P.bars(s, d))
    return b.select("act_symbol", "date", r6(O.contract_return(F.col("open"), F.col("close"), 30)).alias("contract_ret"), r6(O.realised(F.col("log_ret"), 30, True)).alias("vol"))


CONTRACTS = f"WITH {BASE}, c AS (SELECT *, ln(close / open) AS lr FROM b) SELECT act_symbol, date, round(CASE WHEN count(lr) OVER w = 30 THEN sum(lr) OVER w END + 1e-8, 6) + 0.0 AS contract_ret, round(CASE WHEN count(log_ret) OVER w = 30 THEN stddev_samp(log_ret) OVER w END * sqrt(252) + 1e-8, 6) + 0.0 AS vol FROM c WINDOW w AS (PARTITION BY act_symbol ORDER BY date ROWS 29 PRECEDING)"


def collar(s, d):
    b = prepare(P.bars(s, d))
    b = b.withColumns({"contract_ret": O.contract_return(F.col("open"), F.col("close"), 5), "vol": O.realised(F.col("log_ret"), 30)})
    return rounded(O.collar(b), "principal", "call_profit", "put_profit")


def aligned(s, d):
    """The mean close of all symbols by month end, and its part from 1994 on: cropped to each other, on the same dates."""
    whole = monthly(s, d).groupBy("date").agg(F.avg("close").alias("close"))
    a, b = M.aligned(whole, whole.where("date >= '1994-01-01'"))
    return rounded(a.join(b.select("date", F.col("close").alias("other")), "date"), "close", "other")


ENTRIES = {
    "port_aligned": (aligned, f"WITH {BARS}, {MONTHLY}, w AS (SELECT date, avg(close) AS close FROM mo GROUP BY 1) SELECT date, {q6('close')}, round(close + 1e-8, 6) + 0.0 AS other FROM w WHERE date >= DATE '1994-01-01'"),
    "port_compare": (compared, f"WITH {BARS}, {MONTHLY}, c AS (SELECT date FROM mo WHERE act_symbol = 'S000001' INTERSECT SELECT date FROM mo WHERE act_symbol = 'S000002'), r AS (SELECT act_symbol, date, ln(close / lag(close) OVER (PARTITION BY act_symbol ORDER BY date)) AS lr FROM mo SEMI JOIN c USING (date) WHERE act_symbol IN ('S000001', 'S000002')) SELECT a.date, round(a.lr + 1e-8, 6) + 0.0 AS log_ret_self, round(b.lr + 1e-8, 6) + 0.0 AS log_ret_stock, round(a.lr - b.lr + 1e-8, 6) + 0.0 AS diff FROM r a JOIN r b ON a.date = b.date AND a.act_symbol = 'S000001' AND b.act_symbol = 'S000002'"),
    "port_mix": (lambda s, d: rounded(M.mix(monthly(s, d), THREE), "open", "high", "low", "close", "volume", "log_ret"), f"WITH {BARS}, {MONTHLY}, {SUMMED} SELECT date, {q6('open', 'high', 'low', 'close', 'volume', 'log_ret')} FROM mx"),
    "port_against_mix": (against, f"WITH {BARS}, {MONTHLY}, {SUMMED}, {RETS} SELECT date, round(sum(r.log_ret - mx.log_ret) OVER (ORDER BY date) + 1e-8, 6) + 0.0 AS relative FROM (SELECT * FROM mr WHERE act_symbol = 'S000001') r JOIN mx USING (date)"),
    "port_against_mean": (lambda s, d: rounded(M.against_mean(monthly(s, d), THREE, "S000003"), "relative"), f"WITH {BARS}, {MONTHLY}, {SUMMED}, {RETS} SELECT date, round(sum(r.log_ret - mx.log_ret) OVER (ORDER BY date) + 1e-8, 6) + 0.0 AS relative FROM (SELECT * FROM mr WHERE act_symbol = 'S000003') r JOIN mx USING (date)"),
    "port_percent_change": (lambda s, d: P.bars(s, d).select("act_symbol", "date", r6(M.percent_change()).alias("pct_change")), f"WITH {BARS} SELECT act_symbol, date, round(close / lag(close) OVER (PARTITION BY act_symbol ORDER BY date) - 1 + 1e-8, 6) + 0.0 AS pct_change FROM bars"),
    "port_cumulative": (lambda s, d: rounded(M.cumulative(M.chop(prepare(P.bars(s, d)), "1995-01-01", "1996-12-31")).select("act_symbol", "date", "cum_ret"), "cum_ret"), f"WITH {BASE} SELECT act_symbol, date, round(sum(log_ret) OVER (PARTITION BY act_symbol ORDER BY date) + 1e-8, 6) + 0.0 AS cum_ret FROM b WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"),
    "option_black_scholes": (black_scholes, BS),
    "option_contract_returns": (contracts, CONTRACTS),
    "option_collar": (collar, None),
}
