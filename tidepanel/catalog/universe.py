"""Universe filters over all months of the panel without ETFs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.base import BARS, ETFS, q6, rounded
from tidepanel.plans import universe as U
from tidepanel.sources import panel as P
from tidepanel.sources import scans as S

HIST = f"""WITH {BARS}, {ETFS}, p AS (SELECT * FROM bars ANTI JOIN etfs USING (act_symbol)),
months AS (SELECT unnest(generate_series(date_trunc('month', min(date))::TIMESTAMP, date_trunc('month', max(date))::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS target FROM p),
h AS (SELECT * FROM (SELECT *, unnest(generate_series((date_trunc('month', date) + INTERVAL 1 MONTH)::TIMESTAMP, (date_trunc('month', date) + INTERVAL 12 MONTH)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS target FROM p)
  SEMI JOIN months USING (target) WHERE date >= target - INTERVAL 12 MONTH AND date < target)"""
STATS = """, g AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY target, act_symbol ORDER BY date DESC) AS j, ln(close / lag(close) OVER w) AS r, """ + ", ".join(
    f"close - lag(close, {k}) OVER w AS d{k}" for k in U.LAGS
) + """ FROM h WINDOW w AS (PARTITION BY target, act_symbol ORDER BY date)),
a AS (SELECT target, act_symbol, count(*) AS history_days, arg_min(close, date) AS first_price, arg_max(close, date) AS last_price, stddev_pop(r) AS sd, avg(close) FILTER (j <= 200) AS sma, """ + ", ".join(
    f"stddev_pop(d{k}) AS s{k}" for k in U.LAGS
) + """ FROM g GROUP BY 1, 2),
u AS (SELECT target, act_symbol, regr_slope(ln(CASE WHEN tau > 0 THEN tau ELSE 1e-8 END), ln(k)) AS hurst FROM (SELECT target, act_symbol, unnest([""" + ", ".join(
    f"sqrt(coalesce(s{k}, 0))" for k in U.LAGS
) + """]) AS tau, unnest([""" + ", ".join(f"{k}.0" for k in U.LAGS) + """])::DOUBLE AS k FROM a) GROUP BY 1, 2),
st AS (SELECT target, act_symbol, history_days, last_price / first_price - 1 AS year_return, CASE WHEN history_days >= 30 THEN sd * sqrt(252) END AS volatility, CASE WHEN history_days >= 30 THEN hurst END AS hurst, last_price,
  history_days >= 200 AND last_price > sma AS uptrend FROM a JOIN u USING (target, act_symbol))"""


def universe(s, d, *filters):
    u = U.Universe(P.bars(s, d), S.etfs(P.symbols(s, d)))
    for f in filters:
        u.add_filter(f)
    return u


def members(*filters):
    def run(s, d):
        u = universe(s, d, *filters)
        return u.members(U.months(u.panel))

    return run


def stats(s, d):
    u = universe(s, d)
    return rounded(U.yearly_stats(u.panel, U.months(u.panel)), "year_return", "volatility", "hurst", "last_price")


def liquid(n: int, source: str = "h") -> str:
    return f"SELECT target, act_symbol FROM (SELECT target, act_symbol, row_number() OVER (PARTITION BY target ORDER BY v DESC, act_symbol) AS r FROM (SELECT target, act_symbol, avg(close * volume) AS v FROM {source} WHERE date >= target - INTERVAL 1 MONTH GROUP BY 1, 2)) WHERE r <= {n}"


CHAIN = (U.TopLiquidityFilter(50), U.PriceFilter(900.0), U.AdvancedStatsFilter(min_history_days=40, max_crash=-0.5, volatility_n=20))
CHAIN_SQL = f"""{HIST}, m1 AS ({liquid(50)}), h1 AS (SELECT * FROM h SEMI JOIN m1 USING (target, act_symbol)),
m2 AS (SELECT target, act_symbol FROM h1 GROUP BY 1, 2 HAVING arg_max(close, date) >= 900)""" + STATS.replace("FROM h WINDOW", "FROM (SELECT * FROM h1 SEMI JOIN m2 USING (target, act_symbol)) WINDOW") + """,
m3 AS (SELECT target, act_symbol FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY volatility, act_symbol) AS k FROM st WHERE hurst IS NOT NULL AND volatility IS NOT NULL AND history_days >= 40 AND year_return >= -0.5) WHERE k <= 20)"""
ONE = "1996-05-15"

ENTRIES = {
    "univ_history_liquidity": (lambda s, d: rounded(U.liquidity(U.history(universe(s, d).panel, U.months(universe(s, d).panel))), "dollar_volume"), f"{HIST} SELECT target, act_symbol, round(avg(close * volume) + 1e-8, 6) + 0.0 AS dollar_volume FROM h WHERE date >= target - INTERVAL 1 MONTH GROUP BY 1, 2"),
    "univ_top_liquidity": (members(U.TopLiquidityFilter(10)), f"{HIST} {liquid(10)}"),
    "univ_price_close": (members(U.PriceFilter(1000.0)), f"{HIST} SELECT target, act_symbol FROM h GROUP BY 1, 2 HAVING arg_max(close, date) >= 1000"),
    "univ_price_average": (members(U.PriceFilter(1500.0, "avg_price_over_last_year")), f"{HIST} SELECT target, act_symbol FROM h GROUP BY 1, 2 HAVING avg(close) >= 1500"),
    "univ_yearly_stats": (stats, f"{HIST}{STATS} SELECT target, act_symbol, history_days, {q6('year_return', 'volatility', 'hurst', 'last_price')}, uptrend FROM st"),
    "univ_advanced_stats": (members(U.AdvancedStatsFilter(min_history_days=60, max_crash=-0.3, volatility_n=15)), f"{HIST}{STATS} SELECT target, act_symbol FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY volatility, act_symbol) AS k FROM st WHERE hurst IS NOT NULL AND volatility IS NOT NULL AND history_days >= 60 AND year_return >= -0.3) WHERE k <= 15"),
    "univ_uptrend": (members(U.AdvancedStatsFilter(require_uptrend=True)), f"{HIST}{STATS} SELECT target, act_symbol FROM st WHERE hurst IS NOT NULL AND volatility IS NOT NULL AND uptrend"),
    "univ_month": (lambda s, d: universe(s, d, U.TopLiquidityFilter(20)).get_universe_for_month(ONE),
        f"{HIST}, k AS (SELECT act_symbol FROM p WHERE date >= DATE '1996-04-15' AND date < DATE '{ONE}' GROUP BY 1 ORDER BY avg(close * volume) DESC, act_symbol LIMIT 20) SELECT act_symbol, date, open, high, low, close, volume FROM p SEMI JOIN k USING (act_symbol) WHERE date >= DATE '{ONE}' AND date < DATE '1996-06-15'"),
    "univ_all_months": (lambda s, d: universe(s, d, *CHAIN).get_all_universe_data(), f"{CHAIN_SQL} SELECT p.act_symbol, date, open, high, low, close, volume FROM p JOIN m3 ON m3.act_symbol = p.act_symbol AND m3.target = date_trunc('month', date)::DATE"),
}
