"""What the catalogue's queries and SQL share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
BARS = f"""bars AS MATERIALIZED (
  SELECT 'S' || lpad(l_suppkey::VARCHAR, 6, '0') AS act_symbol, l_shipdate::DATE AS date, first(p ORDER BY {ORDER}) AS open, max(p) AS high,
    min(p) AS low, last(p ORDER BY {ORDER}) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)"""
BASE = (
    BARS
    + """, b AS MATERIALIZED (
  SELECT *, ln(close) AS log_close, ln(high) AS log_high, ln(low) AS log_low, ln(volume) AS log_volume, row_number() OVER s AS rn,
    ln(close / lag(close) OVER s) AS log_ret, open - lag(close) OVER s AS gap_size
  FROM bars WINDOW s AS (PARTITION BY act_symbol ORDER BY date))"""
)
MARKET = """mk AS (SELECT date, ln(c / lag(c) OVER (ORDER BY date)) AS mkt FROM (SELECT date, avg(close) AS c FROM bars GROUP BY 1))"""
ETFS = """etfs AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS act_symbol FROM supplier WHERE s_suppkey % 10 = 0)"""


def r6(c: Column) -> Column:
    """Six places, without a negative zero; the offset keeps decimals that end in 5 off the tie."""
    return F.round(c + 1e-8, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(f"`{c}`")) for c in columns})


def q6(*columns: str) -> str:
    return ", ".join(f'round({c} + 1e-8, 6) + 0.0 AS {c}' for c in columns)
