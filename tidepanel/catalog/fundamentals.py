"""Splits, statements, release dates and their place on the bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.base import BARS, ETFS, q6, r6, rounded
from tidepanel.functions import fundamentals as V
from tidepanel.operators import splits as X
from tidepanel.plans import statements as T
from tidepanel.sources import panel as P
from tidepanel.sources import scans as S

ST = """st AS MATERIALIZED (SELECT act_symbol, date, 'Quarter' AS period, sales, pretax_income, income_taxes, non_operating_income, sales * 0.9 AS income_before_depreciation_and_amortization,
  sales * 2 AS total_assets, pretax_income * 1.5 AS total_liabilities, sales * 0.1 AS cash_and_equivalents, sales * 0.3 AS long_term_debt, sales * 0.05 AS notes_payable, n * 10 AS minority_interest,
  shares_outstanding, sales / shares_outstanding AS book_value_per_share, n * 5 AS preferred_stock, sales * 0.4 AS net_cash_from_operating_activities, income_taxes * 0.5 AS property_and_equipment,
  (pretax_income - income_taxes) / shares_outstanding AS diluted_net_eps
  FROM (SELECT 'S' || lpad(l_suppkey::VARCHAR, 6, '0') AS act_symbol, last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE) AS date, sum(l_extendedprice) AS sales,
    sum(l_extendedprice * (1 - l_discount)) AS pretax_income, sum(l_extendedprice * l_tax) AS income_taxes, sum(l_extendedprice * l_discount) AS non_operating_income, sum(l_quantity) AS shares_outstanding, count(*)::DOUBLE AS n
    FROM lineitem GROUP BY 1, 2))"""
CAL = """cal AS (SELECT act_symbol, date + (substr(act_symbol, 2, 6)::INT % 25 + 20)::INT AS date FROM st WHERE (year(date) * 12 + month(date)) % 5 <> 0)"""
REL = "rel AS (SELECT st.*, cal.date AS release_date FROM st ASOF JOIN cal ON st.act_symbol = cal.act_symbol AND st.date <= cal.date)"
SPLITS = """sp AS (SELECT act_symbol, date AS ex_date, CASE WHEN rn % 100 = 0 THEN round(prev / close) ELSE 2.0 END AS to_factor, 1.0 AS for_factor, rn
  FROM (SELECT *, lag(close) OVER s AS prev, row_number() OVER s AS rn FROM bars WINDOW s AS (PARTITION BY act_symbol ORDER BY date)) WHERE rn % 50 = 0)"""
# A split and its repeat fall on one bar: the first is held against the drop, the repeat against what is left of it.
TAKEN = f"""{SPLITS}, sd AS (SELECT sp.act_symbol, ex_date, to_factor / for_factor AS r, sp.rn, (SELECT NULL) AS nothing FROM sp WHERE to_factor > 0 AND to_factor <> for_factor),
dr AS (SELECT act_symbol, date, lag(close) OVER (PARTITION BY act_symbol ORDER BY date) / close AS fall FROM bars),
one AS (SELECT sd.*, fall, fall IS NULL OR abs(fall - r) / r <= 0.25 AS first_ok FROM sd JOIN dr ON dr.act_symbol = sd.act_symbol AND dr.date = sd.ex_date),
tk AS (SELECT act_symbol, ex_date, r FROM one WHERE first_ok
  UNION ALL SELECT act_symbol, ex_date, r FROM one WHERE rn % 200 = 0 AND (fall IS NULL OR abs(fall / CASE WHEN first_ok THEN r ELSE 1 END - r) / r <= 0.25))"""
ADJ = f"""{TAKEN}, fa AS (SELECT b.act_symbol, b.date, product(r) AS f FROM bars b JOIN tk ON tk.act_symbol = b.act_symbol AND tk.ex_date > b.date GROUP BY 1, 2),
adj AS MATERIALIZED (SELECT b.act_symbol, b.date, b.open / coalesce(f, 1) AS open, b.high / coalesce(f, 1) AS high, b.low / coalesce(f, 1) AS low, b.close / coalesce(f, 1) AS close, b.volume * coalesce(f, 1) AS volume FROM bars b LEFT JOIN fa USING (act_symbol, date))"""
EXPR = {
    "ROIC": "(pretax_income - income_taxes - non_operating_income) / nullif(total_assets - total_liabilities, 0)",
    "operating_margin": "(pretax_income - non_operating_income) / nullif(sales, 0)",
    "FCF_margin": "(net_cash_from_operating_activities - property_and_equipment) / nullif(sales, 0)",
    "FCF_yield": "(net_cash_from_operating_activities - property_and_equipment) / nullif(shares_outstanding * book_value_per_share, 0)",
    "EV": "shares_outstanding * book_value_per_share + long_term_debt + notes_payable + preferred_stock + minority_interest - cash_and_equivalents",
    "EBITDA": "income_before_depreciation_and_amortization",
    "revenue_CAGR": "pow(sales / nullif(lag(sales) OVER p, 0), 4)",
    "EPS_CAGR": "pow(diluted_net_eps / nullif(lag(diluted_net_eps) OVER p, 0), 4) - 1",
}
EXPR["EV/EBITDA"] = f"({EXPR['EV']}) / nullif({EXPR['EBITDA']}, 0)"
PERIODS = "WINDOW p AS (PARTITION BY act_symbol, period ORDER BY date)"
SEVEN = list(V.VARIABLES)


def st(s, d):
    return P.statements(s, d)


def bars_and_splits(s, d):
    b = P.bars(s, d)
    return b, P.splits(b)


def one(name, fn):
    return lambda s, d: st(s, d).select("act_symbol", "date", r6(fn()).alias(name))


def one_sql(name):
    return f'WITH {ST} SELECT act_symbol, date, round({EXPR[name]} + 1e-8, 6) + 0.0 AS "{name}" FROM st {PERIODS}'


def everything(s, d):
    b, sp = bars_and_splits(s, d)
    x = st(s, d)
    out = T.all_data(b, sp, x, P.calendar(x), tasks=P.tasks(s, d))
    nums = ["open", "high", "low", "close", "volume", "prev_close", "log_ret", "prev_ret", "ret_5d", "ret_20d", "vol_20d", *SEVEN]
    return rounded(out, *nums)


PRICE = """v1 AS (SELECT *, lag(close) OVER s AS prev_close, ln(close / lag(close) OVER s) AS log_ret FROM {src} WINDOW s AS (PARTITION BY act_symbol ORDER BY date)),
v2 AS (SELECT *, lag(log_ret) OVER s AS prev_ret, CASE WHEN count(log_ret) OVER w5 = 5 THEN sum(log_ret) OVER w5 END AS ret_5d, CASE WHEN count(log_ret) OVER w20 = 20 THEN sum(log_ret) OVER w20 END AS ret_20d,
  CASE WHEN count(log_ret) OVER w20 = 20 THEN stddev_samp(log_ret) OVER w20 END AS vol_20d FROM v1
  WINDOW s AS (PARTITION BY act_symbol ORDER BY date), w5 AS (PARTITION BY act_symbol ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY act_symbol ORDER BY date ROWS 19 PRECEDING))"""
PV = ("prev_close", "log_ret", "prev_ret", "ret_5d", "ret_20d", "vol_20d")
VARS = "vars AS (SELECT act_symbol, date, " + ", ".join(f'{EXPR[n]} AS "{n}"' for n in SEVEN) + f" FROM st {PERIODS})"
REL7 = "rel AS (SELECT vars.*, cal.date AS release_date FROM vars ASOF JOIN cal ON vars.act_symbol = cal.act_symbol AND vars.date <= cal.date)"
# Of statements with one release date the one with the largest payload counts.
LAST = "lastrel AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY act_symbol, release_date ORDER BY {order}) = 1)"


def release(s, d):
    x = st(s, d).select("act_symbol", "date", "sales")
    return T.with_release(x, P.calendar(x), keep_unmatched=True).select("act_symbol", "date", "release_date")


def days_single(s, d):
    x = st(s, d)
    b = P.bars(s, d).where("act_symbol = 'S000002'").select("act_symbol", "date")
    return T.on_bars(b, T.with_release(x, P.calendar(x)), []).select("act_symbol", "date", "release_date", "days_since_release")


def batched(s, d):
    x = st(s, d)
    out = T.batch(P.bars(s, d), S.etfs(P.symbols(s, d)), x, P.calendar(x), tasks=P.tasks(s, d))
    return rounded(out.select("act_symbol", "date", "close", "release_date", "ROIC", "operating_margin", "days_since_release"), "ROIC", "operating_margin")


def split_single(s, d):
    b, sp = bars_and_splits(s, d)
    pick = F.col("act_symbol") == "S000003"
    return rounded(X.adjust(b.where(pick), sp.where(pick)), "open", "high", "low", "close", "volume")


def split_batch(s, d):
    return rounded(X.adjust(*bars_and_splits(s, d), tasks=P.tasks(s, d)), "open", "high", "low", "close", "volume")


def joined(s, d):
    x = st(s, d)
    key = ["act_symbol", "date", "period"]
    parts = [x.select(*key, "sales", F.col("n_").alias("currency")) for x in [x.withColumn("n_", F.lit("USD"))]]
    a = x.select(*key, "total_assets", F.lit("USD").alias("currency"))
    l = x.select(*key, "total_liabilities", F.lit("USD").alias("currency"))
    return rounded(T.joined(parts[0], a, l), "sales", "total_assets", "total_liabilities")


ENTRIES = {
    "fund_statements": (lambda s, d: rounded(S.statements(st(s, d), "S000004", "1993-01-01", "1998-01-01").select("act_symbol", "date", "period", "sales", "pretax_income"), "sales", "pretax_income"), f"WITH {ST} SELECT act_symbol, date, period, {q6('sales', 'pretax_income')} FROM st WHERE act_symbol = 'S000004' AND date > DATE '1993-01-01' AND date < DATE '1998-01-01'"),
    "fund_calendar": (lambda s, d: P.calendar(st(s, d)), f"WITH {ST}, {CAL} SELECT act_symbol, date FROM cal"),
    "fund_joined_statements": (joined, f"WITH {ST} SELECT act_symbol, date, period, {q6('sales')}, 'USD' AS currency, {q6('total_assets')}, 'USD' AS currency_ast, {q6('total_liabilities')}, 'USD' AS currency_liab FROM st"),
    **{f"fund_{n.lower().replace('/', '_')}": (one(n, fn), one_sql(n)) for n, fn in ({**V.VARIABLES, "EV": V.enterprise_value, "EBITDA": V.ebitda}).items()},
    "fund_variables": (lambda s, d: rounded(T.variables(st(s, d)), *SEVEN), f"WITH {ST} SELECT act_symbol, date, period, " + ", ".join(f'round({EXPR[n]} + 1e-8, 6) + 0.0 AS "{n}"' for n in SEVEN) + f" FROM st {PERIODS}"),
    "fund_release_date": (release, f"WITH {ST}, {CAL} SELECT st.act_symbol, st.date, cal.date AS release_date FROM st ASOF LEFT JOIN cal ON st.act_symbol = cal.act_symbol AND st.date <= cal.date"),
    "fund_release_by_place": (lambda s, d: T.shifted_release(st(s, d).select("act_symbol", "date"), P.calendar(st(s, d))), f"WITH {ST}, {CAL} SELECT a.act_symbol, a.date, c.date AS release_date FROM (SELECT act_symbol, date, row_number() OVER (PARTITION BY act_symbol ORDER BY date) AS k FROM st) a LEFT JOIN (SELECT act_symbol, date, row_number() OVER (PARTITION BY act_symbol ORDER BY date) + 1 AS k FROM cal) c USING (act_symbol, k)"),
    "fund_days_since_single": (days_single, f"WITH {BARS}, {ST}, {CAL}, {REL}, r AS (SELECT DISTINCT act_symbol, release_date FROM rel) SELECT b.act_symbol, b.date, r.release_date, (b.date - r.release_date)::INT AS days_since_release FROM (SELECT * FROM bars WHERE act_symbol = 'S000002') b ASOF LEFT JOIN r ON b.act_symbol = r.act_symbol AND b.date >= r.release_date"),
    "fund_batch": (batched, f"WITH {BARS}, {ETFS}, {ST}, {CAL}, {REL}, x AS (SELECT act_symbol, release_date, {EXPR['ROIC']} AS \"ROIC\", {EXPR['operating_margin']} AS operating_margin FROM rel), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY act_symbol, release_date ORDER BY \"ROIC\" DESC, operating_margin DESC) = 1) SELECT b.act_symbol, b.date, b.close, y.release_date, round(\"ROIC\" + 1e-8, 6) + 0.0 AS \"ROIC\", {q6('operating_margin')}, coalesce((b.date - y.release_date)::INT, -1) AS days_since_release FROM (SELECT * FROM bars ANTI JOIN etfs USING (act_symbol)) b ASOF LEFT JOIN y ON b.act_symbol = y.act_symbol AND b.date >= y.release_date"),
    "split_accepted": (lambda s, d: X.accepted(*bars_and_splits(s, d)), f"WITH {BARS}, {TAKEN} SELECT act_symbol, ex_date, r AS ratio FROM tk"),
    "split_adjust_single": (split_single, f"WITH {BARS}, {ADJ} SELECT act_symbol, date, {q6('open', 'high', 'low', 'close', 'volume')} FROM adj WHERE act_symbol = 'S000003'"),
    "split_adjust_batch": (split_batch, f"WITH {BARS}, {ADJ} SELECT act_symbol, date, {q6('open', 'high', 'low', 'close', 'volume')} FROM adj"),
    "price_variables": (lambda s, d: rounded(T.price_variables(P.bars(s, d)).select("act_symbol", "date", *PV), *PV), f"WITH {BARS}, {PRICE.format(src='bars')} SELECT act_symbol, date, {q6(*PV)} FROM v2"),
    "fund_all_data": (everything, f"WITH {BARS}, {ADJ}, {PRICE.format(src='adj')}, {ST}, {CAL}, {VARS}, {REL7}, {LAST.format(order=', '.join(chr(34) + n + chr(34) + ' DESC' for n in SEVEN))} SELECT v2.act_symbol, v2.date, {', '.join(f'round(v2.{c} + 1e-8, 6) + 0.0 AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', *PV))}, r.release_date, "
        + ", ".join(f'round(r."{n}" + 1e-8, 6) + 0.0 AS "{n}"' for n in SEVEN) + ", (v2.date - r.release_date)::INT AS days_since_release FROM v2 ASOF LEFT JOIN lastrel r ON v2.act_symbol = r.act_symbol AND v2.date >= r.release_date"),
}
