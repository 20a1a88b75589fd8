"""A query per feature, transform and part of the request shell, over all bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.catalog.base import BARS, BASE, MARKET, r6
from tidepanel.functions import windows as R
from tidepanel.plans.features import FeatureEngine, FeatureRequest, prepare
from tidepanel.sources import panel as P

ENTRIES: dict = {}


def computed(spark: SparkSession, sf_dir: str, *requests: FeatureRequest, block_rows: int | None = None) -> DataFrame:
    bars = P.bars(spark, sf_dir, whole=block_rows is None)
    market = P.market(bars) if any("market" in r.feature.inputs for r in requests) else None
    out = FeatureEngine(list(requests)).compute(bars, market, block_rows, keep=(), tasks=P.tasks(spark, sf_dir) if block_rows else None)
    names = [c for r in requests for c in r.columns()]
    return out.select("act_symbol", "date", *[r6(F.col(f"`{c}`").cast("double")).alias(c) for c in names])


def full(x: str, n: int, agg: str, w: str = "w") -> str:
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg} OVER {w} END"


def windows(n: int) -> str:
    return (
        "WINDOW s AS (PARTITION BY act_symbol ORDER BY date), "
        f"w AS (PARTITION BY act_symbol ORDER BY date ROWS {n - 1} PRECEDING), f AS (PARTITION BY act_symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING), d AS (PARTITION BY date)"
    )


def sql_of(outputs: dict[str, str], n: int = 1, steps: tuple[str, ...] = (), source: str = "b", extra: str = "", recursive: bool = False) -> str:
    """SELECT of named expressions; each step is a layer of columns below."""
    ctes = ["WITH " + ("RECURSIVE " if recursive else "") + BASE + (", " + extra if extra else "")]
    last = source
    for k, step in enumerate(steps):
        ctes.append(f"s{k} AS (SELECT *, {step} FROM {last} {windows(n)})")
        last = f"s{k}"
    cols = ", ".join(f'round({e} + 1e-8, 6) + 0.0 AS "{name}"' for name, e in outputs.items())
    return ",\n".join(ctes) + f"\nSELECT act_symbol, date, {cols} FROM {last} {windows(n)}"


def feature(key: str, request: FeatureRequest, expressions, n: int = 1, steps: tuple[str, ...] = (), **more) -> None:
    expressions = (expressions,) if isinstance(expressions, str) else expressions
    sql = sql_of(dict(zip(request.columns(), expressions, strict=True)), n, steps, **more)
    ENTRIES[key] = (lambda spark, sf_dir: computed(spark, sf_dir, request), sql)


def ask(name: str, n: int | None = None, x: str = "log_price", **more) -> FeatureRequest:
    params = {"timeperiod": n} if n else {}
    return FeatureRequest(name, params, input_type=x, alias=more.pop("alias", name.lower()), **more)


# Rolling statistics.
for _key, _name, _agg in (("volatility", "VOLATILITY", "stddev_samp"), ("mean", "MEAN", "avg"), ("sum", "SUM", "sum"), ("skew", "SKEW", "skewness"), ("kurt", "KURT", "kurtosis")):
    feature(f"feat_{_key}", ask(_name, 10, "log_ret" if _name != "MEAN" else "close"), full("log_ret" if _name != "MEAN" else "close", 10, f"{_agg}({'log_ret' if _name != 'MEAN' else 'close'})"), 10)
feature("feat_zscore", ask("ZSCORE", 20), f"({'log_close'} - {full('log_close', 20, 'avg(log_close)')}) / nullif({full('log_close', 20, 'stddev_samp(log_close)')}, 0)", 20)
feature("feat_vol_zscore", ask("VOL_ZSCORE", 20, "raw"), f"(log_volume - {full('log_volume', 20, 'avg(log_volume)')}) / nullif({full('log_volume', 20, 'stddev_samp(log_volume)')}, 0)", 20)
_SPREAD = ("(ln(high) + ln(low)) / 2 AS eta, ln(close) AS c", "4 * (lag(c) OVER s - lag(eta) OVER s) * (lag(c) OVER s - eta) AS p", f"{full('p', 20, 'avg(p)')} AS m")
feature("feat_spread_ar", ask("SPREAD_AR", 20, "raw"), "CASE WHEN m IS NOT NULL THEN sqrt(greatest(0, m)) END", 20, _SPREAD)
_SPREAD_LOG = ("(ln(CASE WHEN log_high > 0 THEN log_high END) + ln(CASE WHEN log_low > 0 THEN log_low END)) / 2 AS eta, ln(CASE WHEN log_close > 0 THEN log_close END) AS c", *_SPREAD[1:])
feature("feat_spread_ar_default_input", ask("SPREAD_AR", 20), "CASE WHEN m IS NOT NULL THEN sqrt(greatest(0, m)) END", 20, _SPREAD_LOG)
feature("feat_ma_crossover", ask("MA_crossover", 20, "raw"), f"coalesce((close >= {full('close', 20, 'avg(close)')})::INT, 0)::DOUBLE", 20)
#: The rescaled range: the window's differences as 20 lags, their centred sums one by one.
_LAGS = ", ".join(f"lag(d, {k}) OVER s AS x{k}" for k in range(20))
_SUMS = [f"({' + '.join(f'x{k}' for k in range(19, 19 - i, -1))} - {i} * m)" for i in range(1, 21)]
_WALK = f"""e AS MATERIALIZED (
  SELECT act_symbol, rn, CASE WHEN count(d) OVER w = 20 THEN avg(d) OVER w END AS m, stddev_samp(d) OVER w AS sd, {_LAGS}
  FROM dd WINDOW s AS (PARTITION BY act_symbol ORDER BY rn), w AS (PARTITION BY act_symbol ORDER BY rn ROWS 19 PRECEDING)),
k AS MATERIALIZED (SELECT act_symbol, rn, sd, {', '.join(f'{z} AS z{i}' for i, z in enumerate(_SUMS))} FROM e WHERE m IS NOT NULL),
h AS MATERIALIZED (SELECT act_symbol, rn, sd AS s, greatest({', '.join(f'z{i}' for i in range(20))}) - least({', '.join(f'z{i}' for i in range(20))}) AS r FROM k)"""
feature(
    "feat_hurst", ask("HURST", 20), "h.hh", 1, source="(SELECT b.*, CASE WHEN h.r > 0 THEN ln(h.r / CASE WHEN h.s = 0 THEN 1e-9 ELSE h.s END) / ln(20) END AS hh FROM b LEFT JOIN h USING (act_symbol, rn)) h",
    extra="dd AS (SELECT act_symbol, date, rn, log_close - lag(log_close) OVER (PARTITION BY act_symbol ORDER BY date) AS d FROM b), " + _WALK,
)
feature("feat_autocorr", ask("AUTOCORR", 20, "log_ret"), "cov / nullif(sqrt(va * vb), 0)", 20, (
    "lag(log_ret) OVER s AS x1", "CASE WHEN x1 IS NOT NULL THEN log_ret END AS a, CASE WHEN log_ret IS NOT NULL THEN x1 END AS c",
    f"{full('a', 20, 'covar_samp(a, c)')} AS cov, {full('a', 20, 'var_samp(a)')} AS va, {full('a', 20, 'var_samp(c)')} AS vb"))
_BETA = "(SELECT b.*, mkt, CASE WHEN log_ret IS NOT NULL AND mkt IS NOT NULL THEN 1 END AS both_ FROM b LEFT JOIN mk USING (date)) j"
feature("feat_pandas_beta", ask("pandas_beta", 20, market_ref="MKT"), f"{full('both_', 20, 'covar_samp(log_ret, mkt)')} / nullif({full('both_', 20, 'var_samp(mkt)')}, 0)", 20, source=_BETA, extra=MARKET)
feature("feat_beta_of_changes", ask("BETA", 5, market_ref="MKT"), f"{full('k', 5, 'covar_samp(dx, dy)')} / nullif({full('k', 5, 'var_samp(dy)')}, 0)", 5, (
    "log_ret / nullif(lag(log_ret) OVER s, 0) - 1 AS dx, mkt / nullif(lag(mkt) OVER s, 0) - 1 AS dy", "CASE WHEN dx IS NOT NULL AND dy IS NOT NULL THEN 1 END AS k"), source=_BETA, extra=MARKET)
feature("feat_vwap_z", ask("VWAP_Z", 20), f"(close - {full('close', 20, 'sum(pv)')} / nullif({full('volume', 20, 'sum(volume)')}, 0)) / nullif({full('close', 20, 'stddev_samp(close)')}, 0)", 20, ("close * volume AS pv",))
feature("feat_range_efficiency", ask("RANGE_EFFICIENCY", 1, "raw"), "abs(close - open) / nullif(high - low, 0)")
feature("feat_rel_range", ask("REL_RANGE", 20, "raw"), f"g / nullif({full('g', 20, 'avg(g)')}, 0)", 20, ("high - low AS g",))
feature("feat_target_sharpe", ask("TARGET_SHARPE", 5, "raw"), f"{full('log_ret', 5, 'sum(log_ret)', 'f')} / ({full('log_ret', 5, 'stddev_samp(log_ret)', 'f')} + 1e-6)", 5)
feature("feat_intraday_log_ret", ask("INTRADAY_LOG_RET", 1, "raw"), "ln(close / open)")
feature("feat_fwd_log_ret", ask("FWD_LOG_RET", 5, "raw", shift=1), "lead(v) OVER s", 5, (f"{full('log_ret', 5, 'sum(log_ret)', 'f')} AS v",))
feature("feat_mom", ask("MOM", 20, shift=-1), "lag(v) OVER s", 1, ("log_close - lag(log_close, 20) OVER s AS v",))
feature("feat_roc", ask("ROC", 10, "raw"), "100 * (close / lag(close, 10) OVER s - 1)")
feature("feat_sma", ask("SMA", 30), full("log_close", 30, "avg(log_close)"), 30)
_LINE = (f"{full('log_close', 14, 'regr_slope(log_close, rn::DOUBLE)')} AS k, {full('log_close', 14, 'avg(log_close)')} AS m",)
feature("feat_slope", ask("SLOPE", 14), "k", 14, _LINE)
feature("feat_angle", ask("ANGLE", 14), "degrees(atan(k))", 14, _LINE)
feature("feat_tsf", ask("TSF", 14), "m + k * (14 - 13 / 2.0)", 14, _LINE)
_BANDS = (f"{full('log_close', 20, 'avg(log_close)')} AS m, {full('log_close', 20, 'stddev_pop(log_close)')} AS sd",)
feature("feat_bbands", ask("BBANDS", 20), ("m + 2 * sd", "m", "m - 2 * sd"), 20, _BANDS)
feature("feat_percent_b", ask("PERCENT_B", 20), ("(log_close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0)", "((m + 2 * sd) - (m - 2 * sd)) / nullif(m, 0)"), 20, _BANDS)
_W3 = "(PARTITION BY act_symbol ORDER BY date ROWS 2 PRECEDING)"
feature("feat_stoch", ask("STOCH", x="raw"), ("k3", f"CASE WHEN count(k3) OVER {_W3} = 3 THEN avg(k3) OVER {_W3} END"), 5, (
    f"100 * (close - {full('low', 5, 'min(low)')}) / nullif({full('high', 5, 'max(high)')} - {full('low', 5, 'min(low)')}, 0) AS k1", f"CASE WHEN count(k1) OVER {_W3} = 3 THEN avg(k1) OVER {_W3} END AS k3"))


# Recursive smoothers.
def smoother(name: str, source: str, x: str, begin: int, n: int, alpha: str) -> str:
    """A recursive CTE ``name(act_symbol, rn, v)``: from the mean of n rows on, v + alpha (x - v)."""
    return f"""{name} AS (
  SELECT act_symbol, {begin + n - 1}::BIGINT AS rn, avg({x}) AS v FROM {source} WHERE rn BETWEEN {begin} AND {begin + n - 1} GROUP BY 1 HAVING count(*) = {n}
  UNION ALL SELECT t.act_symbol, t.rn, e.v + {alpha} * (t.{x} - e.v) FROM {name} e JOIN {source} t ON t.act_symbol = e.act_symbol AND t.rn = e.rn + 1)"""


_CHANGES = """t AS MATERIALIZED (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr, greatest(log_close - lag(log_close) OVER s, 0) AS up_log, greatest(lag(log_close) OVER s - log_close, 0) AS down_log,
    greatest(close - lag(close) OVER s, 0) AS up, greatest(lag(close) OVER s - close, 0) AS down,
    CASE WHEN high - lag(high) OVER s > lag(low) OVER s - low AND high - lag(high) OVER s > 0 THEN high - lag(high) OVER s ELSE 0 END AS plus,
    CASE WHEN lag(low) OVER s - low > high - lag(high) OVER s AND lag(low) OVER s - low > 0 THEN lag(low) OVER s - low ELSE 0 END AS minus
  FROM b WINDOW s AS (PARTITION BY act_symbol ORDER BY date))"""
feature("feat_ema", ask("EMA", 20), "v", source="(SELECT b.*, e.v FROM b LEFT JOIN e USING (act_symbol, rn)) z", extra=smoother("e", "b", "log_close", 1, 20, "2.0 / 21"), recursive=True)
feature("feat_rsi", ask("RSI", 14, "raw"), "CASE WHEN u.v + w_.v = 0 THEN 0 ELSE 100 * u.v / (u.v + w_.v) END".replace("u.v", "uv").replace("w_.v", "dv"), source="(SELECT b.*, u.v AS uv, g.v AS dv FROM b LEFT JOIN u USING (act_symbol, rn) LEFT JOIN g USING (act_symbol, rn)) z",
        extra=_CHANGES + ", " + smoother("u", "t", "up", 2, 14, "1.0 / 14") + ", " + smoother("g", "t", "down", 2, 14, "1.0 / 14"), recursive=True)
_LINE_CTE = "l AS MATERIALIZED (SELECT a.act_symbol, a.rn, a.v - c.v AS line FROM e12 a JOIN e26 c USING (act_symbol, rn))"
feature("feat_macd", FeatureRequest("MACD", alias="macd"), ("CASE WHEN v IS NOT NULL THEN line END", "v", "line - v"), source="(SELECT b.*, line, e9.v FROM b LEFT JOIN l USING (act_symbol, rn) LEFT JOIN e9 USING (act_symbol, rn)) z",
        extra=smoother("e12", "b", "log_close", 15, 12, "2.0 / 13") + ", " + smoother("e26", "b", "log_close", 1, 26, "2.0 / 27") + ", " + _LINE_CTE + ", " + smoother("e9", "l", "line", 26, 9, "2.0 / 10"), recursive=True)
_ATR = _CHANGES + ", " + smoother("a", "t", "tr", 2, 14, "1.0 / 14")
_WITH_ATR = "(SELECT b.*, a.v FROM b LEFT JOIN a USING (act_symbol, rn)) z"
feature("feat_atr", ask("ATR", 14, "raw"), "v", source=_WITH_ATR, extra=_ATR, recursive=True)
feature("feat_natr", ask("NATR", 14, "raw"), "100 * v / close", source=_WITH_ATR, extra=_ATR, recursive=True)
feature("feat_gap_sigma", ask("GAP_SIGMA", 14, "raw"), "(open - lag(close) OVER s) / nullif(lag(v) OVER s, 0)", source=_WITH_ATR, extra=_ATR, recursive=True)
_ADX = _CHANGES + """, dm AS (
  SELECT act_symbol, 14::BIGINT AS rn, sum(plus) AS p, sum(minus) AS m, sum(tr) AS q FROM t WHERE rn BETWEEN 2 AND 14 GROUP BY 1 HAVING count(*) = 13
  UNION ALL SELECT t.act_symbol, t.rn, d.p - d.p / 14 + t.plus, d.m - d.m / 14 + t.minus, d.q - d.q / 14 + t.tr FROM dm d JOIN t ON t.act_symbol = d.act_symbol AND t.rn = d.rn + 1),
di AS MATERIALIZED (SELECT act_symbol, rn, CASE WHEN q = 0 THEN 0 ELSE 100 * p / q END AS dp, CASE WHEN q = 0 THEN 0 ELSE 100 * m / q END AS dn FROM dm WHERE rn > 14),
dx AS MATERIALIZED (SELECT *, CASE WHEN dp + dn = 0 THEN 0 ELSE 100 * abs(dp - dn) / (dp + dn) END AS x FROM di), """ + smoother("ad", "dx", "x", 15, 14, "1.0 / 14")
_WITH_ADX = "(SELECT b.*, ad.v, dp, dn FROM b LEFT JOIN dx USING (act_symbol, rn) LEFT JOIN ad USING (act_symbol, rn)) z"
feature("feat_adx", ask("ADX", 14, "raw"), "v", source=_WITH_ADX, extra=_ADX, recursive=True)
feature("feat_adx_regime", ask("ADX_REGIME", 14, "raw"), "CASE WHEN v > 25 AND dp > dn THEN 1.0 WHEN v > 25 AND dn > dp THEN -1.0 ELSE 0.0 END", source=_WITH_ADX, extra=_ADX, recursive=True)

# The shell: derivatives, shifts, naming, calendar, cleaning.
feature("shell_velocity", ask("SMA", 5, "close", deriv_order=1), "v - lag(v) OVER s", 5, (f"{full('close', 5, 'avg(close)')} AS v",))
feature("shell_acceleration", ask("SMA", 5, "close", deriv_order=2, shift=-1), "lag(a) OVER s", 5, (f"{full('close', 5, 'avg(close)')} AS v", "v - 2 * lag(v) OVER s + lag(v, 2) OVER s AS a"))
feature("shell_lead", FeatureRequest("MOM", {"timeperiod": 5}, shift=3, input_type="close"), "lead(v, 3) OVER s", 1, ("close - lag(close, 5) OVER s AS v",))
for _part, _sql in (("month", "month(date)"), ("day", "day(date)"), ("dayofweek", "isodow(date) - 1"), ("quarter", "quarter(date)")):
    feature(f"calendar_{_part}", FeatureRequest(_part), f"({_sql})::DOUBLE")


def clean_prices(spark, sf_dir):
    out = prepare(P.bars(spark, sf_dir))
    return out.select("act_symbol", "date", *[r6(F.col(c)).alias(c) for c in ("log_close", "log_high", "log_low", "log_volume", "log_ret", "gap_size")], "close")


ENTRIES["clean_prices"] = (clean_prices, f"WITH {BASE} SELECT act_symbol, date, {', '.join(f'round({c} + 1e-8, 6) + 0.0 AS {c}' for c in ('log_close', 'log_high', 'log_low', 'log_volume', 'log_ret', 'gap_size'))}, close FROM b")

# Transforms by date.
_MOVE = ("close - lag(close, 5) OVER s AS v",)
_RANK = "CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY date, v) - 1) / 2.0) / count(v) OVER d END"
for _kind, _sql in (
    ("rank", _RANK), ("demean", "v - avg(v) OVER d"), ("cs_zscore", "(v - avg(v) OVER d) / nullif(stddev_samp(v) OVER d, 0)"),
    ("binary", "CASE WHEN v IS NOT NULL THEN (v > 0)::INT::DOUBLE END"), ("regime", "CASE WHEN v > 0.02 THEN 1.0 WHEN v < -0.02 THEN -1.0 WHEN v IS NOT NULL THEN 0.0 END"),
):
    feature(f"xs_{_kind}", FeatureRequest("MOM", {"timeperiod": 5}, input_type="close", alias="mom", transform=_kind), _sql, 1, _MOVE)

#: The flagship: liquidity by the spread, lagged a day and ranked.
LIQUIDITY = FeatureRequest("SPREAD_AR", {"timeperiod": 20}, shift=-1, input_type="raw", alias="liquidity", transform="rank")
feature("flagship_liquidity_rank", LIQUIDITY, _RANK, 20, (*_SPREAD, "CASE WHEN m IS NOT NULL THEN sqrt(greatest(0, m)) END AS x", "lag(x) OVER s AS v"))

#: The feature set of the documented study, in one compiled plan.
STUDY = [
    FeatureRequest("VOL_ZSCORE", {"timeperiod": 20}, -1, "raw", alias="volume"), LIQUIDITY,
    FeatureRequest("AUTOCORR", {"timeperiod": 20}, -1, "log_ret", alias="autocorr"), FeatureRequest("ZSCORE", {"timeperiod": 20}, -1, alias="zscore"),
    FeatureRequest("FWD_LOG_RET", {"timeperiod": 5}, 1, "raw", alias="target"),
]
_NEXT5 = "(PARTITION BY act_symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)"
_LAYERS = (
    _SPREAD[0] + f", lag(log_ret) OVER s AS x1, CASE WHEN count(log_ret) OVER {_NEXT5} = 5 THEN sum(log_ret) OVER {_NEXT5} END AS fwd",
    _SPREAD[1] + ", CASE WHEN x1 IS NOT NULL THEN log_ret END AS a1, CASE WHEN log_ret IS NOT NULL THEN x1 END AS c1",
    _SPREAD[2] + f""", (log_volume - {full('log_volume', 20, 'avg(log_volume)')}) / nullif({full('log_volume', 20, 'stddev_samp(log_volume)')}, 0) AS vz,
  {full('a1', 20, 'covar_samp(a1, c1)')} / nullif(sqrt({full('a1', 20, 'var_samp(a1)')} * {full('a1', 20, 'var_samp(c1)')}), 0) AS ac,
  (log_close - {full('log_close', 20, 'avg(log_close)')}) / nullif({full('log_close', 20, 'stddev_samp(log_close)')}, 0) AS zs""",
    "CASE WHEN m IS NOT NULL THEN sqrt(greatest(0, m)) END AS x",
    "lag(x) OVER s AS v, lag(vz) OVER s AS f0, lag(ac) OVER s AS f2, lag(zs) OVER s AS f3, lead(fwd) OVER s AS f4",
    f"{_RANK} AS f1",
)


def study_sql() -> str:
    """CTEs that end in ``study(act_symbol, date, f0 .. f4)``, unrounded."""
    ctes, last = ["WITH " + BASE], "b"
    for k, layer in enumerate(_LAYERS):
        ctes.append(f"s{k} AS (SELECT *, {layer} FROM {last} {windows(20)})")
        last = f"s{k}"
    return ",\n".join(ctes) + f",\nstudy AS (SELECT act_symbol, date, f0, f1, f2, f3, f4 FROM {last})"


STUDY_COLUMNS = [r.columns()[0] for r in STUDY]
STUDY_SQL = f"{study_sql()} SELECT act_symbol, date, " + ", ".join(f'round(f{k} + 1e-8, 6) + 0.0 AS "{c}"' for k, c in enumerate(STUDY_COLUMNS)) + " FROM study"
ENTRIES["study_features"] = (lambda spark, sf_dir: computed(spark, sf_dir, *STUDY), STUDY_SQL)
#: A year of daily rows a block, so that no symbol is bound to one task.
BLOCK_ROWS = 256
ENTRIES["study_features_blocks"] = (lambda spark, sf_dir: computed(spark, sf_dir, *STUDY, block_rows=BLOCK_ROWS), STUDY_SQL)
ENTRIES["feat_adx_blocks"] = (lambda spark, sf_dir: computed(spark, sf_dir, ask("ADX", 14, "raw"), block_rows=BLOCK_ROWS), ENTRIES["feat_adx"][1])
