"""Scans, projections, sinks, and joins and sets of the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.base import BARS, BASE, ETFS, MARKET, r6
from tidepanel.catalog.fundamentals import CAL, ST
from tidepanel.functions import windows as R
from tidepanel.operators import selection
from tidepanel.operators.asof import asof
from tidepanel.plans.features import Layers, join_market, listing, prepare
from tidepanel.sources import io, scratch
from tidepanel.sources import panel as P
from tidepanel.sources import scans as S
from tidepanel.streaming.bars import minute_bars

COLS = "act_symbol, date, open, high, low, close, volume"
ENTRIES = {
    "scan_bars": (lambda s, d: P.bars(s, d), f"WITH {BARS} SELECT {COLS} FROM bars"),
    "scan_single": (lambda s, d: S.single(P.bars(s, d), "S000003", "1995-01-01", "1997-01-01"), f"WITH {BARS} SELECT {COLS} FROM bars WHERE act_symbol = 'S000003' AND date > DATE '1995-01-01' AND date < DATE '1997-01-01'"),
    "scan_batch": (lambda s, d: S.batch(P.bars(s, d), ["S000001", "S000002", "S000005"], "1994-01-01", "1996-06-01"), f"WITH {BARS} SELECT {COLS} FROM bars WHERE act_symbol IN ('S000001', 'S000002', 'S000005') AND date >= DATE '1994-01-01' AND date < DATE '1996-06-01'"),
    "scan_etfs": (lambda s, d: S.etfs(P.symbols(s, d)), f"WITH {ETFS} SELECT act_symbol FROM etfs"),
    "scan_symbol_info": (lambda s, d: S.info(P.symbols(s, d), "S000010"), "SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS act_symbol, CASE WHEN s_suppkey % 10 = 0 THEN '1' ELSE '0' END AS is_etf FROM supplier WHERE s_suppkey = 10"),
    "scan_last_year": (lambda s, d: S.last_year(P.bars(s, d), P.symbols(s, d), 1997, 3), f"WITH {BARS}, {ETFS} SELECT {COLS} FROM bars ANTI JOIN etfs USING (act_symbol) WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-03-01'"),
    "scan_latest_minute": (lambda s, d: S.latest(P.ticks(s, d)), "WITH m AS (SELECT event_type AS ticker, date_trunc('minute', ts) AS start, first(value ORDER BY ts, event_id) AS open FROM events GROUP BY 1, 2) SELECT ticker, arg_max(open, start) AS open, max(start) AS start FROM m GROUP BY 1"),
    "minute_bars": (lambda s, d: minute_bars(P.ticks(s, d)), "SELECT event_type AS ticker, date_trunc('minute', ts) AS start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY 1, 2"),
    "distinct_symbols": (lambda s, d: P.bars(s, d).agg(F.countDistinct("act_symbol").alias("n_symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n")), f"WITH {BARS} SELECT count(DISTINCT act_symbol) AS n_symbols, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM bars"),
    "rename_select": (lambda s, d: P.bars(s, d).select("act_symbol", "date", F.col("close").alias("Close/Last")), f'WITH {BARS} SELECT act_symbol, date, close AS "Close/Last" FROM bars'),
    "date_range": (lambda s, d: P.bars(s, d).where(F.col("date").between("1996-01-01", "1996-12-31")), f"WITH {BARS} SELECT {COLS} FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    "drop_incomplete": (lambda s, d: prepare(P.bars(s, d)).na.drop(subset=["log_ret", "gap_size"]).select("act_symbol", "date", r6(F.col("log_ret")).alias("log_ret")), f"WITH {BASE} SELECT act_symbol, date, round(log_ret + 1e-8, 6) + 0.0 AS log_ret FROM b WHERE log_ret IS NOT NULL AND gap_size IS NOT NULL"),
    "isin_filter": (lambda s, d: P.bars(s, d).where(F.col("act_symbol").isin("S000004", "S000007")), f"WITH {BARS} SELECT {COLS} FROM bars WHERE act_symbol IN ('S000004', 'S000007')"),
    "smallest_closes": (lambda s, d: P.bars(s, d).orderBy("close", "act_symbol", "date").limit(20), f"WITH {BARS} SELECT {COLS} FROM bars ORDER BY close, act_symbol, date LIMIT 20"),
    "sorted_panel": (lambda s, d: P.bars(s, d).orderBy("act_symbol", "date"), f"WITH {BARS} SELECT {COLS} FROM bars ORDER BY act_symbol, date"),
    "join_anti_etfs": (lambda s, d: S.without(P.bars(s, d), S.etfs(P.symbols(s, d))), f"WITH {BARS}, {ETFS} SELECT {COLS} FROM bars ANTI JOIN etfs USING (act_symbol)"),
    "join_semi_symbols": (lambda s, d: P.bars(s, d).join(S.etfs(P.symbols(s, d)), "act_symbol", "left_semi"), f"WITH {BARS}, {ETFS} SELECT {COLS} FROM bars SEMI JOIN etfs USING (act_symbol)"),
    "union_months": (lambda s, d: P.bars(s, d).where("month(date) <= 6").unionByName(P.bars(s, d).where("month(date) > 6")), f"WITH {BARS} SELECT {COLS} FROM bars"),
    "union_all_months": (lambda s, d: P.bars(s, d).where("date < '1995-01-01'").unionByName(P.bars(s, d).where("date >= '1995-01-01' and date < '1998-01-01'")).unionByName(P.bars(s, d).where("date >= '1998-01-01'")), f"WITH {BARS} SELECT {COLS} FROM bars"),
    "set_intersect_dates": (lambda s, d: P.bars(s, d).where("act_symbol = 'S000001'").select("date").intersect(P.bars(s, d).where("act_symbol = 'S000002'").select("date")), f"WITH {BARS} SELECT date FROM bars WHERE act_symbol = 'S000001' INTERSECT SELECT date FROM bars WHERE act_symbol = 'S000002'"),
    "keep_last_by_key": (lambda s, d: P.bars(s, d).groupBy("act_symbol", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close")), f"WITH {BARS} SELECT act_symbol, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close FROM bars GROUP BY 1, 2"),
}


def market_joined(s, d):
    b = P.bars(s, d)
    out = join_market(prepare(b), "MKT", P.market(b))
    return out.select("act_symbol", "date", r6(F.col("MKT_MKT_RET")).alias("MKT_MKT_RET"))


ENTRIES["join_market"] = (market_joined, f"WITH {BARS}, {MARKET} SELECT act_symbol, date, round(mkt + 1e-8, 6) + 0.0 AS MKT_MKT_RET FROM bars LEFT JOIN mk USING (date)")


def market_of_days(s, d):
    """A reference with many rows a day, of which the last order's counts."""
    series = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") - 0.05).alias("log_ret"))
    out = join_market(P.bars(s, d), "DAY", series, order=("date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return out.select("act_symbol", "date", r6(F.col("MKT_DAY_RET")).alias("MKT_DAY_RET"))


ENTRIES["join_market_last_of_day"] = (market_of_days, f"""WITH {BARS}, k AS (SELECT l_shipdate::DATE AS date, l_discount - 0.05 AS v,
  row_number() OVER (PARTITION BY l_shipdate::DATE ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_discount DESC) AS r FROM lineitem)
SELECT act_symbol, bars.date, round(v + 1e-8, 6) + 0.0 AS MKT_DAY_RET FROM bars LEFT JOIN k ON k.date = bars.date AND r = 1""")


def through_feather(s, d):
    """All bars written as a Feather table; two columns of those with a high close read again."""
    path = scratch.fresh(s, "bars.feather")
    io.save(P.bars(s, d), path)
    return io.feather(s, path, ["act_symbol", "date", "close"]).where("close >= 1500").select("act_symbol", "date")


ENTRIES["scan_feather"] = (through_feather, f"WITH {BARS} SELECT act_symbol, date FROM bars WHERE close >= 1500")

#: The shares of a heavy day.
HEAVY = 60


def asof_case(forward: bool):
    """Each bar with the last (or next) day on which its symbol traded heavily."""

    def run(s, d):
        b = P.bars(s, d)
        right = b.where(F.col("volume") >= HEAVY).select("act_symbol", F.col("date").alias("other"), F.col("volume").alias("other_volume"))
        return asof(b.select("act_symbol", "date", "close"), right, "date", "other", forward=forward, payload={"other": "other", "other_volume": "other_volume"})

    sign = "<=" if forward else ">="
    sql = f"""WITH {BARS}, r AS (SELECT act_symbol, date AS other, volume AS other_volume FROM bars WHERE volume >= {HEAVY})
SELECT l.act_symbol, l.date, l.close, r.other, r.other_volume FROM bars l ASOF LEFT JOIN r ON l.act_symbol = r.act_symbol AND l.date {sign} r.other"""
    return run, sql


ENTRIES["join_asof_backward"] = asof_case(False)
ENTRIES["join_asof_forward"] = asof_case(True)


def released(forward: bool, period: str | None = None):
    """Whole tables: the last release of every bar, or (``forward``) the next release of every statement."""

    def run(s, d):
        st = P.statements(s, d)
        left = st.select("act_symbol", "date", "sales") if forward else P.bars(s, d).select("act_symbol", "date", "close")
        return asof(left, P.calendar(st).withColumnRenamed("date", "other"), "date", "other", forward=forward, payload={"other": "other"}, period=period)

    left, value, sign = ("st", "sales", "<=") if forward else ("bars", "close", ">=")
    return run, f"""WITH {BARS}, {ST}, {CAL}
SELECT l.act_symbol, l.date, l.{value}, r.date AS other FROM {left} l ASOF LEFT JOIN cal r ON l.act_symbol = r.act_symbol AND l.date {sign} r.date"""


ENTRIES["join_asof_releases_backward"] = released(False)
ENTRIES["join_asof_releases_forward"] = released(True)
ENTRIES["join_asof_releases_backward_months"] = released(False, "month")
ENTRIES["join_asof_releases_forward_months"] = released(True, "month")


def sums_of_30(s, d):
    layers = Layers()
    r30 = R.total(F.col("log_ret"), 30, layers.stage())
    return layers.applied(prepare(P.bars(s, d)), None).select(r30.alias("r30"))


def quantiles_of_sums(s, d):
    x, at = scratch.written(sums_of_30(s, d), "sums"), (0.05, 0.5, 0.95)
    found = selection.quantiles(x, "r30", list(at))
    known = [r6(F.lit(v).cast("double")).alias(f"p{int(q * 100)}") for q, v in zip(at, found, strict=True)]
    return x.agg(F.avg("r30").alias("mean"), F.stddev_pop("r30").alias("sd")).select(*known, r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


ENTRIES["quantiles_of_sums"] = (
    quantiles_of_sums,
    f"WITH {BASE}, x AS (SELECT CASE WHEN count(log_ret) OVER w = 30 THEN sum(log_ret) OVER w END AS r30 FROM b WINDOW w AS (PARTITION BY act_symbol ORDER BY date ROWS 29 PRECEDING)) SELECT "
    + ", ".join(f"round(quantile_cont(r30, {q}) + 1e-8, 6) + 0.0 AS p{int(q * 100)}" for q in (0.05, 0.5, 0.95)) + ", round(avg(r30) + 1e-8, 6) + 0.0 AS mean, round(stddev_pop(r30) + 1e-8, 6) + 0.0 AS sd FROM x",
)
ENTRIES["feature_registry"] = (lambda s, d: listing(s), None)
