"""Statistics of all months from one symbol's arrays, against plain loops."""

import datetime as dt

import numpy as np
import pytest

from tidepanel.catalog import entries
from tidepanel.plans import universe as U


def test_windows_match_plain_loops():
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, 120)
    x[40:70], x[[3, 30, 31, 90]] = 0.1, np.nan
    begin, end = np.array([0, 1, 20, 41, 80, 119]), np.array([60, 2, 120, 69, 95, 120])
    w = U.Windows(begin, end)
    for k in (0, 1, 2, 19):
        want = [np.nanstd(x[b + k : e]) if (~np.isnan(x[b + k : e])).any() else np.nan for b, e in zip(begin, end, strict=True)]
        np.testing.assert_allclose(w.deviation(x, k), want, rtol=1e-9, atol=1e-12)
    assert w.deviation(x, 2)[3] == 0.0  # equal values, not about 0
    np.testing.assert_allclose(w.mean(x), [np.nanmean(x[b:e]) for b, e in zip(begin, end, strict=True)])
    assert list(w.last(x)) == [0.1, x[1], x[119], 0.1, x[94], x[119]]
    assert np.isnan(U.Windows(np.array([30]), np.array([32])).last(x)[0])


def test_months_from_one_pass_over_bars(spark):
    """Bars were unfolded twelve times into 20 deviations, after 38 lags."""
    rng, day = np.random.default_rng(2), dt.date(2020, 1, 31)
    days = [day + dt.timedelta(days=int(i)) for i in np.sort(rng.choice(900, 420, replace=False))]
    rows = [(s, d, None if rng.random() < 0.02 else float(c), 2.0) for s in "AB" for d, c in zip(days, rng.uniform(5, 9, 420), strict=True)]
    panel = spark.createDataFrame(rows + [("C", days[7], None, 1.0)], "act_symbol string, date date, close double, volume double").repartition(3)
    out = U.yearly_stats(panel, U.months(panel))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Window" not in plan
    got = {(r.act_symbol, r.target): r for r in out.collect()}
    months = sorted({d.replace(day=1) for d in days})
    seen = 0
    for target in (t for t in months if t > days[0]):
        start = target.replace(year=target.year - 1)
        for s in "ABC":
            c = [(d, v) for n, d, v, _ in rows + [("C", days[7], None, 1.0)] if n == s and start <= d < target]
            if not c:
                assert (s, target) not in got
                continue
            r, close = got[s, target], np.array([np.nan if v is None else v for _, v in c])
            seen += 1
            assert r.history_days == len(c) and (r.last_price is None) == np.isnan(close[-1])
            if len(c) < 30:
                assert r.volatility is None and r.hurst is None and not r.uptrend
                continue
            assert r.volatility == pytest.approx(np.nanstd(np.log(close[1:] / close[:-1])) * 252**0.5)
            tau = [np.sqrt(np.nanstd(close[k:] - close[:-k])) for k in U.LAGS]
            assert r.hurst == pytest.approx(np.polyfit(np.log(list(U.LAGS)), np.log(tau), 1)[0])
            assert r.uptrend == bool(len(c) >= 200 and close[-1] > np.nanmean(close[-200:]))
            assert r.year_return is None if np.isnan(close[0] + close[-1]) else r.year_return == pytest.approx(close[-1] / close[0] - 1)
    assert seen > 60 and len(got) == seen


def test_trades_are_dealt_once_for_members_and_rows(spark, sf):
    """Filters on null keys lay below one of two exchanges of the same trades, so both were made."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entries()["univ_all_months"][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange [act_symbol" in plan and "at#" in plan.split("ReusedExchange [act_symbol", 1)[1].split("\n")[0]
