"""Recursive smoothers as scans against plain loops, and feature plans with symbols dealt to several tasks."""

import datetime as dt

import numpy as np
import plain_smoothers as N
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scans
from tidepanel.plans import features as P

DAY = dt.date(2020, 1, 1)
PRICES = ("open", "high", "low", "close")


def panel(seed=0, n=700, holes=(), leading=0, flat=()):
    """Prices of three symbols: plain, with missing rows, and one that stands still for long."""
    rng = np.random.default_rng(seed)
    out = {}
    for name in "ABC":
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        if name == "C":
            for a, b in flat:
                close[a:b] = close[a]
        o, spread = close * np.exp(rng.normal(0, 0.01, n)), np.abs(rng.normal(0, 0.01, n))
        if name == "C":
            for a, b in flat:
                o[a:b], spread[a:b] = close[a:b], 0
        x = {"open": o, "close": close, "high": np.maximum(o, close) * (1 + spread), "low": np.minimum(o, close) * (1 - spread)}
        if name == "B":
            for c in PRICES:
                x[c][:leading] = np.nan
                x[c][list(holes)] = np.nan
        out[name] = x
    return out


def table(spark, p):
    rows = [(s, DAY + dt.timedelta(days=i), *[None if np.isnan(x[c][i]) else float(x[c][i]) for c in PRICES], 1.0) for s, x in p.items() for i in range(len(x["close"]))]
    return spark.createDataFrame(rows, "act_symbol string, date date, open double, high double, low double, close double, volume double")


def asked(name, n=None, x="raw", **params):
    return P.FeatureRequest(name, ({"timeperiod": n} if n else {}) | params, input_type=x, alias=name.lower() + str(n or ""))


REQUESTS = [
    (asked("EMA", 20, "close"), lambda o, h, l, c: N.ema(c, 20)), (asked("EMA", 1, "close"), lambda o, h, l, c: N.ema(c, 1)), (asked("EMA", 2, "close"), lambda o, h, l, c: N.ema(c, 2)),
    (asked("EMA", 150, "close"), lambda o, h, l, c: N.ema(c, 150)), (asked("RSI", 14), lambda o, h, l, c: N.rsi(c, 14)), (asked("MACD", x="close"), lambda o, h, l, c: N.macd(c)),
    (asked("ATR", 14), lambda o, h, l, c: N.atr(h, l, c, 14)), (asked("NATR", 5), lambda o, h, l, c: N.natr(h, l, c, 5)), (asked("ADX", 14), lambda o, h, l, c: N.adx(h, l, c, 14)),
    (asked("ADX_REGIME", 20), lambda o, h, l, c: N.adx_regime(h, l, c, 20)), (asked("GAP_SIGMA", 20), lambda o, h, l, c: N.gap_sigma(o, h, l, c, 20)),
]


@pytest.mark.parametrize("piece", [4, 256])
@pytest.mark.parametrize("blocks", [None, 64])
@pytest.mark.parametrize("kind", [{}, {"leading": 9, "holes": (400,)}, {"holes": (0, 3)}, {"flat": ((50, 680),)}, {"n": 18}])
def test_smoothers_match_plain_loops(spark, monkeypatch, piece, blocks, kind):
    monkeypatch.setattr(scans, "PIECE", piece)
    p = panel(3, **kind)
    got = P.FeatureEngine([r for r, _ in REQUESTS]).compute(table(spark, p), block_rows=blocks).orderBy("act_symbol", "date").toPandas()
    for s, x in p.items():
        mine = got[got.act_symbol == s]
        assert len(mine) == len(x["close"])
        for r, plain in REQUESTS:
            want = plain(*[x[c] for c in PRICES])
            for name, w in zip(r.columns(), want if isinstance(want, tuple) else (want,), strict=True):
                np.testing.assert_allclose(mine[name].to_numpy(float), np.where(np.isfinite(w), w, np.nan), rtol=1e-9, atol=1e-9, err_msg=f"{s} {name}")


@pytest.mark.parametrize("rows", [1, 40, 10_000])
def test_blocks_change_nothing(spark, rows):
    """Rolling windows, lags, leads, derivatives, transforms and staged scans, with blocks and without."""
    df = table(spark, panel(5, 300, holes=(120, 121))).withColumn("volume", F.abs(F.hash("date", "act_symbol") % 1000) + 1.0)
    market = df.where("act_symbol = 'A'").select("date", F.ln(F.col("close") / 100).alias("log_ret"))
    names = [n for n, f in P.REGISTRY.items() if f.kind == "window" and n != "TWICE"]
    wants = [P.FeatureRequest(n, {"timeperiod": 7} if P.REGISTRY[n].period else {}, -1, "close" if P.REGISTRY[n].inputs == ("real",) else "raw", alias=n) for n in names]
    wants += [P.FeatureRequest("SMA", {"timeperiod": 5}, 3, "close", alias="acc", deriv_order=2), P.FeatureRequest("MOM", {"timeperiod": 5}, -4, "close", alias="ranked", transform="rank"), P.FeatureRequest("month")]
    plain, cut = (P.FeatureEngine(wants).compute(df, market, b).orderBy("act_symbol", "date").toPandas() for b in (None, rows))
    assert list(plain.columns) == list(cut.columns) and len(plain) == len(cut) == 900
    for c in plain.columns[2:]:
        np.testing.assert_allclose(cut[c].to_numpy(float), plain[c].to_numpy(float), rtol=1e-7, atol=1e-9, err_msg=c)


def test_a_symbol_is_dealt_to_several_tasks(spark):
    df = table(spark, {"A": panel(1, 2000)["A"]})
    blocks = P.Blocks(256, 20, 0)
    dealt = blocks.lapped(blocks.placed(df))
    assert dealt.groupBy("_block").count().count() == 8 and dealt.count() == 2000 + 7 * 20
    assert blocks.own(dealt).count() == 2000
    assert [r._pos for r in blocks.own(dealt).orderBy("date").collect()] == list(range(2000))


def test_smoothers_have_no_python_worker(spark, sf):
    from tidepanel.catalog.features import ENTRIES

    for name in ("feat_ema", "feat_rsi", "feat_macd", "feat_atr", "feat_natr", "feat_adx", "feat_adx_regime", "feat_gap_sigma"):
        plan = ENTRIES[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan


def test_numpy_kernels_take_no_blocks(spark):
    P.register_feature("LAST_OF", ("close",), lambda x, n: np.full(len(x), x[-1]), 1, recursive=True)
    r = P.FeatureRequest("LAST_OF", input_type="raw", alias="last")
    df = table(spark, {"A": panel(1, 30)["A"]})
    assert len({x["last_T"] for x in P.FeatureEngine([r]).compute(df).collect()}) == 1
    with pytest.raises(ValueError):
        P.FeatureEngine([r]).compute(df, block_rows=10)
    del P.REGISTRY["LAST_OF"]


def test_blocks_write_little_and_move_rows_once(spark, monkeypatch):
    """ADX took five checkpoints of whole rows, and after each the rows were dealt anew, two times or three."""
    written, lapped = [], []
    dealt, lap = P.scratch.dealt, P.Blocks.lapped
    monkeypatch.setattr(P.scratch, "dealt", lambda df, *a: (written.append(df.columns), dealt(df, *a))[1])
    monkeypatch.setattr(P.Blocks, "lapped", lambda self, df: (lapped.append(1), lap(self, df))[1])
    df = table(spark, panel())
    got = P.FeatureEngine([asked("ADX", 14)]).compute(df, block_rows=256, keep=())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(written) == 2 and len(lapped) == 1 and not {"open", "volume", "log_close"} & {c for x in written for c in x}
    assert "Bucketed: true" in plan and got.columns == ["act_symbol", "date", "adx14_14d_T"]
    whole = P.FeatureEngine([asked("ADX", 14)]).compute(df).select(got.columns)
    for a, b in zip(got.orderBy("act_symbol", "date").collect(), whole.orderBy("act_symbol", "date").collect(), strict=True):
        assert a[:2] == b[:2] and (a[2] == pytest.approx(b[2]) if b[2] is not None else a[2] is None)
