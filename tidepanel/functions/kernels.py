"""Feature kernels as staged column expressions.

A kernel gets its inputs' columns, the period and ``stage``, which turns expressions into columns of an earlier layer
(Spark allows no window in a window); layers of all requests are merged, so they share sorts and exchanges.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions import windows as R
from tidepanel.functions.windows import by_symbol, lag

Stage = Callable[..., tuple[Column, ...]]


def zscore(x, n, stage):
    return R.standard(x, n, stage)


def volume_zscore(volume, n, stage):
    (x,) = stage(F.ln(F.when(volume > 0, volume)))
    return R.standard(x, n, stage)


def abdi_ranaldo(high, low, close, n, stage):
    """The two-day spread estimator from close, high and low (Abdi and Ranaldo 2017)."""
    (h, l, c) = (F.ln(F.when(v > 0, v)) for v in (high, low, close))
    eta, c = stage((h + l) / 2, c)
    c1 = lag(c)
    (p,) = stage(4 * (c1 - lag(eta)) * (c1 - eta))
    m = R.mean(p, n, stage)
    return F.when(m.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), m)))


def crossover(close, n, stage):
    return F.coalesce((close >= R.mean(close, n, stage)).cast("double"), F.lit(0.0))


def hurst(x, n, stage):
    """Rescaled range over n differences: ln(range of the centred cumulative sum / deviation) / ln n."""
    (d,) = stage(x - lag(x))
    gathered, m, s = stage(R.full(n, d, F.collect_list(d)), R.mean(d, n), R.deviation(d, n))
    walk = F.aggregate(
        gathered, F.struct(F.lit(0.0).alias("z"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo")),
        lambda a, v: F.struct((a["z"] + v - m).alias("z"), F.greatest(a["hi"], a["z"] + v - m).alias("hi"), F.least(a["lo"], a["z"] + v - m).alias("lo")),
    )
    (r,) = stage(walk)
    return F.ln(F.try_divide(r["hi"] - r["lo"], F.when(s == 0, 1e-9).otherwise(s))) / F.ln(F.lit(float(n)))


def autocorrelation(x, n, stage):
    x1, x2 = stage(lag(x), x)
    va, vb, cov = R.products(x2, x1, n, stage)
    return F.try_divide(cov, F.sqrt(va * vb)) if n > 1 else F.lit(None).cast("double")


def beta(x, market, n, stage):
    _, v, cov = R.products(x, market, n, stage)
    return F.try_divide(cov, v) if n > 1 else F.lit(None).cast("double")


def vwap_z(close, volume, n, stage):
    (pv,) = stage(close * volume)
    return F.try_divide(close - F.try_divide(R.total(pv, n, stage), R.total(volume, n, stage)), R.deviation(close, n, stage))


def range_efficiency(open_, high, low, close, n, stage):
    return F.try_divide(F.abs(close - open_), high - low)


def relative_range(high, low, n, stage):
    (r,) = stage(high - low)
    return F.try_divide(r, R.mean(r, n, stage))


def forward_sharpe(close, n, stage):
    (r,) = stage(F.ln(F.try_divide(close, lag(close))))
    return F.try_divide(R.full(n, r, F.sum(r), R.ahead), R.full(n, r, F.stddev_samp(r), R.ahead) + 1e-6)


def intraday(open_, close, n, stage):
    return F.ln(F.when((open_ > 0) & (close > 0), close / open_))


def forward_return(close, n, stage):
    (r,) = stage(F.ln(F.try_divide(close, lag(close))))
    return R.total(r, n, stage, -1)


def momentum(x, n, stage):
    return x - lag(x, n)


def rate_of_change(x, n, stage):
    return 100 * (F.try_divide(x, lag(x, n)) - 1)


def moving_average(x, n, stage):
    return R.mean(x, n, stage)


def _line(x, n, stage):
    (i,) = stage(F.row_number().over(by_symbol()).cast("double"))
    return stage(R.full(n, x, F.regr_slope(x, i)), R.mean(x, n))


def slope(x, n, stage):
    return _line(x, n, stage)[0]


def angle(x, n, stage):
    return F.atan(_line(x, n, stage)[0]) * (180 / pi)


def forecast(x, n, stage):
    """The regression line of n values, one step on."""
    s, m = _line(x, n, stage)
    return m + s * (n - (n - 1) / 2)


def bollinger(x, n, stage, up: float = 2.0, down: float = 2.0):
    m, s = stage(R.mean(x, n), R.full(n, x, F.stddev_pop(x)))
    return m + up * s, m, m - down * s


def percent_b(x, n, stage):
    """Where the value lies between its bands, and the bands' width by their middle."""
    u, m, l = bollinger(x, n, stage)
    return F.try_divide(x - l, u - l), F.try_divide(u - l, m)


def stochastic(high, low, close, n, stage, fastk: int = 5, slowk: int = 3, slowd: int = 3):
    hi, lo = stage(R.full(fastk, high, F.max(high)), R.full(fastk, low, F.min(low)))
    (k,) = stage(100 * F.try_divide(close - lo, hi - lo))
    (slow,) = stage(R.mean(k, slowk))
    return slow, R.mean(slow, slowd)


def regression_beta(x, y, n, stage):
    """The slope of the changes of x on those of y, each as a part of its last value."""
    dx, dy = stage(F.try_divide(x, lag(x)) - 1, F.try_divide(y, lag(y)) - 1)
    return beta(dx, dy, n, stage)
