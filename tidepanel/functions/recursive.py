"""Recursive smoothers as scans, see :mod:`tidepanel.functions.scans`.

Seeds: an exponential average starts with the mean of its first n values; Wilder averages with the mean of the first n
changes; directional sums with n - 1 terms, smoothed from then on.  Rows before a seed are null; after a null on input
all further results of the symbol are null.  ``stage`` also has ``first``, the place of a symbol's first value,
``scan``, and ``together`` for what shares layers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions.windows import lag


def smooth(x: Column, n: int, rate: float, stage, begin: Column | None = None) -> Column:
    """y = y + rate (x - y), from the mean of n values on."""
    (x,) = stage(x)
    begin = stage.first(x) if begin is None else begin
    return stage.scan(x, begin, n, 1 - rate, rate, 1 / n)


def ema(x, n, stage, begin: Column | None = None):
    return smooth(x, n, 2 / (n + 1), stage, begin)


def wilder(x, n, stage):
    return smooth(x, n, 1 / n, stage)


def rsi(x, n, stage):
    (d,) = stage(x - lag(x))
    rises, falls = F.when(d > 0, d).when(d <= 0, 0.0), F.when(d < 0, -d).when(d >= 0, 0.0)
    up, down = stage.together(lambda s: wilder(rises, n, s), lambda s: wilder(falls, n, s))
    return F.when(up + down == 0, 0.0).otherwise(100 * F.try_divide(up, up + down))


def macd(x, n, stage, fast: int = 12, slow: int = 26, signal: int = 9):
    """Both averages' first values fall on the same row; all outputs begin with the signal."""
    (x,) = stage(x)
    begin = stage.first(x)
    short, long = stage.together(lambda s: ema(x, fast, s, begin + (slow - fast)), lambda s: ema(x, slow, s, begin))
    (line,) = stage(short - long)
    s = ema(line, signal, stage)
    return F.when(s.isNotNull(), line), s, line - s


def true_range(high, low, close) -> Column:
    before = lag(close)
    whole = F.greatest(high - low, F.abs(high - before), F.abs(low - before))
    return F.when(high.isNotNull() & low.isNotNull() & before.isNotNull(), whole)


def atr(high, low, close, n, stage):
    return wilder(true_range(high, low, close), n, stage)


def natr(high, low, close, n, stage):
    return 100 * F.try_divide(atr(high, low, close, n, stage), close)


def directional(high, low, close, n, stage) -> tuple[Column, Column, Column]:
    """ADX, +DI and -DI."""
    up, down = high - lag(high), lag(low) - low
    part = lambda a, b: F.when((a > b) & (a > 0), a).otherwise(0.0)
    plus, minus, tr = stage(part(up, down), part(down, up), true_range(high, low, close))
    # The seed is a plain sum of n - 1 terms, and results begin a row after it.
    p, m, t = stage.together(*[lambda s, v=v: s.scan(v, F.lit(1), n - 1, 1 - 1 / n, 1.0, 1.0, 1) for v in (plus, minus, tr)])
    a, b = (F.when(t == 0, 0.0).otherwise(100 * F.try_divide(v, t)) for v in (p, m))
    a, b = stage(F.when(t.isNotNull(), a), F.when(t.isNotNull(), b))
    dx = F.when(a + b == 0, 0.0).otherwise(100 * F.try_divide(F.abs(a - b), a + b))
    return wilder(dx, n, stage), a, b


def adx(high, low, close, n, stage):
    return directional(high, low, close, n, stage)[0]


def adx_regime(high, low, close, n, stage, threshold: float = 25.0):
    """1 or -1 while the trend is strong, by its direction; 0 else, warm-up rows included."""
    a, p, m = directional(high, low, close, n, stage)
    strong = F.coalesce(a > threshold, F.lit(False))
    return F.when(strong & (p > m), 1.0).when(strong & (m > p), -1.0).otherwise(0.0)


def gap_sigma(open_, high, low, close, n, stage):
    """The opening gap by the last bar's average true range."""
    (a,) = stage(atr(high, low, close, n, stage))
    return F.try_divide(open_ - lag(close), lag(a))
