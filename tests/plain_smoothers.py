"""Plain loops of the recursive smoothers: numpy kernels for one symbol's ordered series.

Seeds: an exponential average starts with the mean of its first n values; Wilder averages with the mean of the first n
changes; directional sums with n - 1 terms, smoothed from then on.  Rows before a seed are NaN, nulls on input are NaN.
"""

from __future__ import annotations

import numpy as np


def _blank(n: int) -> np.ndarray:
    return np.full(n, np.nan)


def _first(x: np.ndarray) -> int:
    ok = np.flatnonzero(~np.isnan(x))
    return int(ok[0]) if len(ok) else len(x)


def smooth(x: np.ndarray, n: int, alpha: float, begin: int | None = None) -> np.ndarray:
    """y = y + alpha (x - y), from the mean of n values on."""
    out = _blank(len(x))
    a = _first(x) if begin is None else begin
    if a + n > len(x):
        return out
    y = x[a : a + n].mean()
    out[a + n - 1] = y
    for i in range(a + n, len(x)):
        y += alpha * (x[i] - y)
        out[i] = y
    return out


def ema(x: np.ndarray, n: int, begin: int | None = None) -> np.ndarray:
    return smooth(x, n, 2 / (n + 1), begin)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 1 / n)


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    d = np.diff(x, prepend=np.nan)
    up, down = wilder(np.where(np.isnan(d), d, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), d, np.maximum(-d, 0)), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(up + down == 0, np.where(np.isnan(up), np.nan, 0.0), 100 * up / (up + down))


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both averages' first values fall on the same row; all outputs begin with the signal."""
    a = _first(x)
    line = ema(x, fast, a + slow - fast) - ema(x, slow, a)
    s = ema(line, signal)
    line = np.where(np.isnan(s), np.nan, line)
    return line, s, line - s


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate(([np.nan], close[:-1]))
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    return wilder(true_range(high, low, close), n)


def natr(high, low, close, n):
    return 100 * atr(high, low, close, n) / close


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX, +DI and -DI."""
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    tr = true_range(high, low, close)
    size = len(close)
    di_plus, di_minus, dx = _blank(size), _blank(size), _blank(size)
    if size <= n:
        return _blank(size), di_plus, di_minus
    p, m, t = plus[1:n].sum(), minus[1:n].sum(), tr[1:n].sum()
    for i in range(n, size):
        p, m, t = p - p / n + plus[i], m - m / n + minus[i], t - t / n + tr[i]
        a, b = (100 * p / t, 100 * m / t) if t else (0.0, 0.0)
        di_plus[i], di_minus[i] = a, b
        dx[i] = 100 * abs(a - b) / (a + b) if a + b else 0.0
    return wilder(dx, n), di_plus, di_minus


def adx(high, low, close, n):
    return directional(high, low, close, n)[0]


def adx_regime(high, low, close, n, threshold: float = 25.0):
    """1 or -1 while the trend is strong, by its direction; 0 else, warm-up rows included."""
    a, p, m = directional(high, low, close, n)
    strong = np.nan_to_num(a) > threshold
    return np.where(strong & (p > m), 1.0, np.where(strong & (m > p), -1.0, 0.0))


def gap_sigma(open_, high, low, close, n):
    """The opening gap by the last bar's average true range."""
    before = lambda x: np.concatenate(([np.nan], x[:-1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (open_ - before(close)) / before(atr(high, low, close, n))
    return np.where(np.isfinite(out), out, np.nan)
