"""Black-Scholes values as columns, and the covered-collar back-test as a grouped kernel."""

from __future__ import annotations

import contextlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of the normal distribution's approximation 26.2.17 in Abramowitz and Stegun (fixed values).
NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
NORMAL_P = 0.2316419


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, with an error below 7.5e-8."""
    a = F.abs(x)
    t = 1 / (1 + NORMAL_P * a)
    poly = F.lit(0.0)
    for c in reversed(NORMAL):
        poly = (poly + c) * t
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def d1(price, strike, rf, years, volatility) -> Column:
    return (F.ln(price / strike) + (rf + volatility * volatility / 2) * years) / (volatility * F.sqrt(years))


def d2(price, strike, rf, years, volatility) -> Column:
    return d1(price, strike, rf, years, volatility) - volatility * F.sqrt(years)


def call_value(price, strike, rf, years, volatility) -> Column:
    a = (price, strike, rf, years, volatility)
    return price * normal_cdf(d1(*a)) - strike * F.exp(-rf * years) * normal_cdf(d2(*a))


def put_value(price, strike, rf, years, volatility) -> Column:
    a = (price, strike, rf, years, volatility)
    return strike * F.exp(-rf * years) * normal_cdf(-d2(*a)) - price * normal_cdf(-d1(*a))


def contract_return(open_: Column, close: Column, length: int) -> Column:
    from tidepanel.functions.windows import total

    return total(F.ln(close / open_), length)


def realised(log_ret: Column, lookback: int = 30, annualise: bool = False) -> Column:
    from tidepanel.functions.windows import deviation

    return deviation(log_ret, lookback) * (math.sqrt(252) if annualise else 1.0)


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


#: Degrees of freedom that a fit may have, and how many are tried at once.
FREEDOM, TRIED = (1.0, 1e4), 9


def t_log_likelihood(x: np.ndarray, v, m, s) -> np.ndarray:
    """Of a Student t with degrees ``v``, place ``m`` and scale ``s``, each a number or a column of them."""
    v, m, s = (np.atleast_1d(np.asarray(a, float)) for a in (v, m, s))
    norm = np.array([math.lgamma((k + 1) / 2) - math.lgamma(k / 2) for k in v]) - 0.5 * np.log(v * math.pi) - np.log(s)
    z = (x[None, :] - m[:, None]) / s[:, None]
    return len(x) * norm - ((v[:, None] + 1) / 2 * np.log1p(z * z / v[:, None])).sum(axis=1)


def students_t(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximum-likelihood degrees of freedom, place and scale of each row of a matrix.

    For given degrees, expectation-maximisation finds place and scale; the degrees are searched on a grid of their
    logarithms that is narrowed around its best point until it is known to about a thousandth.
    """
    x = np.asarray(x, float)
    count = x.shape[1]
    least, most = np.log(FREEDOM)
    lo, hi = np.full(len(x), least), np.full(len(x), most)
    best = np.stack([np.full(len(x), -math.inf), np.full(len(x), 30.0), np.median(x, axis=1), np.maximum(x.std(axis=1), 1e-9)])
    open_, rounds = np.arange(len(x)), 40
    while len(open_):
        # By value, degrees tried and sample: sums run over the first axis, and all inner loops are long.
        y = np.ascontiguousarray(x[open_].T)[:, None, :]
        v = np.exp(np.linspace(lo[open_], hi[open_], TRIED))
        m, s2 = (np.repeat(c[None, open_], TRIED, axis=0) for c in (best[2], best[3] ** 2))
        d2 = (y - m) ** 2
        u, t = np.empty_like(d2), np.empty_like(d2)
        for _ in range(rounds):
            np.divide(v + 1, np.add(np.divide(d2, s2, out=u), v, out=u), out=u)
            m = np.multiply(u, y, out=t).sum(axis=0) / u.sum(axis=0)
            np.square(np.subtract(y, m, out=d2), out=d2)
            s2 = np.maximum(np.multiply(u, d2, out=t).sum(axis=0) / count, 1e-18)
        rounds = 12  # from the best fit so far
        norm = np.array([math.lgamma((k + 1) / 2) - math.lgamma(k / 2) for k in v.ravel()]).reshape(v.shape) - 0.5 * np.log(v * math.pi * s2)
        like = count * norm - (v + 1) / 2 * np.log1p(d2 / s2 / v).sum(axis=0)
        k, row = like.argmax(axis=0), np.arange(len(open_))
        found = np.stack([a[k, row] for a in (like, v, m, np.sqrt(s2))])
        better = found[0] > best[0, open_]
        best[:, open_[better]] = found[:, better]
        step = (hi[open_] - lo[open_]) / (TRIED - 1)
        near = np.log(found[1])
        lo[open_], hi[open_] = np.maximum(least, near - step), np.minimum(most, near + step)
        open_ = open_[step >= 1e-3]
    return best[1], best[2], best[3]


def student_t(x: np.ndarray) -> tuple[float, float, float]:
    """The fit of one sample; see :func:`students_t`."""
    v, m, s = students_t(np.asarray(x, float)[None, :])
    return float(v[0]), float(m[0]), float(s[0])


#: Places and weights of Gauss and Legendre on 0 to 1.
_NODES, _WEIGHTS = (lambda x, w: ((x + 1) / 2, w / 2))(*np.polynomial.legendre.leggauss(32))


def students_t_quantile(q: float, v: np.ndarray) -> np.ndarray:
    """For each of the degrees, from the density's integral: x = sqrt(v) tan(a) makes it smooth on a finite range.

    The integral of cos(a) ** (v - 1) is concave, so Newton's steps from 0 come to the angle from below.
    """
    v = np.asarray(v, float)
    if q < 0.5:
        return -students_t_quantile(1 - q, v)
    half = np.array([math.exp(math.lgamma(k / 2) - math.lgamma((k + 1) / 2)) for k in v]) * math.sqrt(math.pi) / 2
    aim, a = (2 * q - 1) * half, np.zeros(len(v))
    for _ in range(200):
        area = a * (np.cos(a[:, None] * _NODES) ** (v[:, None] - 1) @ _WEIGHTS)
        step = (aim - area) / np.cos(a) ** (v - 1)
        a = np.clip(a + step, 0.0, math.pi / 2)
        if not (np.abs(step) > 1e-14 + 1e-13 * a).any():
            break
    return np.sqrt(v) * np.tan(a)


def student_t_quantile(q: float, v: float) -> float:
    return float(students_t_quantile(q, np.array([v]))[0])


COLLAR = "act_symbol string, date date, close double, principal double, call_profit double, put_profit double, call_strike double, put_strike double"
RATE, DAYS, LOT, GRID = 0.06, 30, 100, 0.5
#: Fits made at once, and rows of the symbols whose fits may meet.
FITS, ROWS = 64, 50_000


def _black_scholes(price: float, strike: float, years: float, sigma: float) -> tuple[float, float]:
    """Call and put."""
    a = (math.log(price / strike) + (RATE + sigma * sigma / 2) * years) / (sigma * math.sqrt(years))
    b = a - sigma * math.sqrt(years)
    now = strike * math.exp(-RATE * years)
    return price * _phi(a) - now * _phi(b), now * _phi(-b) - price * _phi(-a)


def collar(df: DataFrame, call_threshold: float = 0.8, put_threshold: float = 0.2, window: int = 60) -> DataFrame:
    """The covered collar of each symbol, row by row in the order of dates; profits are running totals.

    The first ``window`` rows set the principal to the bare open and hold nothing.  From then on the state is:

    * Without a contract, one is opened: a Student t is fitted to the ``window`` values of ``contract_ret`` before the
      row (missing ones left out), strikes are the open times exp of its quantiles, the call's rounded up and the put's
      down to a grid of 0.50, and the Black-Scholes values at 0.06 for 30 days and the column ``vol`` as it is given
      (yearly or not) are added to the call's profit and taken from the put's, per share.  The principal stays.
    * With a contract that is less than 30 days old, the principal moves by 100 times the open's change since the row
      before.
    * With an older one the contract is settled at the close: above the call's strike the principal becomes 100 times
      the close and the call's profit loses 100 times the excess; between the strikes the principal moves as before;
      at or below the put's strike it becomes 100 times that strike and the put's profit gains 100 times the shortfall.
      The next contract is opened on the next row.

    No contract is opened where the fit has fewer than two returns, ``vol`` or the open is missing, or a strike would
    be 0.  A missing open moves nothing.  ``call_strike`` and ``put_strike`` are those of the contract held after the row.
    """

    def machine(day, opens, closes, returns, vols, out):
        """One symbol: fills ``out``, and asks for the fit of a sample (degrees, place and scale) by yielding it."""
        contract, principal, last = None, 0.0, float("nan")
        call_profit = put_profit = 0.0
        for i, (now, close) in enumerate(zip(opens.tolist(), closes.tolist(), strict=True)):
            change = now - last if now == now and last == last else 0.0
            last = now if now == now else last
            if i < window:
                principal, call_profit, put_profit = now, 0.0, 0.0
            elif contract is None:
                if i == 0:
                    principal = now * LOT
                past = returns[max(0, i - window) : i]
                past = past[~np.isnan(past)]
                if len(past) >= 2 and vols[i] > 0 and now > 0:
                    up, down = (now * math.exp(x) for x in (yield past))
                    up, down = math.ceil(up / GRID) * GRID, math.floor(down / GRID) * GRID
                    if down > 0:
                        call, _ = _black_scholes(now, up, DAYS / 365, vols[i])
                        _, put = _black_scholes(now, down, DAYS / 365, vols[i])
                        call_profit, put_profit = call_profit + call, put_profit - put
                        contract = (day[i], up, down)
            elif day[i] - contract[0] < DAYS:
                principal += change * LOT
            else:
                _, up, down = contract
                if close > up:
                    principal, call_profit = close * LOT, call_profit - (close - up) * LOT
                elif close > down:
                    principal += change * LOT
                elif close == close:
                    principal, put_profit = down * LOT, put_profit + (down - close) * LOT
                contract = None
            out[i, :3] = principal, call_profit, put_profit
            if contract:
                out[i, 3:] = contract[1:]

    def quantiles(samples):
        """The logarithms of both strikes to the open, by samples of one length."""
        v, m, s = students_t(np.stack(samples))
        return zip(*(m + s * students_t_quantile(q, v) for q in (call_threshold, put_threshold)), strict=True)

    def run(pdf):
        """Symbols side by side, each whole and sorted: their next fits are made together."""
        x = pdf[["day", "open", "close", "contract_ret", "vol"]].to_numpy(np.float64)
        out = np.full((len(pdf), 5), np.nan)
        names = pdf["act_symbol"].to_numpy()
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(pdf)]
        machines = [machine(*x[a:b].T, out[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        asked = {k: s for k, g in enumerate(machines) if (s := next(g, None)) is not None}
        while asked:
            alike, then = {}, {}
            for k, s in asked.items():
                alike.setdefault(len(s), []).append(k)
            for keys in alike.values():
                for at in range(0, len(keys), FITS):
                    some = keys[at : at + FITS]
                    for k, answer in zip(some, quantiles([asked[k] for k in some]), strict=True):
                        with contextlib.suppress(StopIteration):
                            then[k] = machines[k].send(answer)
            asked = then
        got = pdf[["act_symbol", "day", "close"]]
        return got.assign(**dict(zip(("principal", "call_profit", "put_profit", "call_strike", "put_strike"), out.T, strict=True)))

    def by_symbols(frames):
        """Batches of rows sorted by symbol and date, regrouped so that each has about ``ROWS`` rows of whole symbols."""
        import pandas as pd

        held, count = [], 0
        for pdf in frames:
            held, count = [*held, pdf], count + len(pdf)
            if count < ROWS:
                continue
            pdf = pd.concat(held, ignore_index=True)
            names = pdf["act_symbol"].to_numpy()
            done = int((names == names[-1]).argmax())  # the last symbol may go on
            if done:
                yield run(pdf[:done])
            held = [pdf[done:]]
            count = len(held[0]) if done else 0
        if held:
            yield run(pd.concat(held, ignore_index=True))

    # A symbol's rows are few and its fits many, so symbols are dealt to as many tasks as a shuffle has.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("act_symbol", F.unix_date("date").alias("day"), "open", "close", "contract_ret", "vol").repartition(n, "act_symbol").sortWithinPartitions("act_symbol", "day")
    got = rows.mapInPandas(by_symbols, COLLAR.replace("date date", "day int"))
    nulls = {c: F.when(~F.isnan(c), F.col(c)) for c in ("close", "principal", "call_profit", "put_profit", "call_strike", "put_strike")}
    return got.withColumns({"day": F.date_from_unix_date("day"), **nulls}).withColumnRenamed("day", "date")
