"""Monthly investable universes without a loop over months.

A bar at date D belongs to the history [T - 1 year, T) of the twelve month starts T that follow it.  Prices and volumes
are unfolded row by row over these months into one aggregation, whose groups (target, symbol) lie within the symbols'
partitions, so nothing is shuffled or sorted twelve times.  Where statistics of the year are asked for, a symbol's bars
meet as arrays and all its months are made of them at once.  Either way there is one table of statistics a (target,
symbol); the filters narrow that table in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.sources.io import save

KEYS = ["target", "act_symbol"]
LAGS = range(2, 20)


def by_symbol():
    return W.partitionBy("act_symbol").orderBy("date")


def by_month():
    return W.partitionBy("target")


def months(panel: DataFrame, start=None, end=None) -> DataFrame:
    """Every month start from the panel's (or the given) first to its last."""
    lo = F.lit(start).cast("date") if start else F.min("date")
    hi = F.lit(end).cast("date") if end else F.max("date")
    return panel.agg(F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month")).alias("m")).select(F.explode("m").alias("target"))


def history(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """Bars by target month: those in the year before it."""
    first = F.trunc("date", "month")
    out = panel.withColumn("target", F.explode(F.sequence(F.add_months(first, 1), F.add_months(first, 12), F.expr("interval 1 month"))))
    # A bar at the very day a year before is in; bars before it are not.
    return out.join(F.broadcast(targets), "target", "left_semi").where((F.col("date") >= F.add_months("target", -12)) & (F.col("date") < F.col("target")))


def price_stats() -> dict:
    recent = F.when(F.col("date") >= F.add_months("target", -1), F.col("close") * F.col("volume"))
    return {
        "dollar_volume": F.avg(recent), "average_price": F.avg("close"),
        "known_price": F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))),
    }


def price_statistics(past: DataFrame) -> DataFrame:
    """One row a (target, symbol) of a history with what filters ask for that need no statistics of the year."""
    return past.groupBy(*KEYS).agg(*[v.alias(k) for k, v in price_stats().items()])


#: What :func:`statistics` gives beside target and symbol.
STATISTICS = "dollar_volume double, average_price double, known_price double, history_days long, last_price double, year_return double, volatility double, hurst double, uptrend boolean"


class Windows:
    """Stretches [begin, end) of a symbol's rows, none of them empty, and figures of a series in each of them."""

    def __init__(self, begin: np.ndarray, end: np.ndarray):
        self.begin, self.end = begin, end
        size = end - begin
        self.heads = np.cumsum(size) - size
        self.of = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(self.of)) - self.heads[self.of]
        self.row = begin[self.of] + self.place

    def mean(self, x: np.ndarray, where: np.ndarray | bool = True) -> np.ndarray:
        """The mean of the values there are, NaN without any."""
        v = x[self.row]
        ok = where & ~np.isnan(v)
        n = np.add.reduceat(ok, self.heads, dtype=np.int64)
        return np.where(n > 0, np.add.reduceat(np.where(ok, v, 0.0), self.heads) / np.maximum(n, 1), np.nan)

    def deviation(self, x: np.ndarray, k: int) -> np.ndarray:
        """The population's deviation of the values from place ``k`` on, NaN without any.

        Values are taken from the window's first one, then from their mean: equal values have exactly 0, and no sum of
        squares is taken off another one.
        """
        n_rows, there = len(x), ~np.isnan(x)
        after = np.minimum.accumulate(np.where(there, np.arange(n_rows), n_rows)[::-1])[::-1]
        first = np.where(self.begin + k < self.end, after[np.minimum(self.begin + k, n_rows - 1)], n_rows)
        shift = np.where(first < self.end, x[np.minimum(first, n_rows - 1)], 0.0)
        ok = (self.place >= k) & there[self.row]
        n = np.add.reduceat(ok, self.heads, dtype=np.int64)
        v = np.where(ok, x[self.row] - shift[self.of], 0.0)
        v = np.where(ok, v - (np.add.reduceat(v, self.heads) / np.maximum(n, 1))[self.of], 0.0)
        return np.where(n > 0, np.sqrt(np.add.reduceat(v * v, self.heads) / np.maximum(n, 1)), np.nan)

    def last(self, x: np.ndarray) -> np.ndarray:
        """The last value there is, NaN without any."""
        at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))[self.end - 1]
        return np.where(at >= self.begin, x[at], np.nan)


def _symbol_statistics(t: pa.Table) -> pa.Table:
    """All months' statistics of one symbol; or those of one ``target``, with the first days of its year and its month."""
    order = np.argsort(t["date"].to_numpy(), kind="stable")
    date, close, volume = (t[c].to_numpy()[order] for c in ("date", "close", "volume"))
    if "target" in t.column_names:
        target, start, recent = (t[c].to_numpy()[:1] for c in ("target", "_start", "_recent"))
    else:
        month = date.astype("datetime64[M]")
        ahead = np.arange(month[0] + 1, month[-1] + 13)
        target, start, recent = (m.astype("datetime64[D]") for m in (ahead, ahead - 12, ahead - 1))
    begin, end = np.searchsorted(date, start), np.searchsorted(date, target)
    full = end > begin
    target, recent, w = target[full], recent[full], Windows(begin[full], end[full])
    with np.errstate(all="ignore"):
        # A difference counts in a history if both its bars do.
        before = lambda k: np.concatenate([np.full(min(k, len(close)), np.nan), close[:-k]])
        ratio = np.where(before(1) != 0, close / before(1), np.nan)
        sd = w.deviation(np.log(np.where(ratio > 0, ratio, np.nan)), 1)
        tau = np.sqrt(np.nan_to_num(np.array([w.deviation(close - before(k), k) for k in LAGS])))
        x, y = np.log(np.array(LAGS, dtype=float))[:, None], np.log(np.where(tau > 0, tau, 1e-8))
        n = len(LAGS)
        slope = (n * (x * y).sum(0) - x.sum() * y.sum(0)) / (n * (x * x).sum() - x.sum() ** 2)
        days, first, last = w.end - w.begin, close[w.begin], close[w.end - 1]
        long = days >= 30
        columns = {
            "dollar_volume": w.mean(close * volume, date[w.row] >= recent[w.of]), "average_price": w.mean(close), "known_price": w.last(close),
            "history_days": days.astype(np.int64), "last_price": last, "year_return": np.where(first != 0, last / first, np.nan) - 1,
            "volatility": np.where(long, sd * np.sqrt(252.0), np.nan), "hurst": np.where(long, slope, np.nan),
            "uptrend": (days >= 200) & (last > w.mean(close, w.row >= w.end[w.of] - 200)),
        }
    symbols = t["act_symbol"].take(pa.array(np.zeros(len(target), dtype=np.int64)))
    return pa.table({"target": pa.array(target), "act_symbol": symbols, **{c: pa.array(v, from_pandas=True) for c, v in columns.items()}})


def statistics(panel: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row a (target, symbol) with all that filters ask for, for the month starts ``targets``; without them the panel
    is one history, whose ``target`` it has.

    A symbol has a row a day, so a century of it is 40,000 rows; more than that no task holds at once.  Groups of fewer
    than 30 rows have no volatility and slope; the uptrend needs 200.
    """
    span = [] if targets is not None else ["target", F.add_months("target", -12).alias("_start"), F.add_months("target", -1).alias("_recent")]
    rows = panel.where("date is not null").select("act_symbol", F.to_date("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in ("close", "volume")], *span)
    out = rows.groupBy("act_symbol").applyInArrow(_symbol_statistics, f"target date, act_symbol {panel.schema['act_symbol'].dataType.simpleString()}, {STATISTICS}")
    return out if targets is None else out.join(F.broadcast(targets), "target", "left_semi")


def liquidity(past: DataFrame) -> DataFrame:
    """Mean dollar volume in the month before the target."""
    recent = past.where(F.col("date") >= F.add_months("target", -1))
    return recent.groupBy(*KEYS).agg(F.avg(F.col("close") * F.col("volume")).alias("dollar_volume"))


def yearly_stats(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """History length, return, annualised volatility, Hurst slope, last price and uptrend by (target, symbol)."""
    return statistics(panel, targets).select(*KEYS, "history_days", "year_return", "volatility", "hurst", "last_price", "uptrend")


class Filter:
    """Narrows a table of :func:`statistics`; without ``yearly`` it asks for those of :func:`price_statistics` only."""

    yearly = True

    def __init__(self, name: str):
        self.name = name

    def apply(self, stats: DataFrame) -> DataFrame:
        """The rows of the survivors; ``stats`` has those of earlier survivors only."""
        raise NotImplementedError


class TopLiquidityFilter(Filter):
    yearly = False

    def __init__(self, N: int):
        super().__init__(f"top {N} by liquidity")
        self.n = N

    def apply(self, stats):
        place = F.row_number().over(by_month().orderBy(F.col("dollar_volume").desc(), "act_symbol"))
        return stats.where("dollar_volume is not null").withColumn("_r", place).where(F.col("_r") <= self.n).drop("_r")


class PriceFilter(Filter):
    yearly = False
    METHODS = ("close_price", "avg_price_over_last_year")

    def __init__(self, min_price: float = 5.0, method: str = "close_price"):
        super().__init__(f"price >= {min_price} ({method})")
        if method not in self.METHODS:
            raise ValueError(f"unknown method: {method}")
        self.min_price, self.method = min_price, method

    def apply(self, stats):
        return stats.where(F.col("known_price" if self.method == "close_price" else "average_price") >= self.min_price)


@dataclass
class _Stats:
    min_history_days: int | None = None
    max_crash: float | None = None
    require_uptrend: bool | None = None
    volatility_n: int | None = None


class AdvancedStatsFilter(Filter):
    """Drops short histories, returns below ``max_crash`` (a signed number) and, on request, what is not in an uptrend;
    keeps the ``volatility_n`` least volatile."""

    def __init__(self, min_history_days=None, max_crash=None, require_uptrend=None, volatility_n=None):
        super().__init__("yearly statistics")
        self.want = _Stats(min_history_days, max_crash, require_uptrend, volatility_n)

    def apply(self, stats):
        s = stats.where("hurst is not null and volatility is not null")
        if self.want.min_history_days is not None:
            s = s.where(F.col("history_days") >= self.want.min_history_days)
        if self.want.max_crash is not None:
            s = s.where(F.col("year_return") >= self.want.max_crash)
        if self.want.require_uptrend:
            s = s.where("uptrend")
        if self.want.volatility_n is not None:
            s = s.withColumn("_r", F.row_number().over(by_month().orderBy("volatility", "act_symbol"))).where(F.col("_r") <= self.want.volatility_n).drop("_r")
        return s


class Universe:
    """A panel, without ETFs where their list is given, and the filters that choose its members."""

    def __init__(self, panel: DataFrame, etfs: DataFrame | None = None):
        self.panel = panel.join(etfs.select("act_symbol"), "act_symbol", "left_anti") if etfs is not None else panel
        self.filters: list[Filter] = []

    def add_filter(self, f: Filter) -> Universe:
        if not isinstance(f, Filter):
            raise TypeError("a Filter is needed")
        self.filters.append(f)
        return self

    def _alive(self, panel: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        if any(f.yearly for f in self.filters):
            stats = statistics(panel, targets)
        else:
            stats = price_statistics(panel if targets is None else history(panel, targets))
        for f in self.filters:
            stats = f.apply(stats)
        return stats.select(*KEYS)

    def members(self, targets: DataFrame) -> DataFrame:
        """``(target, act_symbol)`` after all filters, each on the survivors of those before."""
        return self._alive(self.panel, targets)

    def get_universe_for_month(self, date) -> DataFrame:
        """The rows of the survivors in the month from ``date`` on; any day may be asked for."""
        day = F.lit(date).cast("date")
        past = self.panel.where((F.col("date") >= F.add_months(day, -12)) & (F.col("date") < day))
        alive = self._alive(past.withColumn("target", day))
        rows = self.panel.where((F.col("date") >= day) & (F.col("date") < F.add_months(day, 1)))
        return rows.join(alive.select("act_symbol"), "act_symbol", "left_semi")

    def get_all_universe_data(self, save_name: str | None = None, dates: tuple | None = None) -> DataFrame:
        """The survivors' rows of every month, in the order of symbol and date where they are saved."""
        targets = months(self.panel, *(dates or (None, None)))
        # Only such rows can join; asked for on both sides, they are dealt once for both.
        panel = self.panel.where("act_symbol is not null and date is not null")
        rows = panel.withColumn("target", F.trunc("date", "month")).join(self._alive(panel, targets), KEYS, "left_semi").drop("target")
        if save_name:
            save(rows.orderBy("act_symbol", "date"), save_name)
        return rows
