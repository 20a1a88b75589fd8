"""Windows by symbol and date, and rolling aggregates that need n values in n rows.

Windows are laid by symbol, or by symbol and block of rows inside :func:`blocked`; there each block has copies of as many
rows of its neighbours as the windows reach, and the reach is what these helpers add up while a kernel is built.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_keys: ContextVar[tuple[str, ...]] = ContextVar("keys", default=("act_symbol",))
_reach: ContextVar[list[int]] = ContextVar("reach")


@contextmanager
def blocked(*keys: str):
    """Windows built inside are partitioned by ``keys``; gives ``[rows before, rows after]`` that they reach together."""
    reach = [0, 0]
    tokens = _keys.set(keys), _reach.set(reach)
    try:
        yield reach
    finally:
        _keys.reset(tokens[0])
        _reach.reset(tokens[1])


def _reaches(before: int, after: int = 0) -> None:
    if reach := _reach.get(None):
        reach[0] += max(0, before)
        reach[1] += max(0, after)


def keys() -> tuple[str, ...]:
    return _keys.get()


def by_symbol():
    return W.partitionBy(*_keys.get()).orderBy("date")


def by_date():
    return W.partitionBy("date")


def back(n: int):
    _reaches(n - 1)
    return by_symbol().rowsBetween(-(n - 1), 0)


def ahead(n: int):
    _reaches(0, n - 1)
    return by_symbol().rowsBetween(0, n - 1)


def lag(c: Column, n: int = 1) -> Column:
    """The value n rows before, or -n rows after."""
    _reaches(n, -n)
    return F.lag(c, n).over(by_symbol())


def full(n: int, value: Column, aggregate: Column, frame=back) -> Column:
    """``aggregate`` over n rows, null unless all n values of ``value`` are there."""
    return F.when(F.count(value).over(frame(n)) == n, aggregate.over(frame(n)))


def gathered(state: tuple[Column, ...], n: int, join, stage, step: int = 1) -> tuple[Column, ...]:
    """The states of n rows as one, by doubling: those of 2k rows are joined from two of k rows, k rows apart.

    A frame of n rows would be added up anew at every row; this takes one lag a layer and about log2(n) layers, which all
    kernels share.  ``join(a, k, b, m)`` joins the states of k and m rows; a null makes all that it reaches null.  With a
    ``step`` of -1 rows ahead are taken.  Results are those of n rows up to (or from) each.
    """
    done, held, k = state, 0, 1
    while True:
        if n & k:
            done, held = (join(done, held, tuple(lag(c, step * held) for c in state), k) if held else state), held + k
        k *= 2
        if k > n:
            return stage(*done) if held > 1 else done
        wider = join(state, k // 2, tuple(lag(c, step * (k // 2)) for c in state), k // 2)
        both = stage(*wider, *(done if held else ()))
        state, done = both[: len(wider)], both[len(wider) :]


def _added(a, k, b, m):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _moments(a, k, b, m):
    """Means, squares and products about them of k and m rows together: no sum of squares is taken off another one."""
    half = len(a) > 2
    d = [y - x for x, y in zip(a[: 2 if half else 1], b[: 2 if half else 1], strict=True)]
    means = [x + e * (m / (k + m)) for x, e in zip(a, d, strict=False)]
    pairs = [(0, 0), (1, 1), (0, 1)] if half else [(0, 0)]
    return (*means, *[x + y + d[i] * d[j] * (k * m / (k + m)) for x, y, (i, j) in zip(a[len(d) :], b[len(d) :], pairs, strict=True)])


def total(x: Column, n: int, stage=None, step: int = 1) -> Column:
    return full(n, x, F.sum(x), back if step > 0 else ahead) if stage is None else gathered((x,), n, _added, stage, step)[0]


def mean(x: Column, n: int, stage=None) -> Column:
    return full(n, x, F.avg(x)) if stage is None else total(x, n, stage) / n


def spread(x: Column, n: int, stage, step: int = 1) -> tuple[Column, Column]:
    """The mean and the sum of squares about it."""
    return gathered((x, x * 0.0), n, _moments, stage, step)


def deviation(x: Column, n: int, stage=None) -> Column:
    if stage is None:
        return full(n, x, F.stddev_samp(x))
    return F.sqrt(spread(x, n, stage)[1] / (n - 1)) if n > 1 else F.lit(None).cast("double")


def standard(x: Column, n: int, stage) -> Column:
    """How many deviations a value lies from its mean."""
    if n < 2:
        return F.lit(None).cast("double")
    m, s = spread(x, n, stage)
    return F.try_divide(x - m, F.sqrt(s / (n - 1)))


def products(x: Column, y: Column, n: int, stage) -> tuple[Column, Column, Column]:
    """Sums of squares of x, of y, and of products about their means, where both are there in all n rows."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return gathered((a, b, a * 0.0, b * 0.0, a * 0.0), n, _moments, stage)[2:]


def skew(x: Column, n: int) -> Column:
    """The bias-corrected skewness; Spark's own is the population's."""
    if n < 3:
        return F.lit(None).cast("double")
    return full(n, x, F.skewness(x)) * ((n * (n - 1)) ** 0.5 / (n - 2))


def excess_kurtosis(x: Column, n: int) -> Column:
    """The bias-corrected excess kurtosis."""
    if n < 4:
        return F.lit(None).cast("double")
    return ((n + 1) * full(n, x, F.kurtosis(x)) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def no_nan(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
