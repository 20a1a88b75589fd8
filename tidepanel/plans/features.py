"""Feature requests compiled to shared layers of windows and scans.

Two exchanges in all: by symbol (all rolling layers, the scans and the lags) and by date (transforms).  With blocks, a
symbol's rows are dealt to several tasks: numbered by month, then cut into blocks of as many rows each, to which the rows
of their neighbours that the windows reach are copied.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidepanel.functions import kernels as K
from tidepanel.functions import recursive as X
from tidepanel.functions import scans as S
from tidepanel.functions import windows as R
from tidepanel.functions.windows import by_date, by_symbol, lag
from tidepanel.sources import scratch


@dataclass(frozen=True)
class Feature:
    """A registered feature: its inputs by name, outputs' names, default period, and how it is computed."""

    inputs: tuple[str, ...]
    kernel: Callable
    period: int
    kind: str = "window"  # window, series (numpy) or calendar
    outputs: tuple[str, ...] = ()
    params: tuple[str, ...] = ()


def _rolling(fn) -> Callable:
    return lambda x, n, stage: fn(x, n)


def _doubled(fn) -> Callable:
    return lambda x, n, stage: fn(x, n, stage)


REGISTRY: dict[str, Feature] = {
    "VOLATILITY": Feature(("real",), _doubled(R.deviation), 10),
    "MEAN": Feature(("real",), _doubled(R.mean), 10),
    "SUM": Feature(("real",), _doubled(R.total), 10),
    "SKEW": Feature(("real",), _rolling(R.skew), 10),
    "KURT": Feature(("real",), _rolling(R.excess_kurtosis), 10),
    "ZSCORE": Feature(("real",), K.zscore, 20),
    "VOL_ZSCORE": Feature(("volume",), K.volume_zscore, 20),
    "SPREAD_AR": Feature(("high", "low", "close"), K.abdi_ranaldo, 20),
    "MA_crossover": Feature(("close",), K.crossover, 20),
    "HURST": Feature(("real",), K.hurst, 20),
    "AUTOCORR": Feature(("real",), K.autocorrelation, 20),
    "pandas_beta": Feature(("log_ret", "market"), K.beta, 20),
    "VWAP_Z": Feature(("close", "volume"), K.vwap_z, 20),
    "RANGE_EFFICIENCY": Feature(("open", "high", "low", "close"), K.range_efficiency, 20),
    "REL_RANGE": Feature(("high", "low"), K.relative_range, 20),
    "TARGET_SHARPE": Feature(("close",), K.forward_sharpe, 20),
    "INTRADAY_LOG_RET": Feature(("open", "close"), K.intraday, 20),
    "FWD_LOG_RET": Feature(("close",), K.forward_return, 20),
    "MOM": Feature(("real",), K.momentum, 10),
    "ROC": Feature(("close",), K.rate_of_change, 10),
    "SMA": Feature(("real",), K.moving_average, 30),
    "SLOPE": Feature(("real",), K.slope, 14),
    "ANGLE": Feature(("real",), K.angle, 14),
    "TSF": Feature(("real",), K.forecast, 14),
    "BBANDS": Feature(("real",), K.bollinger, 5, outputs=("upper", "middle", "lower")),
    "PERCENT_B": Feature(("real",), K.percent_b, 20, outputs=("percent_b", "bandwidth")),
    "STOCH": Feature(("high", "low", "close"), K.stochastic, 5, outputs=("slowk", "slowd")),
    "BETA": Feature(("log_ret", "market"), K.regression_beta, 5),
    "EMA": Feature(("real",), X.ema, 30),
    "RSI": Feature(("close",), X.rsi, 14),
    "MACD": Feature(("real",), X.macd, 0, outputs=("macd", "macdsignal", "macdhist"), params=("fast", "slow", "signal")),
    "ATR": Feature(("high", "low", "close"), X.atr, 14),
    "NATR": Feature(("high", "low", "close"), X.natr, 14),
    "ADX": Feature(("high", "low", "close"), X.adx, 14),
    "ADX_REGIME": Feature(("high", "low", "close"), X.adx_regime, 20),
    "GAP_SIGMA": Feature(("open", "high", "low", "close"), X.gap_sigma, 20),
    "month": Feature(("date",), F.month, 0, "calendar"),
    "day": Feature(("date",), F.dayofmonth, 0, "calendar"),
    "dayofweek": Feature(("date",), F.weekday, 0, "calendar"),
    "quarter": Feature(("date",), F.quarter, 0, "calendar"),
}

#: Features that use another input than asked for.
RAW_ONLY, RETURN_ONLY = {"VWAP_Z"}, {"pandas_beta", "BETA"}
TRANSFORMS = ("rank", "demean", "cs_zscore", "binary", "regime")


def register_feature(name: str, inputs: tuple[str, ...], kernel: Callable, period: int = 20, outputs: tuple[str, ...] = (), recursive: bool = False) -> None:
    """Add a feature of one's own: a kernel of columns, or with ``recursive`` one of a symbol's numpy arrays."""
    REGISTRY[name] = Feature(tuple(inputs), kernel, period, "series" if recursive else "window", tuple(outputs))


def listing(spark) -> DataFrame:
    """``(name, kind, inputs, outputs, period, has_timeperiod)`` of all registered features."""
    rows = [(n, f.kind, list(f.inputs), list(f.outputs), f.period, f.period > 0) for n, f in sorted(REGISTRY.items())]
    return spark.createDataFrame(rows, "name string, kind string, inputs array<string>, outputs array<string>, period int, has_timeperiod boolean")


@dataclass
class FeatureRequest:
    """What to compute.  ``shift`` below 0 lags and makes a feature (F); 0 and above leads and makes a target (T)."""

    name: str
    params: dict = field(default_factory=dict)
    shift: int = 0
    input_type: str = "log_price"
    market_ref: str | None = None
    alias: str | None = None
    deriv_order: int = 0
    transform: str | None = None
    transform_params: dict = field(default_factory=dict)

    def __post_init__(self):
        self.params, self.transform_params = self.params or {}, self.transform_params or {}
        if self.name not in REGISTRY:
            raise ValueError(f"unknown feature: {self.name}")
        if self.transform is not None and self.transform not in TRANSFORMS:
            raise ValueError(f"unknown transform: {self.transform}")
        if self.deriv_order not in (0, 1, 2):
            raise ValueError("deriv_order is 0, 1 or 2")
        self.asked_input = self.input_type
        if self.name in RAW_ONLY:
            self.input_type = "raw"
        if self.name in RETURN_ONLY:
            self.input_type, self.market_ref = "log_ret", self.market_ref or "SPY"
        self.inputs()

    @property
    def feature(self) -> Feature:
        return REGISTRY[self.name]

    @property
    def period(self) -> int:
        return int(self.params.get("timeperiod", self.feature.period))

    @property
    def base_name(self) -> str:
        """The column's name before its transform and output."""
        if self.feature.kind == "calendar":
            return f"CAL_{self.name}"
        side = "T" if self.shift >= 0 else "F"
        order = ("", "_VEL", "_ACC")[self.deriv_order]
        if self.alias:
            span = f"_{self.params['timeperiod']}d" if "timeperiod" in self.params else ""
            return f"{self.alias}{span}{order}_{side}"
        values = "_".join(str(v) for v in self.params.values())
        return f"{self.name}_{values}_{self.asked_input}{order}_{abs(self.shift)}d_{side}"

    @property
    def column_name(self) -> str:
        return self.base_name + (f"_{self.transform.upper()}" if self.transform else "")

    def columns(self) -> list[str]:
        """The names in the result."""
        return [self.column_name + (f"_{o}" if o else "") for o in self.feature.outputs or ("",)]

    def inputs(self) -> list[str]:
        """The panel's columns that feed the kernel."""
        wanted = self.feature.inputs
        if self.feature.kind == "calendar":
            return ["date"]
        if self.name in RETURN_ONLY:
            return ["log_ret", f"MKT_{self.market_ref}_RET"]
        logs = {"close": "log_close", "high": "log_high", "low": "log_low", "real": "log_close"}
        if len(wanted) > 1:
            if self.input_type != "log_price":
                return list(wanted)
            if missing := [c for c in wanted if c not in logs]:
                raise ValueError(f"{self.name} needs {missing}, which have no logarithm; use input_type='raw'")
            return [logs[c] for c in wanted]
        if self.input_type == "raw":
            if wanted[0] == "real":
                raise ValueError(f"{self.name} takes any series; name it: log_price, log_ret, close, ...")
            return [wanted[0]]
        # A series by name; log_price is the log close, and log volume for a feature of volume alone.
        if self.input_type == "log_price":
            return ["log_volume" if wanted[0] == "volume" else "log_close"]
        return [self.input_type]


def prepare(df: DataFrame) -> DataFrame:
    """Prices and volumes of 0 or less as null, then logs, log returns and gaps where the panel hasn't them."""
    prices = [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    df = df.withColumns({c: F.when(F.col(c) > 0, F.col(c).cast("double")) for c in prices})
    new = {f"log_{c}": F.ln(c) for c in ("close", "high", "low", "volume") if c in df.columns and f"log_{c}" not in df.columns}
    before = lag(F.col("close"))
    if "log_ret" not in df.columns:
        new["log_ret"] = F.ln(F.col("close") / before)
    if "gap_size" not in df.columns and "open" in df.columns:
        new["gap_size"] = F.col("open") - before
    return df.withColumns(new)


#: A reference series has a row a date: 40,000 rows are more than a century of days.
MARKET_ROWS = 40_000


def join_market(df: DataFrame, ref: str, series: DataFrame | None = None, order: tuple[str, ...] = ("date",)) -> DataFrame:
    """Add ``MKT_{ref}_RET``: the reference's log return of the day, null if none.

    ``series`` is ``(date, log_ret)``; without it the symbol ``ref`` of the panel is used.  Dates may be timestamps and
    meet by their day.  Of several rows of a day the last in ``order`` counts, also where its return is null; of rows
    that ``order`` doesn't tell apart, the largest return.
    """
    name = f"MKT_{ref}_RET"
    if name in df.columns:
        return df
    rows = df.where(F.col("act_symbol") == ref) if series is None else series
    last = F.max_by(F.struct("log_ret"), F.struct(*order, F.coalesce("log_ret", F.lit(float("-inf"))).alias("_l")))
    by_date = rows.groupBy(F.to_date("date").alias("_day")).agg(last["log_ret"].alias(name))
    small = series is not None and by_date.limit(MARKET_ROWS + 1).count() <= MARKET_ROWS
    return df.withColumn("_day", F.to_date("date")).join(F.broadcast(by_date) if small else by_date, "_day", "left").drop("_day")


def rank(x: Column) -> Column:
    """The average rank as a part of the values of the date; null stays null."""
    inside = by_date().orderBy(x.asc_nulls_last())
    # The first and the last place of equal values, from one sort.
    last = F.count(x).over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(inside) + last) / 2 / F.count(x).over(by_date()))


def transformed(x: Column, kind: str, params: dict) -> Column:
    if kind == "rank":
        return rank(x)
    if kind == "demean":
        return x - F.avg(x).over(by_date())
    if kind == "cs_zscore":
        return F.try_divide(x - F.avg(x).over(by_date()), F.stddev_samp(x).over(by_date()))
    if kind == "binary":
        return F.when(x.isNotNull(), (x > params.get("threshold", 0)).cast("double"))
    t = params.get("threshold", 0.02)
    return F.when(x > t, 1.0).when(x < -t, -1.0).when(x.isNotNull(), 0.0)


def _by_series(df: DataFrame, requests: list[tuple[FeatureRequest, list[str]]]) -> DataFrame:
    """All numpy kernels (a user's own) of a symbol in one Arrow call, on the windows' own partitioning."""
    jobs = [(r.feature.kernel, r.inputs(), r.period, {k: v for k, v in r.params.items() if k in r.feature.params}, names) for r, names in requests]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for _, names in requests for n in names]])

    def run(pdf):
        pdf = pdf.sort_values("date", kind="stable", ignore_index=True)
        for kernel, inputs, n, params, names in jobs:
            out = kernel(*[pdf[c].to_numpy(np.float64) for c in inputs], n, **params)
            for name, x in zip(names, out if isinstance(out, tuple) else (out,), strict=True):
                pdf[name] = x
        return pdf

    out = df.groupBy("act_symbol").applyInPandas(run, schema)
    return out.withColumns({n: R.no_nan(F.col(n)) for _, names in requests for n in names})


class Layers:
    """The columns, first places and scans that kernels ask for, by how many they ask for one after the other."""

    def __init__(self):
        self.all: list[tuple[dict[str, Column], dict[str, Column], list[S.Scan]]] = []
        self.fresh = itertools.count()

    def stage(self) -> Stage:
        return Stage(self)

    def applied(self, df: DataFrame, blocks: Blocks | None, then: tuple[Column, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
        """``then`` are the expressions made of the layers, ``keep`` the panel's columns that the result has."""
        made = True
        for d, (columns, first, scans) in enumerate(self.all):
            df = df.withColumns(columns) if columns else df
            made = made or bool(columns)
            if blocks is not None and (first or scans):
                # What a symbol's tasks must know of each other is joined; so rows are written before that, once a layer.
                here = [*first.values(), *[c for s in scans for c in (s.x, s.begin)]]
                after = [*[c for cs, fs, ss in self.all[d + 1 :] for c in (*cs.values(), *fs.values(), *[x for s in ss for x in (s.x, s.begin)])], *then]
                df = blocks.written(df, [*here, *after], keep) if made else df
                made = bool(scans)
            df = S.first_place(df, first, blocks is not None) if first else df
            if scans:
                df = S.scanned(df if blocks is None else blocks.own(df), scans, blocks and blocks.rows)
                # Copies of the neighbours' rows are dealt anew only for windows that follow.
                df = blocks.lapped(df) if blocks is not None and any(" OVER (" in str(c) for c in after) else df
        return df


class Stage:
    """What a kernel gets: turns expressions into columns of its next layer, under names of their own."""

    def __init__(self, layers: Layers):
        self.layers, self.depth = layers, 0

    def _next(self):
        self.depth += 1
        while len(self.layers.all) < self.depth:
            self.layers.all.append(({}, {}, []))
        return self.layers.all[self.depth - 1]

    def _name(self) -> str:
        return f"_s{next(self.layers.fresh)}"

    def __call__(self, *columns: Column) -> tuple[Column, ...]:
        names = [self._name() for _ in columns]
        self._next()[0].update(zip(names, columns, strict=True))
        return tuple(F.col(n) for n in names)

    def first(self, x: Column) -> Column:
        """The place of the symbol's first value of a column."""
        name = self._name()
        self._next()[1][name] = x
        return F.col(name)

    def scan(self, x: Column, begin: Column, n: int, keep: float, gain: float, weight: float, wait: int = 0) -> Column:
        name = self._name()
        self._next()[2].append(S.Scan(name, x, begin, n, keep, gain, weight, wait))
        return F.col(name)

    def together(self, *parts: Callable) -> list:
        """The results of parts that do not need each other, on the same layers."""
        start, ends, out = self.depth, [], []
        for part in parts:
            self.depth = start
            out.append(part(self))
            ends.append(self.depth)
        self.depth = max(ends)
        return out


class Blocks:
    """A symbol's rows in blocks of ``rows`` by place, each with copies of the rows before and after it that windows reach."""

    def __init__(self, rows: int, before: int, after: int, tasks: int | None = None):
        self.rows = -(-max(rows, before, after) // S.PIECE) * S.PIECE
        self.before, self.after, self.tasks = before, after, tasks

    def placed(self, df: DataFrame) -> DataFrame:
        """Add ``_pos``: rows are numbered inside their month, after a running sum of the months' counts."""
        df = df.withColumn("_month", F.trunc("date", "month"))
        counts = df.groupBy("act_symbol", "_month").agg(F.count("*").alias("_n"))
        counts = counts.withColumn("_pos0", F.sum("_n").over(W.partitionBy("act_symbol").orderBy("_month")) - F.col("_n")).drop("_n")
        inside = F.row_number().over(W.partitionBy("act_symbol", "_month").orderBy("date")) - 1
        return df.join(counts, ["act_symbol", "_month"]).withColumn("_pos", F.col("_pos0") + inside).drop("_month", "_pos0")

    def lapped(self, df: DataFrame) -> DataFrame:
        """Rows of all blocks, copies included."""
        mine, at = F.floor(F.col("_pos") / self.rows), F.pmod("_pos", F.lit(self.rows))
        also = F.array(mine, F.when(at >= self.rows - self.before, mine + 1), F.when((at < self.after) & (mine > 0), mine - 1))
        df = df.withColumn("_block", F.explode(F.filter(also, lambda b: b.isNotNull())))
        return df.repartition(scratch.tasks(df.sparkSession, self.tasks), "act_symbol", "_block")

    def own(self, df: DataFrame) -> DataFrame:
        """Rows of all blocks without the copies."""
        return df.where(F.floor(F.col("_pos") / self.rows) == F.col("_block"))

    def written(self, df: DataFrame, wanted: list[Column], keep: tuple[str, ...]) -> DataFrame:
        """What is kept or may occur in ``wanted``, in buckets by symbol and block: joins and windows by them take no exchange."""
        named = " ".join(str(c) for c in wanted)
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in (*S.PLACE, *keep) or c in named])
        return scratch.dealt(df, "layer", ("act_symbol", "_block"), self.tasks)


class FeatureEngine:
    """Compiles requests; ``compute`` adds their columns to a panel of ``(act_symbol, date, open, ..., volume)``.

    A kernel that cannot be built (it raises, or a column that it needs is not there) raises; with ``lenient`` a warning
    is given instead, the request's columns are null, and all others are computed.  Jobs that fail raise either way.
    """

    def __init__(self, requests: list[FeatureRequest], lenient: bool = False):
        self.requests, self.lenient = list(requests), lenient

    def _built(self, r: FeatureRequest, layers: Layers, there: set[str]) -> tuple[Column, ...]:
        """The kernel's results as expressions over the layers."""
        before = [(dict(columns), dict(first), list(scans)) for columns, first, scans in layers.all]
        try:
            if missing := [c for c in r.inputs() if c not in there]:
                raise ValueError(f"{r.name} needs columns that are not there: {missing}")
            extra = {k: v for k, v in r.params.items() if k in r.feature.params}
            out = r.feature.kernel(*[F.col(c) for c in r.inputs()], r.period, layers.stage(), **extra)
            return out if isinstance(out, tuple) else (out,)
        except Exception as e:
            if not self.lenient:
                raise
            warnings.warn(f"{r.name} is left null: {e}", stacklevel=2)
            layers.all[:] = before
            return tuple(F.lit(None).cast("double") for _ in r.feature.outputs or ("",))

    def compute(self, df: DataFrame, market: DataFrame | None = None, block_rows: int | None = None, keep: tuple[str, ...] | None = None, tasks: int | None = None) -> DataFrame:
        """``df`` with the requests' columns; with ``keep`` only so many others beside symbol and date.

        Without ``block_rows`` all rows of a symbol meet in one task.  With it a task gets about so many of them (more where
        windows reach further), at two more exchanges.  Each layer of scans writes the rows once, in ``tasks`` buckets (the
        session's partitions if not given), what is not kept or needed left out; windows after it take one exchange more.
        Results are the same.  Symbols and dates are then not null, and numpy kernels are not taken.
        """
        if block_rows is None:
            return self._compute(df, market, None, None, keep)
        if any(r.feature.kind == "series" for r in self.requests):
            raise ValueError("numpy kernels need all rows of a symbol in one task")
        with R.blocked("act_symbol", "_block") as reach:
            return self._compute(df, market, block_rows, reach, keep, tasks)

    def _compute(self, df: DataFrame, market: DataFrame | None, block_rows: int | None, reach: list[int] | None, only: tuple[str, ...] | None, tasks: int | None = None) -> DataFrame:
        given = list(df.columns)
        there = {*prepare(df if block_rows is None else df.withColumn("_block", F.lit(0))).columns, *[f"MKT_{r.market_ref}_RET" for r in self.requests if r.market_ref and r.name in RETURN_ONLY]}
        layers = Layers()
        last: dict[str, Column] = {}
        series, made = [], {}
        for r in self.requests:
            if r.feature.kind == "calendar":
                last[r.base_name] = r.feature.kernel("date").cast("int")
                continue
            names = [r.base_name + (f"_{o}" if o else "") for o in r.feature.outputs or ("",)]
            if names[0] in made:
                continue
            made[names[0]] = (r, names, [f"_v{next(layers.fresh)}" for _ in names])
            if r.feature.kind == "series":
                series.append((r, made[names[0]][2]))
                continue
            last.update(zip(made[names[0]][2], self._built(r, layers, there), strict=True))
        # Derivatives and shifts over the kernels' results.
        derived, moved = {}, {}
        for r, names, values in made.values():
            for name, v in zip(names, values, strict=True):
                x = F.col(v)
                derived[f"_d{v}"] = (x, x - lag(x), x - 2 * lag(x) + lag(x, 2))[r.deriv_order] if r.deriv_order else x
                moved[name] = lag(F.col(f"_d{v}"), -r.shift) if r.shift else F.col(f"_d{v}")

        blocks = None
        if block_rows is not None:
            # The logs and returns of prepare() reach a row back.
            blocks = Blocks(block_rows, reach[0] + 1, reach[1], tasks)
            df = blocks.lapped(blocks.placed(df))
        df = prepare(df)
        base = [c for c in df.columns if c not in ("_pos", "_block")]
        for ref in dict.fromkeys(r.market_ref for r in self.requests if r.market_ref and r.name in RETURN_ONLY):
            df = join_market(df, ref, market)
            base.append(f"MKT_{ref}_RET")
        if blocks is None and any(scans for _, _, scans in layers.all):
            df = df.withColumn("_pos", (F.row_number().over(by_symbol()) - 1).cast("long"))
        if only is not None:
            given, base = ([c for c in names if c in ("act_symbol", "date", *only)] for names in (given, base))
        df = layers.applied(df, blocks, (*last.values(), *derived.values(), *moved.values()), tuple(base))
        df = df.withColumns(last) if last else df
        df = df.select(*base, *last, *(["_pos", "_block"] if blocks else []))
        if series:
            df = _by_series(df, series)
        df = df.withColumns(derived).withColumns(moved)
        df = blocks.own(df) if blocks else df
        wanted = {}
        for r in self.requests:
            for base_col, name in zip([r.base_name + (f"_{o}" if o else "") for o in r.feature.outputs or ("",)], r.columns(), strict=True):
                wanted[name] = transformed(F.col(f"`{base_col}`"), r.transform, r.transform_params) if r.transform else F.col(f"`{base_col}`")
        keep = list(dict.fromkeys([*given, *base]))
        return df.select(*[F.col(f"`{c}`") for c in keep], *[x.alias(n) for n, x in wanted.items() if n not in keep])
