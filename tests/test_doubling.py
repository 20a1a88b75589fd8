"""Rolling statistics joined by doubling, against plain ones."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.catalog.features import STUDY
from tidepanel.functions import kernels as K
from tidepanel.plans.features import FeatureEngine, Layers, rank

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """Two symbols; nulls, a stretch of one value, and values whose spread is small beside their size."""
    rng = np.random.default_rng(5)
    x = 1e6 + rng.normal(size=120)
    x[40:75] = x[40]
    y = rng.normal(size=120) + 0.5 * x
    rows = [("AB"[i % 2], DAY + dt.timedelta(days=i), None if i in (9, 90) else float(x[i]), None if i == 101 else float(y[i])) for i in range(120)]
    return spark.createDataFrame(rows, "act_symbol string, date date, x double, y double").cache()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 20, 21])
def test_windows_by_doubling_are_the_plain_ones(series, n):
    from tidepanel.functions import windows as R

    layers = Layers()
    x, y = F.col("x"), F.col("y")
    made = {
        "mean": R.mean(x, n, layers.stage()), "sum": R.total(x, n, layers.stage()), "sd": R.deviation(x, n, layers.stage()), "ahead": R.total(x, n, layers.stage(), -1),
        "z": K.zscore(x, n, layers.stage()), "beta": K.beta(x, y, n, layers.stage()),
    }
    got = layers.applied(series, None).withColumns(made).toPandas().sort_values(["act_symbol", "date"])
    for _, g in got.groupby("act_symbol"):
        r = g.x.rolling(n, min_periods=n)
        exact = g.x.rolling(n, min_periods=n).apply(lambda v: np.std(v, ddof=1) if n > 1 else np.nan, raw=True)
        mean = r.apply(np.mean, raw=True)
        both = [(g.x.values[i - n + 1 : i + 1], g.y.values[i - n + 1 : i + 1]) if i >= n - 1 else None for i in range(len(g))]
        slope = [np.cov(*b)[0, 1] / np.var(b[1], ddof=1) if b and n > 1 and not np.isnan(np.sum(b)) else np.nan for b in both]
        for name, want in {"mean": mean, "sum": n * mean, "ahead": (n * mean).shift(1 - n), "sd": exact, "beta": pd.Series(slope, g.index)}.items():
            np.testing.assert_allclose(g[name].astype(float), want, rtol=1e-6, atol=1e-9, err_msg=f"{name} {n}")
        # A window of one value has no deviation at all, and no score.
        flat = g.x.rolling(n, min_periods=n).apply(lambda v: float(np.ptp(v) == 0), raw=True) == 1
        assert n == 1 or ((g.sd[flat] == 0).all() and g.z[flat].isna().all())


def test_study_lays_no_frame_of_many_rows(series):
    bars = series.select("act_symbol", "date", *[F.col("x").alias(c) for c in ("open", "high", "low", "close", "volume")])
    plan = FeatureEngine(STUDY).compute(bars)._jdf.queryExecution().executedPlan().toString()
    assert "-19, currentrow" not in plan and "currentrow$(), 4" not in plan and "RowFrame, -1" in plan


def test_ranks_of_ties_take_one_sort(spark):
    df = spark.createDataFrame([(DAY, v) for v in (1.0, 2.0, 2.0, 2.0, 5.0, None)], "date date, v double").withColumn("r", rank(F.col("v")))
    assert [r.r for r in df.orderBy("v").collect()] == [None, 0.2, 0.6, 0.6, 0.6, 1.0]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2
