"""Exact order statistics, and as-of joins of keys that are dealt by period."""

import datetime as dt

import numpy as np
import pytest

from tidepanel.operators import selection
from tidepanel.operators.asof import asof


@pytest.mark.parametrize("cuts,few", [(1, 1), (3, 2), (255, 50), (255, 1 << 16)])
def test_quantiles_are_exact(spark, cuts, few):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=400), 2.0 ** rng.integers(-300, 300, 300), np.repeat([1.0, 2.0, 7.5], [5, 200, 1]), np.zeros(90), np.array([3.0])):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "x double")
        got = selection.quantiles(df, "x", [0.0, 0.05, 0.5, 0.77, 1.0], cuts, few)
        np.testing.assert_allclose(got, np.quantile(values, [0.0, 0.05, 0.5, 0.77, 1.0]), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    assert selection.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
    assert selection.order_statistics(spark.createDataFrame([(1.0,), (2.0,)], "x double"), "x", [1, 0]) == {0: 1.0, 1: 2.0}


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("period", ["week", "month", "year"])
def test_periods_do_not_change_an_asof_join(spark, forward, period):
    """One key holds nearly all rows; others have gaps over many periods, no right rows, or no left rows; keys and times may be null."""
    rng = np.random.default_rng(3)
    day = lambda n: dt.date(2015, 1, 1) + dt.timedelta(days=int(n))
    left = [("HOT", day(x), float(i)) for i, x in enumerate(rng.integers(0, 2000, 900))] + [(k, day(x), float(i)) for i, (k, x) in enumerate(zip(rng.choice(list("AB"), 60), rng.integers(0, 2000, 60)))]
    right = [("HOT", day(x), int(i), None if i % 7 == 0 else f"p{i}") for i, x in enumerate(rng.integers(0, 2000, 150))] + [("A", day(3), 1, "first"), ("A", day(1500), 2, "late"), ("A", day(1500), 3, "later"), ("C", day(7), 1, "none")]
    left += [("HOT", None, -1.0), (None, day(5), -2.0), ("A", day(1500), -3.0)]
    l = spark.createDataFrame(left, "act_symbol string, date date, x double")
    r = spark.createDataFrame(right, "act_symbol string, rel date, v int, w string")
    key = lambda row: tuple(str(c) for c in row)
    plain, dealt = (sorted(map(key, asof(l, r, "date", "rel", forward=forward, payload={"rel": "rel", "v": "v", "w": "w"}, period=p).collect())) for p in (None, period))
    assert plain == dealt and len(plain) == len(left)
    for k, d, x, rel, v, w in plain:
        other = [q for q in right if q[0] == k and d != "None" and ((str(q[1]) >= d) if forward else (str(q[1]) <= d))]
        best = (min if forward else max)((str(q[1]) for q in other), default="None")
        assert rel == best


def test_a_key_is_dealt_to_several_tasks(spark):
    l = spark.range(1000).selectExpr("'HOT' as act_symbol", "date_add(date'2015-01-01', cast(id as int)) as date")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = asof(l, l.withColumnRenamed("date", "rel"), "date", "rel", period="month")
        tasks = out.selectExpr("spark_partition_id() as p", "rel = date as same").groupBy("p").agg({"same": "count"}).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
