"""Queries that must take whole tables."""

from pyspark.sql import functions as F

from tidepanel import catalog
from tidepanel.sources import panel as P

Q = {name: query for name, (query, _) in catalog.entries().items()}


def test_asof_joins_take_all_bars_and_statements(spark, sf):
    back, on = Q["join_asof_releases_backward"](spark, sf), Q["join_asof_releases_forward"](spark, sf)
    st = P.statements(spark, sf)
    assert back.count() == P.bars(spark, sf).count() and on.count() == st.count()
    # Every release that a bar follows before the next one is there.
    assert back.where("other is not null and other <= date").select("act_symbol", "other").distinct().count() > 0.5 * P.calendar(st).count()
    assert on.where(F.col("other") < F.col("date")).count() == 0 < on.where("other is not null").count()


def test_union_has_every_month_once(spark, sf):
    months = lambda df: {r.month: r["count"] for r in df.groupBy(F.trunc("date", "month").alias("month")).count().collect()}
    assert months(Q["union_all_months"](spark, sf)) == months(P.bars(spark, sf))
