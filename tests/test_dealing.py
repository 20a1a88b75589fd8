"""How bars are dealt to tasks."""

import pytest

from tidepanel.catalog import entries
from tidepanel.sources import panel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_and_windows_by_symbol_take_one_exchange(spark, sf):
    """Before, bars were shuffled by symbol and date and once more by symbol."""
    assert plan(entries()["feat_gap_sigma"][0](spark, sf)).count("Exchange ") == 1
    assert "trunc" not in plan(panel.bars(spark, sf)) and "trunc" in plan(panel.bars(spark, sf, whole=False))


@pytest.mark.parametrize("whole", [True, False])
def test_tasks_follow_the_trades(spark, sf, monkeypatch, whole):
    """Before, they were the session's partitions, so that a task's rows grew with the table."""
    monkeypatch.setattr(panel, "TASK_TRADES", 500)
    trades = panel.table(spark, sf, "lineitem").count()
    bars = panel.bars(spark, sf, whole)
    assert bars.rdd.getNumPartitions() == -(-trades // 500) > 4
    monkeypatch.setattr(panel, "TASK_TRADES", 10**9)
    assert sorted(bars.collect()) == sorted(panel.bars(spark, sf, not whole).collect())


@pytest.mark.parametrize("name", ["fund_all_data", "fund_batch", "split_adjust_batch"])
def test_bars_stay_where_they_lie(spark, sf, monkeypatch, name):
    """Splits and releases are brought to the bars; before, as-of joins dealt the bars anew, to the session's partitions."""
    monkeypatch.setattr(panel, "TASK_TRADES", 500)
    assert entries()[name][0](spark, sf).rdd.getNumPartitions() == panel.tasks(spark, sf) > 4
