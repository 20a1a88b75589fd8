"""The number of runs of the join by chosen paths, and of tasks of the rounds over blocks."""

import math
import re

from tidepanel.llm import jaccard_join


def test_runs_are_enough_at_the_deepest_level():
    shared = jaccard_join.UP / jaccard_join.DOWN / jaccard_join.DENSITY
    miss = 0.0
    for _ in range(jaccard_join.DEPTH):
        miss = math.exp(-shared * (1 - miss))
    assert miss**jaccard_join.RUNS < 3e-6
    assert len(set(jaccard_join.SEEDS)) == jaccard_join.RUNS


def test_rounds_take_as_many_tasks_as_bytes_ask_for(spark, sf, monkeypatch):
    from tidepanel.llm import _rounds, substring_dedup, suffix_dedup

    queries = (substring_dedup.op3_difference_cover, suffix_dedup.op4_prefix_free_parsing)
    before = [sorted(map(tuple, q(spark, sf).collect())) for q in queries]
    monkeypatch.setattr(_rounds, "TASK_BYTES", 20_000)
    frames = [q(spark, sf) for q in queries]
    assert [sorted(map(tuple, f.collect())) for f in frames] == before
    dealt = {n for f in frames for n in re.findall(r"hashpartitioning\(block#\d+, (\d+)\)", f._jdf.queryExecution().executedPlan().toString())}
    assert len(dealt) == 1 and int(dealt.pop()) > 4
