"""The benchmark join by shuffles, against a plain version and against the broadcast one."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate


def tables(spark, docs, items):
    extra = {c: F.lit(1) for c in ("ord", "word", "window", "spots", "places", "found", "n", "_text")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra), spark.createDataFrame(items, "item_id string, text string").withColumns(extra)


def results(spark, docs, items):
    return {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(*tables(spark, docs, items), unnamed=True).collect()}


@pytest.mark.parametrize("words", [2, 12, 400])
def test_join_matches_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    rnd = random.Random(words)
    text = lambda n: " ".join(rnd.choice("wW") + str(rnd.randrange(words)) for _ in range(n))
    items = [(f"i{k}", text(rnd.choice([1, 2, 3, 12, 13, 14, 20, 60]))) for k in range(40)] + [("i0", "w1 w0"), ("none", None), ("empty", " , "), (None, "w1 w1 w0")]
    docs = [(k, text(rnd.choice([0, 1, 2, 5, 13, 30, 200]))) for k in range(60)]
    docs += [(100 + k, f"{text(5)} {rnd.choice(items)[1]} {text(5)}") for k in range(40)] + [(200, None), (201, ", ."), (202, "W1 " * 3000)]
    want = brute.contaminated(docs, items)
    assert results(spark, docs, items) == want and sum(w[3] for w in want.values()) > 10


def test_join_of_repeated_rows_and_null_ids(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, passage), (1, passage), (None, f"a {passage}"), (None, None), (2, "p1 p2 p3")]
    items = [("x", passage), ("x", passage), ("y", f"{passage} more")]
    found = []
    for most in (200_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
        out = decontaminate.contamination(*tables(spark, docs, items)).collect()
        found.append(sorted(map(repr, out)))
        assert sum(r.contaminated for r in out) == 3 and len(out) == 5
    assert found[0] == found[1]


def test_join_of_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    docs, items = tables(spark, [(1, "a b c"), (2, None)], [("x", "a b")])
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(docs, items.limit(0)).orderBy("doc_id").collect()] == [(3, 0), (0, 0)]
