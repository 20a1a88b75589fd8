"""Operators that SQL can express, against DuckDB; and the pipeline against plain versions of its stages."""

from collections import Counter

import brute
import corpus_pipeline
import pytest
from compare import connect, differences

from tidepanel.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert not differences(queries.queries()[name](spark, sf), SQL[name], connect(sf))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    single = stages["jaccard_join"](spark, kept, sf)
    classes = brute.components(brute.jaccard_links(rows))
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    clean = stages["decontamination"](spark, single, sf)
    dirty = {r.doc_id for r in queries.queries()["op8_prefix_filtered_join"](spark, sf).collect() if r.contaminated}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(classes.values()) - dirty)
    mixed = stages["mixing"](spark, clean, sf)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    out = stages["sharding"](spark, mixed, sf)
    assert out.count() == mixed.count() and {r.shard for r in out.collect()} <= set(range(40))


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
