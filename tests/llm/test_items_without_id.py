"""Benchmark items without an id, against the operator's SQL."""

import corpus_pipeline
import duckdb
import pytest
from compare import differences

from tidepanel.llm import decontaminate

PASSAGE = " ".join(f"passage{i}" for i in range(20))
NAMED = " ".join(f"named{i}" for i in range(15))


@pytest.mark.parametrize("at_once", [200_000, 5])
def test_items_without_id_hit(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", at_once)
    docs = [(1, f"before {PASSAGE} after"), (2, f"{NAMED} and {PASSAGE}"), (3, "nothing of either"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, PASSAGE), (None, PASSAGE + " end"), ("x", NAMED), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = decontaminate.op8_prefix_filtered_join(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].contaminated and got[2].contaminated and not got[3].contaminated and got[2].n_hit == 35
    assert not differences(out, decontaminate.ORACLE_SQL, con)


def test_pipeline_drops_documents_with_passages_without_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"before {PASSAGE} after"), (3, "nothing of either")], "doc_id long, text string")
    spark.createDataFrame([(None, PASSAGE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [3]
