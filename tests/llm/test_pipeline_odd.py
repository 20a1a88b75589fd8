"""The pipeline's stages, and operators with thin tests, on odd tables."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate, fingerprint, jaccard_join, line_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
ENGLISH = "the people of the town went to the market in the morning and they talked about the weather and the harvest of the year"
GERMAN = "die leute aus der stadt gingen am morgen auf den markt und sprachen über das wetter und die ernte des vergangenen jahres"


def rows():
    out = [(i, f"{ENGLISH} number {i} {'and so on ' * (i % 5)}{i * 7}", "en", "a") for i in range(40)]
    out += [(100 + i, f"{GERMAN} nummer {i} {'und so weiter ' * (i % 5)}{i * 7}", "de", "b") for i in range(40)]
    out += [(200, None, "en", "a"), (201, "", None, None), (202, "12 34 !!", "de", None), (203, ENGLISH + " " + GERMAN, None, None)]
    # Rows that repeat an id, rows that repeat altogether, null ids.
    out += [(0, out[0][1], "en", "a"), (0, out[0][1], "en", "a"), (1, "a wholly different text under the id of another " * 3, "en", "a"), (None, out[5][1], "en", "a"), (None, GERMAN + " ohne nummer", None, "b")]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


@pytest.fixture
def folder(spark, tmp_path):
    def write(docs, items):
        spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit(1) for c in ("ord", "row", "_text", "_k0", "times")}).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_stages_take_odd_rows(spark, folder):
    where = folder(rows(), [(1, GERMAN), (None, "wholly different text under the id of another a wholly different text under"), (2, None)])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, where)
        assert docs.columns == spark.read.parquet(f"{where}/documents.parquet").columns
        kept = [r.text for r in docs.collect()]
        if name == "language_id":
            # Texts without a letter go, null and empty ones too; nothing else does.
            assert sorted(kept) == sorted(r[1] for r in rows() if r[1] and any(c.isalpha() for c in r[1]))
        if name == "jaccard_join":
            assert 0 < len(kept) < before
            links = brute.jaccard_links(list(enumerate(kept)))
            assert not any(links.values()) and len(kept) == len(set(kept))
        if name == "decontamination":
            assert not any(GERMAN in t or "wholly different" in t for t in kept) and any(ENGLISH in t for t in kept)
    out = corpus_pipeline.run(spark, where)
    assert out.count() == docs.count() and out.columns[-1] == "slot"


def test_pipeline_of_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0


def test_pipeline_with_an_empty_benchmark(spark, folder):
    assert corpus_pipeline.run(spark, folder(rows(), [])).count() > 0


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    items = spark.createDataFrame([(1, GERMAN)], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    got = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(got) == docs.count() and not any(r.contaminated or r.n_hit for r in got)


def test_odd_rows_have_stated_results(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    lines = line_dedup.dedup_lines(docs).collect()
    assert len(lines) == docs.count() and {r.n_removed_lines for r in lines} == {0}
    runs = line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb\nc"), (None, "x\na\nb"), (1, "a\nb\nc"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed_lines) for r in runs) == [(0, 2), (1, 0), (1, 0), (2, 0)]
    sizes = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs).collect()}
    assert sizes[200, 0] == sizes[201, 0] == 0 and sum(n for _, n in sizes) > 0
    placed = sharding.shard(docs, shards=3, slots=16).collect()
    assert all(sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed))) for s in range(3))
    same = [(r.shard, r.vslot) for r in placed if r.doc_id == 0]
    assert len(same) == 3 and len(set(same)) == 1
    prints = fingerprint.fingerprints(docs).collect()
    assert len(prints) == docs.count() and len({str(r.print) for r in prints if r.doc_id == 0}) == 1
    assert all(r.print.kept == [] and r.print.n == 0 for r in prints if r.doc_id in (200, 201))


def test_runs_follow_from_the_recall():
    assert jaccard_join.runs_for(jaccard_join.RECALL) == jaccard_join.RUNS == 12
    assert jaccard_join.runs_for(0.5) == 1 < jaccard_join.runs_for(0.9) < jaccard_join.runs_for(0.999)
    for recall in (0.9, 0.99, 0.9999):
        assert 1 - jaccard_join.miss_of_a_run() ** jaccard_join.runs_for(recall) >= recall
