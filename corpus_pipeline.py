"""The corpus pipeline: its stages in order, each over all that its predecessor kept.

Documents that language ID rejects go; one document of each group of near-duplicates stays; documents contaminated by
the benchmark go; the mix repeats or leaves out documents until each source is near its target; shards are assigned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from tidepanel.llm._shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, as they are.

    Null and empty texts and texts without a letter go, and those far from every language.  A row is judged by its text
    alone, so repeated rows, repeated or null ids and ties stay or go together.  An empty table gives an empty one.
    """
    found = language_id.identify(docs, language_id.learned(docs), keep=tuple(docs.columns))
    return found.where("not rejected").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates.

    Texts without words are near nothing and stay.  Groups are led by the smallest id; where ids repeat or are null, by
    (id with nulls last, hash of the text), and rows that repeat id and text stay once.  An empty table gives an empty one.
    """
    return jaccard_join.first_of_each(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts have no words and stay.  Benchmark items without an id count, those without a text don't; with an
    empty benchmark every document stays.  Repeated rows are judged alike, and all stay or go.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, benchmark, keep=tuple(docs.columns), unnamed=True).where("not contaminated").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule.

    A null source is one of its own, the last.  Documents without words are never taken.  Ties follow the schedule's
    hashes, rows that repeat id and text are taken alike, and reruns agree.  An empty table gives an empty one.
    """
    return mixing.mixed_rows(docs).select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its slot there; null texts count 16 bytes.

    Rows that repeat id and text lie in one shard, null ids are spread by their texts, and ties are ordered by crc and size.
    An empty table gives an empty one.
    """
    return sharding.shard(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]

#: No SQL expresses a fitted classifier and a hashed placement; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
