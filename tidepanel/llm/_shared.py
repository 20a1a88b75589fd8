"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Joins by id ship ids, with a few numbers at most, to every executor up to this many rows, and shuffle beyond it.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """This application's folder that all executors see, in ``spark.checkpoint.dir``; a local one on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "/tmp/checkpoints"
    return f"{where.rstrip('/')}/tidepanel/{spark.sparkContext.applicationId}"


def long_rows(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has the default of 10,000, as rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again; this cuts the lineage for good.

    The application's folder goes when it ends; :func:`discard` frees a table that nothing will read any more.
    """
    spark = df.sparkSession
    files, folder = _path(spark, shared_dir(spark))
    files.deleteOnExit(folder)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` whose last reader has been written."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if f"/tidepanel/{spark.sparkContext.applicationId}/" in path:
                files, folder = _path(spark, path)
                files.delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prime_at_least(n: int) -> int:
    """The least prime >= n, so that ids with a common step still spread over all blocks."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def let(value: F.Column, body) -> F.Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """``(ord, doc_id, text)``, with ``rows`` also ``row``, a struct of all columns.

    ``ord`` is a non-null long in the order of doc_id.  Where doc_id is unique and not null, it is ``ord`` itself.
    Otherwise (checked by one light count) documents are numbered by (doc_id with nulls last, hash of the text); rows
    that repeat both id and text share a number.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    long_rows(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *whole)
    if not repeats(d, "doc_id"):
        return d.select(F.col("doc_id").alias("ord"), *d.columns)
    d = d.withColumn("_h", F.xxhash64("text"))
    keys = d.select("doc_id", "_h").distinct()
    numbered = materialize(numbered_rows(keys, [F.col("doc_id").asc_nulls_last(), F.col("_h").asc()], "ord"), "numbered")
    n = numbered.select("ord", F.col("doc_id").alias("_i"), F.col("_h").alias("_g"))
    return d.join(n, d["doc_id"].eqNullSafe(n["_i"]) & (d["_h"] == n["_g"])).drop("_h", "_i", "_g").select("ord", "doc_id", "text", *["row"] * rows)


def repeats(df: DataFrame, key: str) -> bool:
    """Whether a value of ``key`` is null or comes twice."""
    n = F.when(F.col(key).isNull(), F.lit(2)).otherwise(F.count("*"))
    return (df.groupBy(key).agg(n.alias("n")).agg(F.max("n")).first()[0] or 0) > 1


def numbered_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number rows 0.. in the order given, without one task seeing them all: range partitions, each counted."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).drop("_n")
    within = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1)
    return within.join(before, "_p").withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_r", "_before")


def keep_ids(df: DataFrame, ids: DataFrame, key, how: str = "inner") -> DataFrame:
    """Join on ``key``; ``ids`` is broadcast only if it was counted and is at most ``BROADCAST_ROWS`` rows.

    A row of ``ids`` is of fixed width: ids and numbers, no text and no list that grows.
    """
    small = ids.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, key, how)


def join_counted(rows: DataFrame, counts: DataFrame, key, count: str, limit: int = 1024) -> DataFrame:
    """``rows`` joined with a written table of one row of fixed width a key, whose ``count`` says how many rows have it.

    A key of more than ``limit`` rows would gather them in one task.  There is at most one such key to ``limit`` rows;
    they are joined first (by broadcast, if few enough), and only the other keys' rows are dealt by key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = counts.where(F.col(count) > limit)
    if not hot.count():
        return rows.join(counts, keys)
    cold = keep_ids(rows, hot.select(*keys), keys, "left_anti").join(counts.where(F.col(count) <= limit), keys)
    return cold.unionByName(keep_ids(rows, hot, keys))
