"""Where intermediate tables lie: a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it a local master takes a folder of its own, and others raise."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (where or "/tmp/checkpoints").rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path for a table that goes with the application."""
    context = spark.sparkContext
    folder = f"{root(spark)}/panel/{context.applicationId}"
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/{uuid.uuid4().hex}-{name}"


def folder(spark: SparkSession, name: str) -> str | None:
    """A path of its own for plain files of tasks, or None where the scratch folder is no file system of the machines."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh(spark, name))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.toUri().getPath() if files.getUri().getScheme() == "file" else None


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the scratch folder and read again, so that what reads it several times makes it once."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, wanted: int | None) -> int:
    """``wanted``, or the session's partitions."""
    return wanted or int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, name: str, keys: tuple[str, ...], wanted: int | None = None) -> DataFrame:
    """As :func:`written`, in buckets by ``keys``: what meets by them needs no exchange, however often the table is read.

    A task writes a file for each bucket that it has rows of: one, if rows already lie by ``keys`` in as many tasks.
    """
    spark = df.sparkSession
    table = f"scratch_{uuid.uuid4().hex}"
    df.write.bucketBy(tasks(spark, wanted), *keys).format("parquet").option("path", fresh(spark, name)).saveAsTable(table)
    out = spark.table(table)
    # The files stay; only the name goes.
    spark.sql(f"DROP TABLE {table}")
    return out
