"""Readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.sources import feather as arrow


def database(spark: SparkSession, table: str, url: str = "jdbc:mysql://localhost:3306", user: str = "root", password: str = "", column: str | None = None, bounds: tuple | None = None, parts: int = 16) -> DataFrame:
    """A table over JDBC, read in parts where a column and its bounds are given; the driver jar must be present."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, user=user, password=password)
    if column and bounds:
        r = r.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return r.load()


def price_csv(spark: SparkSession, path: str, dollars: bool = True) -> DataFrame:
    """A single asset's CSV, newest row first, with ``$`` before prices: typed, renamed and with daily log returns."""
    raw = spark.read.csv(path, header=True)
    number = (lambda c: F.regexp_replace(F.col(f"`{c}`"), r"\$", "").cast("double")) if dollars else (lambda c: F.col(f"`{c}`").cast("double"))
    from pyspark.sql import Window as W

    out = raw.select(
        F.to_date("Date", "MM/dd/yyyy").alias("date"), number("Open").alias("open"), number("High").alias("high"), number("Low").alias("low"),
        number("Close/Last").alias("close"), *([number("Volume").alias("volume")] if "Volume" in raw.columns else []),
    )
    # One asset's history is a few thousand rows.
    return out.withColumn("log_ret", F.ln(F.col("close") / F.lag("close").over(W.orderBy("date")))).orderBy("date")


def splits_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "act_symbol string, ex_date date, to_factor double, for_factor double"
    return spark.read.csv(path, header=True, schema=schema)


def feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Feather file, or a folder of them; see :mod:`tidepanel.sources.feather`."""
    return arrow.read(spark, path, columns)


def _replaced(df: DataFrame, path: str, write) -> None:
    """Let ``write`` write to a folder beside ``path``, and put it in place when it is whole.

    So a failed write leaves the table as it was, and a table may be saved onto its own source.
    """
    context = df.sparkSession.sparkContext
    at = lambda p: context._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(context._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    fresh, old = (f"{path.rstrip('/')}._{k}-{mark}" for k in ("new", "old"))
    try:
        write(fresh)
        if files.exists(at(path)):
            files.rename(at(path), at(old))
        files.rename(at(fresh), at(path))
        files.delete(at(old), True)
    finally:
        files.delete(at(fresh), True)


def save(df: DataFrame, path: str) -> None:
    """Write by extension: ``.csv``, ``.parquet`` or ``.feather``, each a folder; others raise.

    A table is replaced only when the new one is whole.  Feather needs a path that the driver and all executors share.
    """
    if path.endswith(".csv"):
        _replaced(df, path, lambda p: df.write.csv(p, header=True))
    elif path.endswith(".parquet"):
        _replaced(df, path, lambda p: df.write.parquet(p))
    elif path.endswith(".feather"):
        arrow.write(df, path)
    else:
        raise ValueError(f"unknown extension: {path}")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
