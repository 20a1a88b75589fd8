"""The latest minute from a stream with state, against the batch query."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.sources import scans
from tidepanel.streaming import latest as L

SCHEMA = "ticker string, ts timestamp, seq long, price double"


@pytest.fixture
def store(spark):
    before = spark.conf.get(L.STORE[0])
    spark.conf.set(*L.STORE)
    yield
    spark.conf.set(L.STORE[0], before)


def run(spark, tmp_path, **more):
    """One run over the files that are there, from the last run's checkpoint on."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
    q = L.latest(stream, **more).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(seen).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_two_runs_equal_the_batch(spark, store, tmp_path):
    rng = random.Random(3)
    at = lambda s: dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(seconds=s)
    ticks = [(t, at(rng.randrange(900)), i, float(rng.randrange(100))) for i, t in enumerate(rng.choices("ABCD", k=400))]
    ticks += rng.sample(ticks, 80)
    rng.shuffle(ticks)
    ticks += [(None, at(5), 1000, 1.0), ("A", None, 1001, 1.0), ("B", at(899), 1002, None)]
    for k, part in enumerate((ticks[:150], ticks[150:250], ticks[250:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k:
            run(spark, tmp_path, late="1 hour")
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("ticker").agg(F.max_by(F.struct("open", "start"), "batch").alias("x")).select("ticker", "x.*")
    whole = spark.createDataFrame(ticks, SCHEMA).na.drop()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scans.latest(whole).collect()))


def test_a_silent_ticker_is_forgotten(spark, store, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=m)
    for rows in ([("A", at(0), 1, 1.0), ("B", at(0), 2, 2.0)], [("B", at(300), 3, 3.0)], [("B", at(301), 4, 4.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, tmp_path, late="1 minute", keep_ms=3_600_000)
    assert {r.ticker for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"A", "B"}
    state = spark.read.format("statestore").option("stateVarName", "latest").load(str(tmp_path / "state"))
    assert [r[0] for r in state.select("key.ticker").collect()] == ["B"]
