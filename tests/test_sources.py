"""Files: Feather as a data source, and writes that replace a table only when they are whole."""

import datetime as dt
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.sources import feather, io

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def table(spark):
    rows = [(i, f"s{i % 7}" if i % 5 else None, i / 3, dt.date(2020, 1, 1) + dt.timedelta(days=i), i % 2 == 0) for i in range(500)]
    return spark.createDataFrame(rows, "i long, s string, x double, d date, b boolean").repartition(3)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "t.feather")
    feather.register(spark)
    table.write.format("feather").mode("overwrite").save(path)
    got = spark.read.format("feather").load(path)
    assert got.schema == table.schema and same(got, table)
    table.where("i < 10").write.format("feather").mode("append").save(path)
    assert spark.read.format("feather").load(path).count() == 510
    feather.write(table.where("i < 3"), path)
    assert feather.read(spark, path).count() == 3
    feather.write(table.limit(0), path)
    assert feather.read(spark, path).count() == 0 and feather.read(spark, path).schema == table.schema


def test_a_partition_is_a_record_batch_and_columns_are_pruned(spark, table, tmp_path, monkeypatch):
    path = str(tmp_path / "one.feather")
    batches = table.coalesce(1).toArrow().combine_chunks().to_batches(max_chunksize=50)
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    got = feather.read(spark, path, ["x", "i"])
    assert got.rdd.getNumPartitions() == 10 and got.columns == ["x", "i"] and same(got, table.select("x", "i"))
    reader = feather.Reader(path, ["i"])
    assert [b.schema.names for b in reader.read(reader.partitions()[3])] == [["i"]]


def test_filters_are_pushed(spark, table, tmp_path):
    path = str(tmp_path / "f.feather")
    feather.write(table, path)
    tests = ["i = 7", "i > 490 and s is not null", "x <= 3.0", "s in ('s1', 's2') and i < 40", "s is null and i >= 480", "d > date'2021-03-01'", "s like 's3%' and i < 30"]
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    try:
        for t in tests:
            assert same(feather.read(spark, path).where(t), table.where(t)), t
        # What the source has taken over is no filter of the plan any more.
        plan = lambda t: feather.read(spark, path).where(t)._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan("i > 490") and "Filter (" in plan("i + 1 > 490")
    finally:
        spark.conf.set(PUSHDOWN, before)
    assert "Filter (" in plan("i > 490") and all(same(feather.read(spark, path).where(t), table.where(t)) for t in tests[:2])


@pytest.mark.parametrize("name", ["t.feather", "t.parquet", "t.csv"])
def test_a_failed_write_leaves_the_table(spark, table, tmp_path, name):
    path = str(tmp_path / name)
    read = lambda: feather.read(spark, path) if name.endswith("feather") else spark.read.format(name[2:]).load(path)
    io.save(table, path)
    before = sorted(map(str, read().collect()))
    broken = table.withColumn("x", F.when(F.col("i") == 321, F.raise_error(F.lit("broken"))).otherwise(F.col("x")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        io.save(broken, path)
    assert sorted(map(str, read().collect())) == before and os.listdir(tmp_path) == [name]


@pytest.mark.parametrize("name", ["t.feather", "t.parquet"])
def test_a_table_may_be_saved_onto_itself(spark, table, tmp_path, name):
    path = str(tmp_path / name)
    io.save(table, path)
    old = io.feather(spark, path) if name.endswith("feather") else spark.read.parquet(path)
    io.save(old.where("i < 100"), path)
    new = io.feather(spark, path) if name.endswith("feather") else spark.read.parquet(path)
    assert new.count() == 100


def test_database_options(spark, monkeypatch):
    """Parts follow from a column and its bounds; no server is asked."""
    asked = {}

    class Reader:
        def format(self, name):
            asked["format"] = name
            return self

        def options(self, **more):
            asked.update(more)
            return self

        def load(self):
            return asked

    session = type("Session", (), {"read": Reader()})()
    assert io.database(session, "ohlcv", url="jdbc:mysql://h:1/db", column="date", bounds=("2020-01-01", "2021-01-01"), parts=4)["numPartitions"] == "4"
    assert asked["dbtable"] == "ohlcv" and asked["partitionColumn"] == "date" and asked["format"] == "jdbc"


def test_database_reads_a_table_in_parts(spark, tmp_path):
    """Against a Derby database, whose driver comes with Spark: all rows, each once, with pruned columns and a pushed filter."""
    url, driver = f"jdbc:derby:{tmp_path}/db", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, f"s{i % 7}" if i % 5 else None, i / 4, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(300)]
    bars = spark.createDataFrame(rows, "id long, act_symbol string, price double, day date")
    bars.coalesce(1).write.format("jdbc").options(url=url + ";create=true", dbtable="ohlcv", **driver).save()
    whole = io.database(spark, "ohlcv", url=url, user="APP", password="x")
    assert whole.rdd.getNumPartitions() == 1 and same(whole, bars)
    dealt = io.database(spark, "ohlcv", url=url, user="APP", password="x", column="id", bounds=(50, 250), parts=4)
    assert dealt.rdd.getNumPartitions() == 4 and same(dealt, bars)
    one = dealt.where("price > 70").select("act_symbol")
    assert same(one, bars.where("price > 70").select("act_symbol"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan and "day" not in plan
    empty = io.database(spark, "(select * from ohlcv where \"id\" < 0) t", url=url, user="APP", password="x")
    assert empty.count() == 0 and [f.name.lower() for f in empty.schema] == bars.columns


def test_a_saved_model_predicts_as_before(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressionModel, GBTRegressor

    rows = [(float(i % 13), float(i % 7), float(i % 13 * 2 - i % 7)) for i in range(200)]
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double"))
    path = str(tmp_path / "model")
    fitted = [GBTRegressor(maxIter=n, maxDepth=3, seed=1).fit(data) for n in (2, 4)]
    for model in fitted:  # the second replaces the first
        io.save_model(model, path)
    got = GBTRegressionModel.load(path).transform(data).select("a", "b", "prediction")
    assert same(got, fitted[1].transform(data).select("a", "b", "prediction")) and not same(got, fitted[0].transform(data).select("a", "b", "prediction"))
