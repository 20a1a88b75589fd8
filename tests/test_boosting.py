"""Trees over binned rows, against Spark's own on values that every learner splits at the same places."""

import datetime as dt

import numpy as np
import pytest

from tidepanel.plans import boosting as B
from tidepanel.plans import model as L

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def levels(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.permutation(np.arange(1600) % 8) for _ in range(4)], axis=1).astype(float)
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] * (x[:, 2] > 3) + 0.2 * rng.normal(size=1600)
    rows = [(*map(float, x[i]), float(y[i]), float(y[i] > 0.5)) for i in range(1600)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, z double").repartition(3).cache()


@pytest.mark.parametrize("target", ["y", "z"])
@pytest.mark.parametrize("kept", [25, 2])
def test_importances_are_sparks(levels, target, kept, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    monkeypatch.setattr(B, "KEPT_ROUNDS", kept)
    names = ["a", "b", "c", "d"]
    kind = GBTRegressor if target == "y" else GBTClassifier
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(levels).withColumnRenamed(target, "label")
    want = kind(maxDepth=3, maxIter=6, stepSize=0.1).fit(ready).featureImportances.toArray()
    L.S.checkpoints(levels.sparkSession)
    sign = levels.selectExpr(*names, "y" if target == "y" else "2 * z - 1 AS y")
    blocks = B.packed(sign, names, "y", B.cuts_of(levels, names))
    got, less = B.gains(blocks, [[0, 1, 2, 3], [1, 3]], 4, 3, 6, 0.1, target == "z")
    np.testing.assert_allclose(got / got.sum(), want, atol=1e-9)
    assert less[0] == less[2] == 0 < less[1]


def test_partitions_follow_rows_and_cores():
    assert [B.partitions(n, 20_000, 8) for n in (0, 1, 50_000, 2_000_000, 40_000_000)] == [1, 1, 3, 8, 80]


def test_selection_grows_all_iterations_in_one_job_a_level(spark):
    rng = np.random.default_rng(2)
    rows = [("A", DAY + dt.timedelta(days=i), *map(float, v), float(2 * (v[0] > 0) + 0.1 * v[2])) for i, v in enumerate(rng.normal(size=(500, 3)))]
    df = spark.createDataFrame(rows, "act_symbol string, date date, a double, b double, e double, y double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("shadows", "")
    try:
        assert L.shadow_selection(df, ["a", "b"], "y", iterations=5, rounds=4) == ["a"]
        assert len(tracker.getJobIdsForGroup("shadows")) < 4 * 4 + 15
        assert L.shadow_selection(df.selectExpr("act_symbol", "date", "a", "b", "double(a > 0) AS y"), ["a", "b"], "y", iterations=2, rounds=2, target_type="classification") == ["a"]
        with pytest.raises(ValueError):
            L.shadow_selection(df, ["a"], "y", target_type="other")
    finally:
        spark.sparkContext._jsc.clearJobGroup()

def test_shadows_are_those_of_the_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(f"S{i % 7}", DAY + dt.timedelta(days=i), float(i % 90), float(v), float(i)) for i, v in enumerate(rng.normal(size=3100))]
    df = spark.createDataFrame(rows, "act_symbol string, date date, a double, b double, y double")
    cuts = B.cuts_of(df, ["a", "b"])
    got = {}
    for x, y in L.shadow_blocks(df, ["a", "b"], "y", [42, 43], cuts, 3100, 3).collect():
        got |= {label: tuple(x[:, i]) for i, label in enumerate(y)}
    shadowed = L.shadowed(df, ["a", "b"], [42, 43]).toPandas()
    columns = ["a", "b", *[f"SHADOW_{i}_{c}" for i in (42, 43) for c in "ab"]]
    want = np.stack([np.searchsorted(cuts[k % 2], shadowed[c]) for k, c in enumerate(columns)], axis=1)
    assert got == {label: tuple(row) for label, row in zip(shadowed.y, want, strict=True)}


@pytest.mark.parametrize("columns", [[0, 1, 2], [2, 0], [1]])
def test_tables_of_pairs_are_the_columns_own(columns):
    rng = np.random.default_rng(6)
    x, r = rng.integers(0, B.BINS, (3, 500)).astype(np.uint8), rng.normal(size=500)
    tree = B.Tree(3)
    tree.feature[1], tree.bin[1], tree.feature[3], tree.bin[3] = 1, 10, 2, 20
    node = np.where(x[1] <= 10, 2, np.where(x[2] <= 20, 6, 7))
    assert (tree.nodes(x, 3) == node).all()
    got = B.tables(x, lambda part: r[part], tree, 2, columns, B.BINS)
    for n in range(4):
        here = node == 4 + n
        want = [[np.bincount(x[c, here], w[here], minlength=B.BINS) for c in columns] for w in (np.ones(500), r)]
        np.testing.assert_allclose(got[:, :, n], want, atol=1e-12)
    root = B.tables(x, lambda part: r[part], tree, 0, columns, B.BINS, count=False)
    np.testing.assert_allclose(root[:, :, 0], [[w * np.bincount(x[c], r, minlength=B.BINS) for c in columns] for w in (0, 1)], atol=1e-12)


@pytest.mark.parametrize("target", ["y", "z"])
def test_blocks_in_files_grow_the_trees_of_blocks_in_an_rdd(levels, target, monkeypatch):
    names = ["a", "b", "c", "d"]
    sign = levels.selectExpr(*names, "y" if target == "y" else "2 * z - 1 AS y")
    blocks = B.packed(sign, names, "y", B.cuts_of(levels, names))
    L.S.checkpoints(levels.sparkSession)
    made, folder = [], B.scratch.folder
    monkeypatch.setattr(B.scratch, "folder", lambda *a: made.append(folder(*a)) or made[-1])
    grow = lambda: B.gains(blocks, [[0, 1, 2, 3], [1, 3]], 4, 3, 6, 0.1, target == "z")
    mapped = grow()
    assert made[0].startswith("/") and not B.os.path.exists(made[0])
    monkeypatch.setattr(B.scratch, "folder", lambda *a: None)
    monkeypatch.setattr(B, "KEPT_ROUNDS", 2)
    np.testing.assert_allclose(mapped, grow(), rtol=1e-9)
