"""Moments from one pass over the rows, components from the moments."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.plans import model as L


def test_moments_and_components_read_the_rows_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) + [1e6, 0, 5, 0]
    x[:, 2] = 5 - 2 * (x[:, 0] - 1e6) + 0.1 * x[:, 1]
    x[:, 3] = 7.1
    x[5, 1] = x[9, 3] = np.nan
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    names = ["a", "b", "c", "d"]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double").repartition(3)
    df = df.withColumn("a", F.udf(counted, "double")("a"))
    want = pd.DataFrame(x, columns=names).corr().abs().fillna(0.0).to_numpy(copy=True)
    np.fill_diagonal(want, 1.0)
    np.testing.assert_allclose(L.correlations(df, names), want, atol=1e-9)
    assert seen.value == 400
    out, made = L.block_pca(df, names)
    got = out.orderBy("i").toPandas()
    assert seen.value == 800 and made == ["F_PCA_PC1_a_c", "b", "d"]
    z = pd.DataFrame(x[:, [0, 2]])
    z = ((z - z.mean()) / (z.std() + 1e-8)).fillna(0.0).to_numpy()
    # Two features of opposite signs load equally; the first one's is positive.
    np.testing.assert_allclose(got[made[0]], (z[:, 0] - z[:, 1]) / 2**0.5, atol=1e-6)


def test_sums_are_made_once_and_without_a_frame_of_30_rows(spark, sf, monkeypatch):
    from tidepanel.catalog import scans

    plan = scans.sums_of_30(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "-29" not in plan
    made, write = [], scans.scratch.written
    monkeypatch.setattr(scans.scratch, "written", lambda df, name: made.append(name) or write(df, name))
    out = scans.quantiles_of_sums(spark, sf)
    assert made == ["sums"] and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_split_panel_is_made_once(spark, sf):
    from tidepanel.catalog import evaluation

    plan = evaluation.study_model(spark, sf).split_data()._jdf.queryExecution().optimizedPlan().toString()
    assert "split" in plan or "parquet" in plan
    assert "lag(" not in plan and "act_symbol" in plan
