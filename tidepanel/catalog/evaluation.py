"""Chronological splits, evaluation of a surrogate prediction, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.base import BARS, BASE, q6, r6, rounded
from tidepanel.catalog.features import STUDY, STUDY_COLUMNS, full, study_sql
from tidepanel.plans import evaluation as E
from tidepanel.plans import model as M
from tidepanel.plans.features import FeatureEngine, FeatureRequest
from tidepanel.sources import panel as P
from tidepanel.sources import scratch

#: Yesterday's close by today's, and the next bar's return: exact arithmetic, so that ties fall alike.
PRED = FeatureRequest("ROC", {"timeperiod": 3}, -1, "raw", alias="pred")
TARGET = FeatureRequest("ROC", {"timeperiod": 1}, 1, "raw", alias="target")
X = f"""WITH {BASE}, y AS (SELECT act_symbol, date, 100 * (close / lag(close, 3) OVER s - 1) AS v, 100 * (close / lag(close) OVER s - 1) AS u FROM b WINDOW s AS (PARTITION BY act_symbol ORDER BY date)),
x AS MATERIALIZED (SELECT act_symbol, date, lag(v) OVER s AS pred, lead(u) OVER s AS target FROM y WINDOW s AS (PARTITION BY act_symbol ORDER BY date)),
z AS MATERIALIZED (SELECT * FROM x WHERE pred IS NOT NULL AND target IS NOT NULL)"""
RANKS = "(rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0)"
IC = f"""{X}, r AS (SELECT date, {RANKS.format(c='pred')} AS a, {RANKS.format(c='target')} AS c FROM z),
ic AS (SELECT date, covar_samp(a, c) / sqrt(var_samp(a) * var_samp(c)) AS ic FROM r GROUP BY 1 HAVING count(*) > 1 AND var_samp(a) > 0 AND var_samp(c) > 0)"""
Q = 5
#: Boosting rounds; training ends earlier when the validation part no longer gains.
ROUNDS = 100
TRIALS = 50
BINS = f"""{X}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred, act_symbol) AS r, count(*) OVER (PARTITION BY date) AS n FROM z),
g AS (SELECT act_symbol, date, pred, target, CASE WHEN n > 1 THEN greatest(1, ((r - 1) * {Q} + n - 2) // greatest(n - 1, 1)) END AS bin FROM k)"""
PIVOT = f"""{BINS}, pv AS (SELECT date, {', '.join(f'avg(target) FILTER (bin = {i}) AS q{i}' for i in range(1, Q + 1))} FROM g WHERE bin IS NOT NULL GROUP BY 1),
full_ AS (SELECT * FROM pv WHERE {' AND '.join(f'q{i} IS NOT NULL' for i in range(1, Q + 1))})"""


def predictions(s, d):
    out = FeatureEngine([PRED, TARGET]).compute(P.bars(s, d))
    return out.select("act_symbol", "date", F.col(PRED.columns()[0]).alias("pred"), F.col(TARGET.columns()[0]).alias("target"))


def complete(s, d):
    return E.complete(predictions(s, d), ["pred", "target"])


def named(s, d):
    """Four features and the target under plain names, complete rows only."""
    out = FeatureEngine(STUDY).compute(P.bars(s, d))
    cols = [r.columns()[0] for r in STUDY]
    return out.select("act_symbol", "date", *[F.col(f"`{c}`").alias(c) for c in cols]).na.drop(), cols[:-1], cols[-1]


def corr_matrix(s, d):
    df, features, _ = named(s, d)
    c = M.correlations(df, features)
    rows = [(a, b, float(c[i, j])) for i, a in enumerate(features) for j, b in enumerate(features)]
    return rounded(s.createDataFrame(rows, "a string, b string, corr double"), "corr")


CORRELATIONS = f"""{study_sql()}, c AS (SELECT * FROM study WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND f4 IS NOT NULL)
""" + " UNION ALL ".join(f"SELECT '{STUDY_COLUMNS[i]}' AS a, '{STUDY_COLUMNS[j]}' AS b, round(abs(corr(f{i}, f{j})) + 1e-8, 6) + 0.0 AS corr FROM c" if i != j else f"SELECT '{STUDY_COLUMNS[i]}' AS a, '{STUDY_COLUMNS[i]}' AS b, round(1.0 + 1e-8, 6) + 0.0 AS corr" for i in range(4) for j in range(4))


#: Correlations from which one of two features goes.
ALIKE = 0.3


def reduced(s, d):
    df, features, _ = named(s, d)
    return s.createDataFrame([(f,) for f in M.kuhn_johnson(df, features, ALIKE)], "feature string")


def reduced_sql() -> str:
    """Three steps, as four features have no more: of the most alike pair goes the one more alike to the rest."""
    pairs = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, abs(corr(f{i}, f{j})) AS c FROM c" for i in range(4) for j in range(4) if i != j)
    sql = CORRELATIONS.split(" UNION ALL ")[0].rsplit("\n", 1)[0] + f", m AS MATERIALIZED ({pairs}), l0 AS (SELECT unnest(range(4)) AS i)"
    for k in range(3):
        sql += f""", t{k} AS MATERIALIZED (SELECT i, j FROM m WHERE i < j AND c >= {ALIKE} AND i IN (SELECT i FROM l{k}) AND j IN (SELECT i FROM l{k}) ORDER BY c DESC, i, j LIMIT 1),
o{k} AS (SELECT t.i, t.j, coalesce(avg(m.c) FILTER (m.i = t.i), 0) AS a, coalesce(avg(m.c) FILTER (m.i = t.j), 0) AS b FROM t{k} t LEFT JOIN m ON m.i IN (t.i, t.j) AND m.j NOT IN (t.i, t.j) AND m.j IN (SELECT i FROM l{k}) GROUP BY 1, 2),
l{k + 1} AS MATERIALIZED (SELECT i FROM l{k} WHERE i NOT IN (SELECT CASE WHEN a > b THEN i ELSE j END FROM o{k}))"""
    return sql + " SELECT [" + ", ".join(f"'{c}'" for c in STUDY_COLUMNS[:4]) + "][i + 1] AS feature FROM l3"


def pca(s, d):
    df, features, _ = named(s, d)
    out, names = M.block_pca(df, features, 0.05)
    return rounded(out.select("act_symbol", "date", *names), *names)


def shadows(s, d):
    df, features, target = named(s, d)
    chosen = M.shadow_selection(E.split_dates(scratch.written(df, "study")), features, target, iterations=5, rounds=ROUNDS)
    return s.createDataFrame([(f, f in chosen) for f in features], "feature string, chosen boolean")


def study_model(s, d):
    m = M.Model(P.bars(s, d))
    m.add_features(STUDY[:-1])
    m.add_target(STUDY[-1])
    return m


def tuned(s, d):
    """The best of 50 trials on the study's features."""
    m = study_model(s, d)
    best = m.tune_params(m.split_data(), trials=TRIALS)
    return rounded(s.createDataFrame([(best["depth"], best["step"], best["rounds"], best["loss"])], "depth long, step double, rounds long, loss double"), "loss")


def trained(s, d):
    m = study_model(s, d)
    split = m.split_data()
    return rounded(E.metrics(m.predictions(m.train_model(split, rounds=ROUNDS), split)), "rmse", "directional_accuracy", "accuracy", "roc_auc")


ENTRIES = {
    "eval_split_dates": (lambda s, d: E.split_dates(P.bars(s, d).select("act_symbol", "date")), f"WITH {BARS}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)) SELECT act_symbol, date, CASE WHEN i < floor(n * 0.7 + 1e-9) THEN 'train' WHEN i < floor(n * 0.85 + 1e-9) THEN 'val' WHEN i < n - 1 THEN 'test' END AS part FROM bars JOIN dd USING (date)"),
    "eval_metrics": (lambda s, d: rounded(E.metrics(complete(s, d)), "rmse", "directional_accuracy", "accuracy", "roc_auc"), f"""{X}, k AS (SELECT *, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS r FROM z)
SELECT round(sqrt(avg((pred - target) * (pred - target))) + 1e-8, 6) + 0.0 AS rmse, round(avg((sign(pred) = sign(target))::INT) + 1e-8, 6) + 0.0 AS directional_accuracy, round(avg(((pred > 0.5) = (target > 0))::INT) + 1e-8, 6) + 0.0 AS accuracy,
  round((sum(r) FILTER (target > 0) - count(*) FILTER (target > 0) * (count(*) FILTER (target > 0) + 1) / 2.0) / (count(*) FILTER (target > 0) * (count(*) - count(*) FILTER (target > 0))) + 1e-8, 6) + 0.0 AS roc_auc FROM k"""),
    "eval_daily_ic": (lambda s, d: rounded(E.daily_ic(predictions(s, d)), "ic"), f"{IC} SELECT date, {q6('ic')} FROM ic"),
    "eval_robust_ic": (lambda s, d: rounded(E.robust_ic(predictions(s, d), 5), "mean_ic", "std_ic", "ir", "ir_annual", "t_stat"), f"{IC}, m AS (SELECT count(*) AS n_days, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic FROM ic) SELECT n_days, {q6('mean_ic', 'std_ic')}, round(mean_ic / std_ic + 1e-8, 6) + 0.0 AS ir, round(mean_ic / std_ic * sqrt(252 / 5) + 1e-8, 6) + 0.0 AS ir_annual, round(mean_ic / std_ic * sqrt(n_days / 5) + 1e-8, 6) + 0.0 AS t_stat FROM m"),
    "eval_quantile_bins": (lambda s, d: E.binned(predictions(s, d), Q).select("act_symbol", "date", F.col("bin").cast("long").alias("bin")), f"{BINS} SELECT act_symbol, date, bin::BIGINT AS bin FROM g"),
    "eval_quantile_returns": (lambda s, d: rounded(E.quantile_returns(predictions(s, d), Q), *[f"q{i}" for i in range(1, Q + 1)]), f"{PIVOT} SELECT date, {q6(*[f'q{i}' for i in range(1, Q + 1)])} FROM full_"),
    "eval_quantile_spread": (lambda s, d: rounded(E.quantile_spread(predictions(s, d), Q, 5), "mean_spread", "win_rate", "sharpe"), f"{PIVOT}, w AS (SELECT q{Q} - q1 AS s FROM full_) SELECT count(*) AS n_days, round(avg(s) + 1e-8, 6) + 0.0 AS mean_spread, round(avg((s > 0)::INT) + 1e-8, 6) + 0.0 AS win_rate, round(avg(s) / stddev_samp(s) * sqrt(252 / 5) + 1e-8, 6) + 0.0 AS sharpe FROM w"),
    "eval_cumulative_spread": (lambda s, d: rounded(E.cumulative_spread(predictions(s, d), Q), "spread", "cumulative"), f"{PIVOT} SELECT date, round(q{Q} - q1 + 1e-8, 6) + 0.0 AS spread, round(sum(q{Q} - q1) OVER (ORDER BY date) + 1e-8, 6) + 0.0 AS cumulative FROM full_"),
    "eval_complete_rows": (lambda s, d: complete(s, d).select("act_symbol", "date", r6(F.col("pred")).alias("pred")), f"{X} SELECT act_symbol, date, {q6('pred')} FROM z"),
    "eval_feature_moments": (lambda s, d: rounded(complete(s, d).agg(F.avg("pred").alias("mean"), (F.stddev_samp("pred") + 1e-8).alias("sd"), F.corr("pred", "target").alias("corr")), "mean", "sd", "corr"), f"{X} SELECT round(avg(pred) + 1e-8, 6) + 0.0 AS mean, round(stddev_samp(pred) + 1e-8 + 1e-8, 6) + 0.0 AS sd, round(corr(pred, target) + 1e-8, 6) + 0.0 AS corr FROM z"),
    "model_correlations": (corr_matrix, CORRELATIONS),
    "model_kuhn_johnson": (reduced, reduced_sql()),
    "model_block_pca": (pca, None),
    "model_shadow_selection": (shadows, None),
    "model_trained_metrics": (trained, None),
    "model_tuned_params": (tuned, None),
}
