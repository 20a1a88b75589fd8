"""Training, tuning and selection with trees that are really grown."""

import datetime as dt

import numpy as np
import pytest

from tidepanel.catalog import evaluation
from tidepanel.plans import model as L

DAY = dt.date(2020, 1, 1)


class Given(L.Model):
    """A model over columns that are there already."""

    def __init__(self, data, features, target, kind="regression"):
        super().__init__(data)
        self.names, self.aim, self.target_type = features, target, kind

    def feature_names(self):
        return self.names

    def target_name(self):
        return self.aim


@pytest.fixture(scope="module")
def split(spark):
    """A target that two features tell and one does not; a fifth of the rows validates."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 3))
    y = np.where(x[:, 0] > 0, 2.0, -2.0) * np.where(x[:, 1] > 0, 1.0, 0.3) + 0.1 * rng.normal(size=900)
    rows = [("A", DAY + dt.timedelta(days=i), *map(float, x[i]), float(y[i]), float(y[i] > 0), ("train", "train", "train", "val", "test")[i % 5]) for i in range(900)]
    return spark.createDataFrame(rows, "act_symbol string, date date, a double, b double, c double, y double, z double, part string").cache()


def test_trees_learn_and_stop(split):
    m = Given(split, ["a", "b", "c"], "y")
    fitted = m.train_model(split, rounds=60, step=0.2)
    got = m.predictions(fitted, split).toPandas()
    assert len(got) == 180 and np.sqrt(np.mean((got.pred - got.target) ** 2)) < 0.4 < got.target.std()
    assert fitted.getNumTrees < 60


@pytest.mark.parametrize("kind,target", [("regression", "y"), ("classification", "z")])
def test_tuner_is_seeded_and_returns_the_best(split, kind, target):
    m = Given(split, ["a", "b", "c"], target, kind)
    seen = []
    fitted, m._fitted = m._fitted, lambda x, parts, **p: (seen.append(p), fitted(x, parts, **p))[1]
    best = m.tune_params(split, trials=6, seed=3, budgets=(1, 4), keep=3)
    again = m.tune_params(split, trials=6, seed=3, budgets=(1, 4), keep=3)
    assert best == again and best["rounds"] == 4 and len(seen) == 2 * (6 + 2)
    assert {p["rounds"] for p in seen} == {1, 4} and all(2 <= p["depth"] <= 6 for p in seen)
    # The last budget's fits have no smaller error than the winner's.
    last = [p for p in seen[:8] if p["rounds"] == 4]
    x = m.matrix(split)
    losses = [m._loss(fitted(x, 1, **p), x) for p in last]
    assert best["loss"] == pytest.approx(min(losses), rel=1e-9)
    m._fitted = fitted
    assert m.tune_params(split, trials=0) == {}


def test_equal_draws_share_a_fit(split, monkeypatch):
    m = Given(split, ["a", "b", "c"], "y")
    fits, losses, asked = [], [], []

    class Learner:
        def __init__(self, **params):
            self.params = params

        def fit(self, rows):
            fits.append(self.params)
            return self

    monkeypatch.setattr(m, "_learner", Learner)
    monkeypatch.setattr(m, "_loss", lambda model, x: losses.append(1) or model.params["depth"] + model.params["step"] + 1 / model.params["rounds"])
    fitted = m._fitted
    monkeypatch.setattr(m, "_fitted", lambda x, parts, **p: asked.append(p) or fitted(x, parts, **p))
    best = m.tune_params(split, trials=50)
    assert len(asked) == 50 + 17 + 6 and len(fits) == len(losses) == len({tuple(p.items()) for p in fits}) < 30
    # The best third goes on, equal draws included.
    first, second = (sorted(p["depth"] + p["step"] for p in asked if p["rounds"] == r) for r in (2, 6))
    assert second == first[:17] and best == pytest.approx({"depth": 2, "step": first[0] - 2, "rounds": 18, "loss": first[0] + 1 / 18})


def test_error_of_a_regression_is_taken_without_ranks(split, monkeypatch):
    m = Given(split, ["a", "b", "c"], "y")
    x = m.matrix(split)
    model = m._fitted(x, 1, rounds=2)
    want = L.E.metrics(m._predicted(model, x, "val")).first()["rmse"]
    monkeypatch.setattr(L.E, "metrics", None)
    assert m._loss(model, x) == pytest.approx(want, rel=1e-12)
    assert m._loss(model, x.where("part = 'train'")) == float("inf")


def test_fits_at_once_are_those_one_by_one(split):
    rows = split.where("part = 'train'")
    one, many = (L.shadow_selection(rows, ["a", "b", "c"], "y", iterations=3, rounds=4) for _ in range(2))
    assert one == many == ["a", "b"]
    assert L.shadow_selection(rows, [], "y") == [] and L.shadow_selection(rows.limit(0), ["a"], "y") == []


def test_registered_settings_are_the_productions(monkeypatch, spark, sf):
    asked = {}
    monkeypatch.setattr(L, "shadow_selection", lambda df, features, target, iterations, rounds: asked.update(shadow=(iterations, rounds)) or features)
    evaluation.shadows(spark, sf)
    assert asked == {"shadow": (5, 100)} and evaluation.ROUNDS == 100 and evaluation.TRIALS == 50
