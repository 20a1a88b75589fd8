"""Models over a compiled panel: feature reduction, training, tuning and selection.

Correlations and trees run on Spark; only p x p matrices, p the number of features, are looked at on the driver.
"""

from __future__ import annotations

import itertools
import random
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepanel.functions import scans as S
from tidepanel.plans import boosting as B
from tidepanel.plans import evaluation as E
from tidepanel.plans.features import FeatureEngine, FeatureRequest
from tidepanel.sources import scratch


def co_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """``(i, j, n, mx, my, x, y, xx, yy, xy)`` of all pairs i <= j of features, over the rows where both are there.

    ``mx`` and ``my`` are means, the others sums of values less them.  Rows are read once: each task adds up products of
    its batches' matrices, less the first value that it meets, with nulls as 0 and their masks, and sends p (p + 1) / 2
    rows, which are brought to the common means.  So the plan has the same size for any number of features.
    """
    p = len(features)
    known = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    x = df.select(F.array(*[known(F.col(f"`{c}`")) for c in features]).alias("v"))
    i, j = np.triu_indices(p)

    def added(batches):
        total, first = np.zeros((6, p, p)), np.full(p, np.nan)
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            there = ~np.isnan(v)
            for k in np.flatnonzero(np.isnan(first) & there.any(axis=0)):
                first[k] = v[there[:, k].argmax(), k]
            v, m = np.where(there, v - first, 0.0), there.astype(float)
            total += np.stack((m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v))
        n, sx, sy, xx, yy, xy = (t[i, j] for t in total)
        held = n > 0
        n, sx, sy, xx, yy, xy, a, b = (t[held] for t in (n, sx, sy, xx, yy, xy, i, j))
        out = (n, first[a] + sx / n, first[b] + sy / n, xx - sx * sx / n, yy - sy * sy / n, xy - sx * sy / n)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.array(t) for t in out]], names=["i", "j", "n", "mx", "my", "xx", "yy", "xy"])

    parts = x.mapInArrow(added, "i long, j long, n double, mx double, my double, xx double, yy double, xy double")
    pair, n = W.partitionBy("i", "j"), F.col("n")
    parts = parts.withColumns({f"_{c}": F.sum(n * F.col(c)).over(pair) / F.sum(n).over(pair) for c in ("mx", "my")})
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    sums = {"x": n * dx, "y": n * dy, "xx": F.col("xx") + n * dx * dx, "yy": F.col("yy") + n * dy * dy, "xy": F.col("xy") + n * dx * dy}
    return parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.first("_mx").alias("mx"), F.first("_my").alias("my"), *[F.sum(e).alias(c) for c, e in sums.items()])


def correlations(df: DataFrame, features: list[str]) -> np.ndarray:
    """Absolute Pearson correlations over the rows where both are there; 0 where one is constant, NaN counts as null."""
    return _correlated(co_moments(df, features).collect() if len(features) > 1 else [], len(features))


def _correlated(moments: list, p: int) -> np.ndarray:
    out = np.eye(p)
    for r in moments:
        if r.i == r.j or r.n <= 1:
            continue
        x, y, c = r.xx - r.x * r.x / r.n, r.yy - r.y * r.y / r.n, r.xy - r.x * r.y / r.n
        # What rounding leaves of a constant is no variance.
        if x > 1e-13 * r.xx and y > 1e-13 * r.yy:
            out[r.i, r.j] = out[r.j, r.i] = abs(c) / (x * y) ** 0.5
    return out


def kuhn_johnson(df: DataFrame, features: list[str], threshold: float = 0.75) -> list[str]:
    """The features left when of each pair too alike the one closer to the rest goes (of equals the second)."""
    c = correlations(df, features)
    left = list(range(len(features)))
    while len(left) > 1:
        m = c[np.ix_(left, left)].copy()
        np.fill_diagonal(m, -1.0)
        i, j = np.unravel_index(int(m.argmax()), m.shape)
        if m[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        others = [k for k in range(len(left)) if k not in (i, j)]
        a, b = (m[i, others].mean(), m[j, others].mean()) if others else (0.0, 0.0)
        left.pop(i if a > b else j)
    return [features[k] for k in left]


def complete_linkage(distance: np.ndarray, cut: float) -> list[list[int]]:
    """Clusters whose members are all within ``cut`` of each other, by merging the closest."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        far, a, b = min((max(distance[i, j] for i in x for j in y), p, q) for (p, x), (q, y) in itertools.combinations(enumerate(groups), 2))
        if far > cut:
            break
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


def block_pca(df: DataFrame, features: list[str], threshold: float = 0.75, max_pcs: int = 1) -> tuple[DataFrame, list[str]]:
    """Alike features as their first principal components; a component's largest loading (of equals the first) is positive.

    Rows are written once and read twice: for the pairs' moments, of which components follow, and for the result.
    """
    df = scratch.written(df, "pca")
    p = len(features)
    moments = co_moments(df, features).collect()
    m, s, products = np.zeros(p), np.zeros(p), np.zeros((p, p))
    for r in moments:
        if r.i == r.j:
            m[r.i], s[r.i] = r.mx, (max(0.0, r.xx - r.x * r.x / r.n) / (r.n - 1)) ** 0.5 if r.n > 1 else 0.0
    s += 1e-8
    for r in moments:
        # About each feature's own mean, a missing value counts as that mean.
        products[r.i, r.j] = products[r.j, r.i] = (r.xy + r.n * (r.mx - m[r.i]) * (r.my - m[r.j])) / (s[r.i] * s[r.j])
    names = []
    for group in complete_linkage(1 - _correlated(moments, p), 1 - threshold):
        if len(group) == 1:
            names.append(features[group[0]])
            continue
        z = [F.coalesce((F.col(f"`{features[k]}`") - float(m[k])) / float(s[k]), F.lit(0.0)) for k in group]
        loads = np.linalg.eigh(products[np.ix_(group, group)])[1][:, ::-1]
        whole = "_".join(features[k] for k in group)
        whole = whole if len(whole) <= 100 else whole[:90] + "_TRUNC"
        for i in range(min(max_pcs, len(group))):
            sign = 1.0 if loads[np.abs(loads[:, i]).round(6).argmax(), i] >= 0 else -1.0
            names.append(f"F_PCA_PC{i + 1}_{whole}")
            df = df.withColumn(names[-1], sum(x * float(w * sign) for x, w in zip(z, loads[:, i], strict=True)))
    return df, names


#: Rows of a partition that trees are grown on: a tree takes a job a level, so few rows are not dealt to many tasks.
TREE_ROWS = 20_000
#: Rows in which a shadow's values are permuted among each other.
CYCLE = 1000


def shadowed(df: DataFrame, features: list[str], seeds: list[int], parts: int | None = None) -> DataFrame:
    """Add ``SHADOW_{i}_{feature}`` for each seed: a feature's values permuted over the rows, each shadow by itself.

    Rows are dealt at random into groups of about ``CYCLE``; in each the values of a shadow are put in the order of a hash
    of its own.  So all shadows of all seeds take one shuffle, into ``parts`` partitions where they are given; each value is
    used once, and no task orders all rows.
    """
    group = _group(df.count(), seeds).alias("_g")
    row = F.struct("act_symbol", "date", *[F.col(f"`{c}`") for c in df.columns if c not in ("act_symbol", "date")])
    dealt = df.withColumn("_g", group)
    g = (dealt.repartition(parts, "_g") if parts else dealt).groupBy("_g").agg(F.sort_array(F.collect_list(row)).alias("row"))

    def permuted(i: int, k: int, c: str):
        keyed = F.transform("row", lambda r: F.struct(F.xxhash64(r["act_symbol"], r["date"], F.lit(i), F.lit(k)).alias("h"), r[c].alias("v")))
        return F.transform(F.array_sort(keyed), lambda x: x["v"]).alias(f"SHADOW_{i}_{c}")

    lists = g.select("row", *[permuted(seed, k, c) for seed in seeds for k, c in enumerate(features)])
    return lists.select(F.inline(F.arrays_zip(*lists.columns))).select("row.*", *lists.columns[1:])


def _group(rows: int, seeds: list[int]):
    return F.pmod(F.xxhash64("act_symbol", "date", F.lit(seeds[0])), F.lit(max(1, rows // CYCLE)))


def shadow_blocks(df: DataFrame, features: list[str], label: str, seeds: list[int], cuts: list[list[float]], rows: int, parts: int):
    """Bins and labels of ``rows`` rows, as :func:`boosting.packed`, with the shadows of :func:`shadowed`.

    Rows are dealt and sorted with the features alone; the shadows are bins put in order afterwards, so no value of a shadow is moved.
    """
    dealt = df.withColumns({"_group": _group(rows, seeds), "_hash": F.xxhash64("act_symbol", "date")})
    dealt = dealt.repartition(parts, "_group").sortWithinPartitions("_group", "act_symbol", "date")
    return B.packed(dealt, features, label, cuts, seeds)


#: Rounds of the tuner's budgets, and one in how many trials goes on to the next.
BUDGETS, KEEP = (2, 6, 18), 3


def concurrently(spark, tasks: list, at_once: int = 8) -> list:
    """The results of functions that run Spark jobs, so many at once, from threads that share the session's properties."""
    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(max(1, min(at_once, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]


class Once:
    """What threads ask for by a key: the first makes it, the others wait for it."""

    def __init__(self):
        self.lock, self.made = Lock(), {}

    def __call__(self, key, make):
        with self.lock:
            first = key not in self.made
            held = self.made.setdefault(key, Future())
        if first:
            try:
                held.set_result(make())
            except BaseException as e:
                held.set_exception(e)
        return held.result()


def _assembled(df: DataFrame, features: list[str], target: str):
    from pyspark.ml.feature import VectorAssembler

    clean = df.na.drop(subset=[*features, target])
    return VectorAssembler(inputCols=features, outputCol="features").transform(clean).withColumn("label", F.col(f"`{target}`").cast("double"))


def shadow_selection(df: DataFrame, features: list[str], target: str, iterations: int = 5, depth: int = 4, rounds: int = 100, target_type: str = "regression") -> list[str]:
    """The features that beat every shadow's importance in all iterations, on the training part.

    ``df`` is a split panel, of which the rows with ``part`` train count; without that column all rows do.  Rows without
    one of the features or the target are left out.  The iterations' trees are grown together over one binned table; a
    shadow has its feature's values and so its cuts.
    """
    if not features:
        return []
    if target_type not in ("regression", "classification"):
        raise ValueError(f"unknown target type: {target_type}")
    spark = df.sparkSession
    S.checkpoints(spark)
    rows = df.where("part = 'train'") if "part" in df.columns else df
    seeds = [42 + i for i in range(iterations)]
    names = {c: f"f{k}" for k, c in enumerate(features)}
    aim = F.col(f"`{target}`").cast("double")
    aim = aim if target_type == "regression" else F.when(aim > 0, 1.0).otherwise(-1.0)
    plain = rows.na.drop(subset=[*features, target]).select("act_symbol", "date", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()], aim.alias("label")).cache()
    count = plain.count()
    if not count:
        plain.unpersist()
        return []
    p = len(features)
    cuts = B.cuts_of(plain, list(names.values()))
    parts = B.partitions(count, TREE_ROWS, spark.sparkContext.defaultParallelism)
    blocks = shadow_blocks(plain, list(names.values()), "label", seeds, cuts, count, parts)
    sets = [[*range(p), *range(p * (i + 1), p * (i + 2))] for i in range(iterations)]
    gone: set[str] = set()
    for gain in B.gains(blocks, sets, p * (1 + iterations), depth, rounds, 0.05, target_type == "classification"):
        best = gain[p:].max()
        gone |= {f for f, g in zip(features, gain[:p], strict=True) if g <= best}
    plain.unpersist()
    return [f for f in features if f not in gone]


class Model:
    """Features and a target over universe data, trained and judged by date."""

    def __init__(self, data: DataFrame, market: DataFrame | None = None):
        self.data, self.market = data, market
        self.features: list[FeatureRequest] = []
        self.target: FeatureRequest | None = None
        self.target_type = "regression"
        #: While trials are tuned, the fits that they share.
        self._once: Once | None = None

    def add_target(self, target: FeatureRequest, target_type: str = "regression") -> None:
        if target_type not in ("regression", "classification"):
            raise ValueError(f"unknown target type: {target_type}")
        self.target, self.target_type = target, target_type

    def add_features(self, features: list[FeatureRequest]) -> None:
        self.features += features

    def generate_targets_and_features(self) -> DataFrame:
        out = FeatureEngine([*self.features, self.target]).compute(self.data, self.market)
        return out.na.drop(subset=[*self.feature_names(), self.target_name()])

    def feature_names(self) -> list[str]:
        return [c for r in self.features for c in r.columns()]

    def target_name(self) -> str:
        return self.target.columns()[0]

    def split_data(self, cutoffs=(0.7, 0.85, 1.0)) -> DataFrame:
        """The complete rows by part.  They are written once: the split, the fits and the predictions read them."""
        return E.split_dates(scratch.written(self.generate_targets_and_features(), "split"), cutoffs).where("part is not null")

    def _learner(self, depth: int = 4, rounds: int = 20, step: float = 0.1):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.regression import GBTRegressor

        kind = GBTRegressor if self.target_type == "regression" else GBTClassifier
        return kind(maxDepth=depth, maxIter=rounds, stepSize=step, seed=0, validationIndicatorCol="is_val")

    def matrix(self, split: DataFrame) -> DataFrame:
        """``(act_symbol, date, part, is_val, features, label)``, the complete rows as trees are grown on them."""
        rows = split.withColumn("is_val", F.col("part") == "val")
        out = _assembled(rows, self.feature_names(), self.target_name())
        return out.select("act_symbol", "date", "part", "is_val", "features", "label")

    def _fitted(self, matrix: DataFrame, parts: int, **params):
        fit = lambda: self._learner(**params).fit(matrix.where("part in ('train', 'val')").coalesce(parts))
        return self._once((id(matrix), parts, *sorted(params.items())), fit) if self._once else fit()

    def train_model(self, split: DataFrame, save_name: str | None = None, **params):
        """Boosted trees that stop when the validation part no longer gains."""
        m = self.matrix(split).cache()
        model = self._fitted(m, max(1, -(-m.count() // TREE_ROWS)), **params)
        m.unpersist()
        if save_name:
            model.write().overwrite().save(save_name)
        return model

    def predictions(self, model, split: DataFrame, part: str = "test") -> DataFrame:
        return self._predicted(model, self.matrix(split), part)

    def _predicted(self, model, matrix: DataFrame, part: str) -> DataFrame:
        out = model.transform(matrix.where(F.col("part") == part))
        return out.select("act_symbol", "date", F.col("prediction").alias("pred"), F.col("label").alias("target"))

    def _loss(self, model, matrix: DataFrame) -> float:
        got = self._predicted(model, matrix, "val")
        if self.target_type == "regression":
            # The error alone takes one pass; the ranks of all metrics would order the predictions of each trial.
            loss = got.agg(F.sqrt(F.avg((F.col("pred") - F.col("target")) * (F.col("pred") - F.col("target"))))).first()[0]
        else:
            loss = 1 - (E.metrics(got).first()["roc_auc"] or 0.0)
        return float("inf") if loss is None else loss

    def tune_params(self, split: DataFrame, trials: int = 50, seed: int = 0, budgets: tuple[int, ...] = BUDGETS, keep: int = KEEP, at_once: int = 8) -> dict:
        """The best of seeded random trials by the validation part's error, by successive halving.

        All trials are fitted with the first budget of rounds; one in ``keep`` goes on to the next budget, and the best of
        the last one wins, with its rounds.  Trials of a budget run ``at_once`` over one cached matrix, equal draws as one fit.  A draw depends on
        the seed alone and equal errors fall to the earlier draw, so reruns choose the same.
        """
        draw = random.Random(seed)
        alive = [{"depth": draw.randint(2, 6), "step": draw.choice([0.03, 0.05, 0.1, 0.2])} for _ in range(trials)]
        m = self.matrix(split).cache()
        parts = max(1, -(-m.count() // TREE_ROWS))
        best: dict = {}
        once = self._once = Once()

        def judged(p: dict, rounds: int) -> float:
            model = self._fitted(m, parts, rounds=rounds, **p)
            return once(("loss", id(model)), lambda: self._loss(model, m))

        for rounds in budgets:
            # A fit depends on its parameters alone, so equal draws share one; they ask last, as they only wait.
            drawn = [(p["depth"], p["step"]) for p in alive]
            asked = sorted(range(len(alive)), key=lambda i: drawn.index(drawn[i]) < i)
            got = concurrently(split.sparkSession, [lambda i=i, r=rounds: judged(alive[i], r) for i in asked], at_once)
            losses = [loss for _, loss in sorted(zip(asked, got, strict=True))]
            order = sorted(range(len(alive)), key=lambda i: (losses[i], i))
            best = alive[order[0]] | {"rounds": rounds, "loss": losses[order[0]]} if order else {}
            alive = [alive[i] for i in order[: max(1, -(-len(alive) // keep))]]
        self._once = None
        m.unpersist()
        return best
