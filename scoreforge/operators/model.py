"""Model operators (M1-M12) on Spark ML's gradient-boosted trees.

Splits and folds come from the md5 hash of a key (stable under
repartitioning and reproducible in SQL).  Training is ``GBTRegressor``; with a
validation set it goes in growing rounds until a number of trees brought nothing, and the
model keeps the trees up to the best one.
"""

from __future__ import annotations

import itertools
import json
import random
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import storage_memory, work_path, written
from . import treeshap
from .ensemble import Ensemble, dense, partnered, permutation_errors, predictions

# fixed values: default boosted-tree settings (reference parameter names in comments)
DEFAULT_PARAMS = {
    "maxIter": 500,        # iterations
    "stepSize": 0.1,       # learning_rate
    "maxDepth": 6,         # depth
    "maxBins": 254,        # border_count
    "subsamplingRate": 1.0,
    "seed": 42,            # random_seed
}
EARLY_STOPPING_ROUNDS = 50
#: Rows that a task of a fit may hold before there are more tasks than cores.
FIT_ROWS = 1_000_000
#: Bytes that a fit keeps of a row, beside four for each feature's bin.
FIT_ROW_BYTES = 120
# fixed values: search space of the three parameters that Spark's trees share
SEARCH_SPACE = {
    "maxDepth": [4, 5, 6, 7, 8],
    "stepSize": [0.01, 0.05, 0.1, 0.15, 0.2],
    "maxIter": [500, 750, 1000, 1250, 1500],
}


# ---------------------------------------------------------------------- M1
def hash_split(df: DataFrame, key: str, test_pct: int = 20, val_pct: int = 0, out: str = "split") -> DataFrame:
    """M1: 'train' / 'validation' / 'test' by ``hash_mod(key, 100)``:
    [0, 100-test-val) train, then validation, then test."""
    h = X.hash_mod(key, 100)
    train_end = 100 - test_pct - val_pct
    return df.withColumn(out, F.when(h < train_end, "train").when(h < train_end + val_pct, "validation")
                         .otherwise("test"))


def hash_folds(df: DataFrame, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    return df.withColumn(out, X.hash_mod(key, k).cast("int"))


# ---------------------------------------------------------------------- M2
@dataclass
class FittedModel:
    model: GBTRegressionModel
    params: dict
    best_iteration: int | None = None
    history: list = field(default_factory=list)      # (iteration, train_rmse, validation_rmse)
    elapsed_s: float = 0.0
    feature_names: list = field(default_factory=list)
    meta: dict = field(default_factory=dict)
    ensemble: Ensemble | None = None                 # flat arrays of the trees, made when first needed

    def predict(self, df: DataFrame, features: str = "features", out: str = "prediction",
                clip: bool = True) -> DataFrame:
        """M3: predict every row; clamp to [0, 1]."""
        pred = self.model.setFeaturesCol(features).setPredictionCol("__raw").transform(df)
        val = X.clip(F.col("__raw"), 0.0, 1.0) if clip else F.col("__raw")
        return pred.withColumn(out, val).drop("__raw")


def _gbt(params: dict, features: str, label: str) -> GBTRegressor:
    p = {**DEFAULT_PARAMS, **params}
    return GBTRegressor(featuresCol=features, labelCol=label, lossType="squared", **p)


def in_few_tasks(train: DataFrame, n: int | None = None) -> DataFrame:
    """The rows (``n`` of them, counted if not given) in no more partitions than cores, or than ``FIT_ROWS`` rows each need.

    Every task hands on the statistics of all bins, features and nodes at every level of every tree, however few rows it
    holds: with a task per file split what a fit shuffles grows with the input, with a task per core it does not.  For
    tables as they are read: the partitions of a plan with a shuffle are known only once that has run."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    if train.rdd.getNumPartitions() <= cores:
        return train
    return train.coalesce(max(cores, -(-(train.count() if n is None else n) // FIT_ROWS)))


def _assembled(trees: list, weights: list[float], n_features: int, uid: str) -> GBTRegressionModel:
    """An ensemble model of fitted trees (Java objects) and their weights."""
    sc = SparkSession.getActiveSession().sparkContext
    ml = sc._jvm.org.apache.spark.ml.regression
    own, size = sc._gateway.new_array(ml.DecisionTreeRegressionModel, len(trees)), sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        own[i], size[i] = tree, weight
    return GBTRegressionModel(ml.GBTRegressionModel(uid, own, size, n_features))


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The ensemble of a model's first ``n`` trees: boosting never changes a tree once it is added."""
    if n >= model.getNumTrees:
        return model
    java = model._java_obj
    return _assembled([java.trees()[i] for i in range(n)], [java.treeWeights()[i] for i in range(n)],
                      model.numFeatures, java.uid())


def gbt_fit(train: DataFrame, features: str = "features", label: str = "label", params: dict | None = None,
            validation: DataFrame | None = None, early_stopping_rounds: int | None = EARLY_STOPPING_ROUNDS,
            feature_names: Sequence[str] = ()) -> FittedModel:
    """M2: fit once.  With a validation set, keep the trees up to the best iteration (patience
    ``early_stopping_rounds``).

    Training then goes in rounds of twice as many trees, from four times the patience on, and ends with the first one in
    which the patience ran out: far fewer trees than ``maxIter`` when it comes early.  A longer round grows the
    same first trees again, so the result is that of one fit of ``maxIter`` trees."""
    params = {**DEFAULT_PARAMS, **(params or {})}
    t0 = time.time()
    if validation is None:
        model = _gbt(params, features, label).fit(train)
        return FittedModel(model, params, None, [], time.time() - t0, list(feature_names))
    most = params["maxIter"]
    grown = most if early_stopping_rounds is None else min(most, max(20, 4 * early_stopping_rounds))
    while True:
        model = _gbt({**params, "maxIter": grown}, features, label).fit(train)
        held_out = model.evaluateEachIteration(validation, "squared")
        best, stopped = stopping_point(held_out, early_stopping_rounds)
        if stopped or grown >= most:
            break
        grown = min(most, 2 * grown)
    own = model.evaluateEachIteration(train, "squared")
    history = [(i, float(np.sqrt(a)), float(np.sqrt(b))) for i, (a, b) in enumerate(zip(own, held_out))]
    return FittedModel(first_trees(model, best + 1), params, best, history, time.time() - t0, list(feature_names))


def stopping_point(errors: Sequence[float], patience: int | None) -> tuple[int, bool]:
    """Place of the least error before ``patience`` trees went by without a lesser one, and whether they did."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif patience is not None and i - best >= patience:
            return best, True
    return best, False


# ---------------------------------------------------------------------- A5 helper
def rmse(df: DataFrame, y: str, p: str) -> float:
    return float(df.agg(F.sqrt(F.avg((F.col(p) - F.col(y)) ** 2))).first()[0])


# ---------------------------------------------------------------------- M4
def prefix_errors(fm: FittedModel, df: DataFrame, features: str, label: str, prefixes: Sequence[int]) -> list[dict]:
    """Held-out errors of the model's first n trees for every n of ``prefixes``, from one pass.

    A batch is walked tree by tree; running sums over the trees give each prefix's score.  A
    task hands on a handful of sums per prefix."""
    from pyspark.ml.functions import vector_to_array
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ensemble_of(fm, spark))
    at = [min(n, len(shared.value.trees)) for n in prefixes]

    def run(batches):
        sums = np.zeros((len(at), 5))
        for batch in batches:
            x, y = dense(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
            score, done = np.zeros(len(y)), 0
            for place, n in sorted(enumerate(at), key=lambda e: e[1]):
                for t in range(done, n):
                    score += shared.value.trees[t].walk(x)
                done = n
                off = score - y
                sums[place] += (len(y), off @ off, np.abs(off).sum(), y.sum(), y @ y)
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(at)), pa.int32()), "n": sums[:, 0].astype(np.int64),
                                          "sse": sums[:, 1], "sae": sums[:, 2], "sy": sums[:, 3], "syy": sums[:, 4]})

    rows = df.where(F.col(label).isNotNull()).select(vector_to_array(F.col(features)).alias("x"),
                                                     F.col(label).cast("double").alias("y"))
    parts = rows.mapInArrow(run, "place int, n long, sse double, sae double, sy double, syy double")
    found = {r["place"]: r for r in parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sae", "sy", "syy")])
             .collect()}
    out = []
    for place, n in enumerate(prefixes):
        r = found[place] if place in found else None
        rows_n = r["n"] if r else 0
        spread = r["syy"] - r["sy"] ** 2 / rows_n if rows_n else 0.0
        out.append({"trees": n, "n": rows_n, "rmse": (r["sse"] / rows_n) ** 0.5 if rows_n else float("nan"),
                    "mae": r["sae"] / rows_n if rows_n else float("nan"),
                    "r2": 1 - r["sse"] / spread if spread > 0 else float("nan")})
    return out


def _in_threads(fn, items: list, parallelism: int) -> list:
    """``fn`` of each item from ``parallelism`` driver threads (each fit is a distributed job of its own)."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(fn, items))


@dataclass
class Folds:
    """Rows with their fold; of a table with a folder per fold also the rows of each one, and the number of features."""

    data: DataFrame
    sizes: dict[int, int] | None = None
    width: int = 0

    def held_out(self, f: int) -> DataFrame:
        return self.data.where(F.col("fold") == f)

    def train(self, f: int) -> DataFrame:
        """All folds but ``f``.  Folders are read each by itself: a read takes at least a split per core, so that a task's
        cached rows stay few however small their files are."""
        if self.sizes is None:
            return in_few_tasks(self.data.where(F.col("fold") != f))
        others = [g for g in sorted(self.sizes) if g != f]
        rows = reduce(DataFrame.union, map(self.held_out, others)) if others else self.data.where("false")
        return in_few_tasks(rows, sum(self.sizes[g] for g in others))

    def at_once(self, parallelism: int) -> int:
        """How many fits may run together: a fit caches its rows (a binned one, its label and errors), and what does not
        fit into the executors' memory goes to their disks and is read again for every tree."""
        if self.sizes is None:
            return parallelism
        rows = sum(self.sizes.values()) - min(self.sizes.values(), default=0)
        fit = rows * (FIT_ROW_BYTES + 4 * self.width)
        return max(1, min(parallelism, storage_memory(self.data.sparkSession) // max(fit, 1)))


def written_folds(df: DataFrame, key: str, features: str, label: str, k: int) -> Folds:
    """The rows of k hash folds, hashed and assembled once: a fit and its scores read their rows four times, and each
    time would do so again.  Reading some folds opens only their files.  Rows without a key are in no fold."""
    folded = hash_folds(df, key, k).where(F.col("fold").isNotNull()).select(features, label, "fold")
    data = written(folded, "folds", parted_by="fold")
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    one = data.where(F.col(features).isNotNull()).select(features).first()
    return Folds(data, sizes, one[0].size if one else 0)


def cross_validate(df: DataFrame, key: str, features: str, label: str, params: dict | None = None,
                   k: int = 5, parallelism: int = 4, write_folds: bool = False) -> DataFrame:
    """M4: k hash folds; per fold fit on the others, score the fold; rows
    (fold, rmse, mae, r2) - mean and std are a one-line aggregate on top.
    Folds are fitted concurrently (as ``CrossValidator(parallelism=...)`` does).  ``write_folds``: see ``tune``."""
    folds = written_folds(df, key, features, label, k) if write_folds else Folds(hash_folds(df, key, k))

    def one(f: int):
        fm = gbt_fit(folds.train(f), features, label, params)
        m = prefix_errors(fm, folds.held_out(f), features, label, [fm.model.getNumTrees])[0]
        return (f, m["rmse"], m["mae"], m["r2"])

    return df.sparkSession.createDataFrame(_in_threads(one, list(range(k)), folds.at_once(parallelism)),
                                           "fold int, rmse double, mae double, r2 double")


def cv_summary(cv: DataFrame) -> DataFrame:
    return cv.agg(F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"),
                  F.avg("r2").alias("mean_r2"))


# ---------------------------------------------------------------------- M5
def param_grid(space: dict, n_draws: int | None = None, seed: int = 42) -> list[dict]:
    """Full grid, or ``n_draws`` distinct draws of it (seeded)."""
    keys = list(space)
    grid = [dict(zip(keys, combo)) for combo in itertools.product(*[space[k] for k in keys])]
    if n_draws is None or n_draws >= len(grid):
        return grid
    return random.Random(seed).sample(grid, n_draws)


@dataclass
class Search:
    """What a search found: (candidate, params, neg_mse) and (candidate, fold, rmse, mae, r2) tables."""

    results: DataFrame
    folds: DataFrame
    best_params: dict
    n_fits: int                                    # per fold
    model: FittedModel | None = None


def tune(df: DataFrame, key: str, features: str, label: str, space: dict, n_draws: int | None = None,
         k: int = 5, base: dict | None = None, seed: int = 42, parallelism: int = 4, refit: bool = True,
         write_folds: bool = False) -> Search:
    """M5: score every candidate by k-fold mean squared error (neg-MSE ordering, ties to the first), then
    refit the winner on all rows.

    Candidates that differ only in ``maxIter`` are nested: boosting never changes a tree, so the shorter
    ones are the first trees of the longest.  Each such family is fitted once per fold and scored at all its lengths in
    one pass over the fold.

    ``write_folds`` is for rows that are computed, not read: they are written once, by fold, and large fits run one after
    the other.  A prepared table is better read as it is than copied."""
    candidates = [{**(base or {}), **c} for c in param_grid(space, n_draws, seed)]
    families: dict[str, list[int]] = {}
    for i, c in enumerate(candidates):
        families.setdefault(json.dumps({n: v for n, v in c.items() if n != "maxIter"}, sort_keys=True), []).append(i)
    folds = written_folds(df, key, features, label, k) if write_folds else Folds(hash_folds(df, key, k))

    def one(job):
        members, f = job
        lengths = [candidates[i].get("maxIter", DEFAULT_PARAMS["maxIter"]) for i in members]
        longest = {**candidates[members[0]], "maxIter": max(lengths)}
        fm = gbt_fit(folds.train(f), features, label, longest)
        scores = prefix_errors(fm, folds.held_out(f), features, label, lengths)
        return [(i, f, m["rmse"], m["mae"], m["r2"]) for i, m in zip(members, scores)]

    jobs = [(members, f) for members in families.values() for f in range(k)]
    rows = sorted(r for found in _in_threads(one, jobs, folds.at_once(parallelism)) for r in found)
    mse = [float(np.mean([r[2] ** 2 for r in rows if r[0] == i])) for i in range(len(candidates))]
    best = min(range(len(candidates)), key=lambda i: (mse[i], i))
    spark = df.sparkSession
    results = spark.createDataFrame(
        [(i, json.dumps({n: c[n] for n in space}, sort_keys=True), -mse[i], i == best) for i, c in enumerate(candidates)],
        "candidate int, params string, neg_mse double, is_best boolean")
    folds = spark.createDataFrame(rows, "candidate int, fold int, rmse double, mae double, r2 double")
    model = gbt_fit(in_few_tasks(df), features, label, candidates[best]) if refit else None
    return Search(results, folds, candidates[best], len(families), model)


# ---------------------------------------------------------------------- M6
def feature_importance(fm: FittedModel, spark: SparkSession, names: Sequence[str] | None = None,
                       importance_type: str = "gain", data: DataFrame | None = None, key: str | None = None,
                       label: str | None = None, features: str = "features") -> DataFrame:
    """M6: importance per named feature.  ``gain``: Spark's split-gain
    importance.  ``permutation``: increase of RMSE on ``data`` when one
    feature's column is permuted (the loss-change importance)."""
    names = list(names or fm.feature_names)
    n_model = fm.model.numFeatures
    if len(names) != n_model:
        names = [f"feature_{i}" for i in range(n_model)]
    if importance_type == "gain":
        imp = fm.model.featureImportances.toArray()
        return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")
    if importance_type != "permutation":
        raise ValueError(f"unknown importance type {importance_type!r}")
    if data is None or key is None or label is None:
        raise ValueError("permutation importance needs data, key and label")
    return permutation_importance(fm, data, key, label, names, features)


def permutation_importance(fm: FittedModel, data: DataFrame, key: str, label: str, names: Sequence[str],
                           features: str = "features", seed: int = 42, buckets: int | None = None) -> DataFrame:
    """RMSE increase per permuted feature, from one scoring of each row.

    Rows with a label are dealt once by the hash of their key; a row's partner is the next one in that order.  A
    batch is scored tree by tree; permuting a feature walks again only the trees that split on it, for the rows
    whose value changes.  No row is copied per feature, a feature no tree splits on has importance 0
    exactly, and a task hands on one number per feature."""
    spark = data.sparkSession
    model = ensemble_of(fm, spark)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    err = permutation_errors(model, partnered(data, key, label, features, seed, buckets), len(names))
    rows = {r["feature"]: (r["sse"], r["n"]) for r in err.collect()}          # one row per feature
    sse, n = rows.get(-1, (0.0, 0))
    base = (sse / n) ** 0.5 if n else 0.0
    gain = [((rows[i][0] / n) ** 0.5 - base if n and i in rows else 0.0) for i in range(len(names))]
    return spark.createDataFrame(list(zip(names, gain)), "feature string, importance double")


def ensemble_of(fm: FittedModel, spark: SparkSession) -> Ensemble:
    """The fitted trees as flat arrays, by way of a saved copy in the work folder (made once per model)."""
    if fm.ensemble is None:
        path = work_path(spark, "models", "ensemble")
        fm.model.write().save(f"{path}/model")
        fm.ensemble = Ensemble(*node_table(spark, path))
    return fm.ensemble


# ---------------------------------------------------------------------- M7/M8
def save_model(fm: FittedModel, spark: SparkSession, path: str, extra: dict | None = None) -> None:
    """M7: the model plus one metadata document (params, features, history,
    best iteration, versions)."""
    import pyspark
    fm.model.write().overwrite().save(f"{path}/model")
    meta = {"model_type": "GBTRegressionModel", "params": fm.params, "best_iteration": fm.best_iteration,
            "history": fm.history, "elapsed_s": fm.elapsed_s, "feature_names": fm.feature_names,
            "n_features": fm.model.numFeatures, "n_trees": fm.model.getNumTrees, "versions": {"pyspark": pyspark.__version__},
            **fm.meta, **(extra or {})}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def model_info(spark: SparkSession, path: str, n_names: int = 20) -> DataFrame:
    """One row of what the saved bundle says of itself: type, version, features, settings and history."""
    text = spark.read.text(f"{path}/meta").first()[0]
    meta = json.loads(text)
    names = meta["feature_names"]
    return spark.createDataFrame(
        [(meta["model_type"], meta.get("model_version"), meta["n_features"], ",".join(names[:n_names]),
          json.dumps(meta["params"], sort_keys=True), meta["best_iteration"], len(meta["history"]), True)],
        "model_type string, model_version string, n_features int, first_features string, params string, "
        "best_iteration int, n_history int, is_fitted boolean")


def load_model(spark: SparkSession, path: str) -> FittedModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    model = GBTRegressionModel.load(f"{path}/model")
    known = {"params", "best_iteration", "history", "elapsed_s", "feature_names"}
    return FittedModel(model, meta["params"], meta["best_iteration"], meta["history"], meta["elapsed_s"],
                       meta["feature_names"], {k: v for k, v in meta.items() if k not in known})


def reload_check(before: DataFrame, after: DataFrame, key: str, pred: str = "prediction",
                 tol: float = 1e-6) -> DataFrame:
    """M8: max absolute prediction difference over all rows, joined by key."""
    j = before.select(key, F.col(pred).alias("a")).join(after.select(key, F.col(pred).alias("b")), key, "full")
    return j.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"),
                 F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_unmatched")) \
        .withColumn("ok", (F.col("max_abs_diff") <= F.lit(tol)) & (F.col("n_unmatched") == 0))


# ---------------------------------------------------------------------- E1
def node_table(spark: SparkSession, path: str) -> tuple[dict[int, dict[int, treeshap.Node]], list[float]]:
    """Nodes of a saved ensemble (bounded by trees x 2^depth) and tree weights."""
    data = spark.read.parquet(f"{path}/model/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold").collect()
    trees: dict[int, dict[int, treeshap.Node]] = {}
    for r in data:
        thr = r["leftCategoriesOrThreshold"]
        trees.setdefault(r["treeID"], {})[r["id"]] = treeshap.Node(
            r["id"], r["prediction"], float(r["rawCount"]), r["leftChild"], r["rightChild"], r["featureIndex"],
            float(thr[0]) if thr else float("nan"))
    weights = [float(w) for w in GBTRegressionModel.load(f"{path}/model").treeWeights]
    return trees, weights


def tree_contributions(df: DataFrame, spark: SparkSession, model_path: str, names: Sequence[str], key: str,
                       features: str = "features") -> DataFrame:
    """Per-row contributions as ``contrib`` array<struct<feature, value,
    shap>> plus ``expected_value`` and the raw ensemble ``prediction``.
    The node table (bounded by trees x 2^depth) is broadcast; each task makes
    its paths once and scores Arrow batches with numpy."""
    from .serving import contribution_column
    trees, weights = node_table(spark, model_path)
    base = sum(treeshap.leaf_paths(own, min(own), weights[tid])[1] for tid, own in sorted(trees.items()))
    x = F.col(features)
    return df.select(key, contribution_column(spark, trees, weights, names, x).alias("contrib"),
                     F.lit(float(base)).alias("expected_value"),
                     predictions(Ensemble(trees, weights), spark, x, None, None).alias("prediction"))


# ---------------------------------------------------------------------- M9
def bundle_check(meta_features: DataFrame, state_features: DataFrame, name: str = "name",
                 meta_versions: dict | None = None, state_versions: dict | None = None) -> DataFrame:
    """M9: (severity, kind, item) rows: feature-count mismatch and names
    missing on either side are errors (anti-joins both ways), differing
    library versions are warnings.  No rows means the bundle is consistent."""
    spark = meta_features.sparkSession
    a = meta_features.select(F.col(name).alias("item")).distinct()
    b = state_features.select(F.col(name).alias("item")).distinct()
    sides = a.select(F.lit(1).alias("s")).unionByName(b.select(F.lit(2).alias("s")))
    counts = sides.agg(F.count_if(F.col("s") == 1).alias("na"), F.count_if(F.col("s") == 2).alias("nb"))
    count_row = counts.where(F.col("na") != F.col("nb")).select(
        F.lit("error").alias("severity"), F.lit("feature_count").alias("kind"),
        F.format_string("metadata=%d state=%d", "na", "nb").alias("item"))
    miss_state = a.join(b, "item", "left_anti").select(F.lit("error").alias("severity"),
                                                       F.lit("missing_in_state").alias("kind"), "item")
    miss_meta = b.join(a, "item", "left_anti").select(F.lit("error").alias("severity"),
                                                      F.lit("missing_in_metadata").alias("kind"), "item")
    out = count_row.unionByName(miss_state).unionByName(miss_meta)
    mv, sv = meta_versions or {}, state_versions or {}
    warn = [("warning", "version", f"{k}: {mv.get(k)} != {sv.get(k)}") for k in sorted(set(mv) | set(sv))
            if mv.get(k) != sv.get(k)]
    if warn:
        out = out.unionByName(spark.createDataFrame(warn, "severity string, kind string, item string"))
    return out


# ---------------------------------------------------------------------- M10
def grouped_metrics(df: DataFrame, group: str, y: str, p: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.groupBy(group).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                                 (F.lit(1.0) - F.sum(e * e) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))


def run_log_rows(runs: DataFrame, run_id: str, params: dict, metrics: Sequence[str]) -> DataFrame:
    """Long (run_id, kind, key, value_text, value) rows for an append-only run log; a parameter is a text or a column."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    items = [F.struct(F.lit("param").alias("kind"), F.lit(k).alias("key"), text(v).alias("value_text"),
                      F.lit(None).cast("double").alias("value")) for k, v in params.items()]
    items += [F.struct(F.lit("metric").alias("kind"), F.lit(m).alias("key"), F.lit(None).cast("string")
                       .alias("value_text"), F.col(m).cast("double").alias("value")) for m in metrics]
    return runs.select(F.col(run_id).alias("run_id"), F.inline(F.array(*items)))


def latest_run(log: DataFrame, stamp: str = "started_at") -> DataFrame:
    """(run_id, started_at) of the newest run by a logged time, ties to the greatest id; no rows for an empty log."""
    return (log.where((F.col("kind") == "param") & (F.col("key") == stamp)).select("run_id", F.col("value_text").alias(stamp))
            .orderBy(F.desc(stamp), F.desc("run_id")).limit(1))


def best_runs(log: DataFrame, metric: str = "rmse", ascending: bool = True, n: int = 1000) -> DataFrame:
    """The ``n`` best runs by one logged metric, ranked: a per-task top-n, then a window over those rows."""
    from pyspark.sql import Window
    m = log.where((F.col("kind") == "metric") & (F.col("key") == metric)).select("run_id", F.col("value").alias(metric))
    order = F.asc(metric) if ascending else F.desc(metric)
    top = m.orderBy(order, F.asc("run_id")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(order, F.asc("run_id"))))
