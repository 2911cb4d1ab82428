"""Model-agnostic contributions (E2): kernel-weighted least squares over coalitions of features.

A coalition's value is the mean score of the row with the features outside it taken from the
background rows.  Contributions are the weighted least-squares fit of a sum over features to those
values, with the Shapley kernel as weights and the sum fixed to score less expected value.  With no more than
``evaluations`` coalitions in all (2^d - 2) every one is taken and the fit is the Shapley value itself;
beyond, whole sizes are taken from the outside in and the rest drawn in complementary pairs, the same
for every row.  The design is then one matrix, made once, and a row's contributions are that matrix times its values.

Work per row is bounded: coalitions x background rows evaluations, made with
numpy inside the Arrow batch the row came in, a bounded block of rows at a
time.  A scorer that can state its mean over the background (``mean_over``: a linear one, an ``Ensemble``) does so
from sums over the background made once per task, and a row then costs the same whatever their number; any other
callable is evaluated on every mixed row.  No row is exploded before it is scored and nothing is shuffled; the
background is ``background`` real rows, broadcast.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Numbers in one block of mixed rows: small enough to stay in a core's cache (4,000,000 took six times as long).
BLOCK_VALUES = 60_000


def coalitions(d: int, evaluations: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(coalitions, features) membership and kernel weights; neither the empty nor the full one."""
    share = {s: (d - 1) / (s * (d - s)) for s in range(1, d)}        # kernel mass of all coalitions of a size
    rows, weights, left = [], [], evaluations
    open_sizes = list(range(1, d))
    while open_sizes:
        sizes = sorted({open_sizes[0], open_sizes[-1]})              # a size and its complement
        count = sum(math.comb(d, s) for s in sizes)
        if count > left:
            break
        for s in sizes:
            rows += [c for c in itertools.combinations(range(d), s)]
            weights += [share[s] / math.comb(d, s)] * math.comb(d, s)
        left -= count
        open_sizes = open_sizes[1:-1]
    if open_sizes and left >= 2:
        rng = np.random.default_rng(seed)
        mass = np.array([share[s] for s in open_sizes])
        drawn = [tuple(sorted(rng.choice(d, s, replace=False).tolist()))
                 for s in rng.choice(open_sizes, left // 2, p=mass / mass.sum())]
        both = drawn + [tuple(sorted(set(range(d)) - set(c))) for c in drawn]
        rows += both
        weights += [mass.sum() / len(both)] * len(both)
    z = np.zeros((len(rows), d))
    for i, c in enumerate(rows):
        z[i, list(c)] = 1.0
    return z, np.array(weights)


def solver(z: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, c) with contributions = A (values - base) + c (score - base): the fit under the fixed sum."""
    d = z.shape[1]
    if d == 1:
        return np.zeros((1, len(z))), np.ones(1)
    inverse = np.linalg.pinv(z.T @ (weights[:, None] * z))
    fit = inverse @ (z.T * weights)
    ones = inverse.sum(axis=1) / inverse.sum()
    return fit - np.outer(ones, fit.sum(axis=0)), ones


class LinearScore:
    """``intercept`` plus the weighted sum of the features."""

    def __init__(self, intercept: float, weights: Sequence[float]):
        self.intercept, self.weights = intercept, np.array(weights, dtype=float)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + x @ self.weights

    def mean_over(self, background: np.ndarray, z: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """Mean scores of rows under the coalitions: a feature outside one gives its terms' mean over the background."""
        outside = (1.0 - z) @ (background * self.weights).mean(axis=0)
        inside = z.T * self.weights[:, None]
        return lambda x: self.intercept + (x @ inside + outside)


def mean_scores(score: Callable[[np.ndarray], np.ndarray], background: np.ndarray,
                z: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Function of rows: (rows, coalitions) mean scores over the background rows that fill in the features left out."""
    if hasattr(score, "mean_over"):
        return score.mean_over(background, z)

    def mixed(x: np.ndarray) -> np.ndarray:
        rows = np.where(z[None, :, None, :] > 0, x[:, None, None, :], background[None, None, :, :])
        return score(rows.reshape(-1, x.shape[1])).reshape(len(x), len(z), len(background)).mean(axis=2)
    return mixed


def kernel_contributions(x: np.ndarray, background: np.ndarray, z: np.ndarray, design: tuple[np.ndarray, np.ndarray],
                         score: Callable[[np.ndarray], np.ndarray],
                         means: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """(rows, features) contributions of ``x`` for the coalitions ``z``; ``means``: their ``mean_scores``, if at hand."""
    values = (means or mean_scores(score, background, z))(x)
    base = float(score(background).mean())
    a, c = design
    return (values - base) @ a.T + np.outer(score(x) - base, c)


def sampled_contributions(df: DataFrame, key: str, features: str, score: Callable[[np.ndarray], np.ndarray],
                          names: Sequence[str], background: int = 20, evaluations: int = 100) -> DataFrame:
    """Long (key, feature, value, shap, expected_value); ``to_wide`` for arrays.

    ``score`` maps a (rows, features) matrix to scores, as ``Ensemble.predict`` does for a fitted model.
    """
    d, names = len(names), list(names)
    x = df.select(F.col(key).alias("__k"), vector_to_array(F.col(features)).alias("__x"))
    # the background: at most `background` real rows with the smallest key hash (TakeOrderedAndProject)
    picked = (x.withColumn("__h", X.hash_int(F.col("__k").cast("string"))).orderBy("__h", "__k")
              .limit(background).select("__x").collect())
    rows = np.array([r["__x"] for r in picked], dtype=float).reshape(len(picked), d)
    expected = float(score(rows).mean()) if len(rows) else 0.0
    z, weights = coalitions(d, evaluations)
    shared = df.sparkSession.sparkContext.broadcast((rows, z, solver(z, weights)))
    per_row = len(z) * d * (1 if hasattr(score, "mean_over") else len(rows))
    block = max(1, BLOCK_VALUES // max(1, per_row))

    def run(batches):
        background, z, design = shared.value
        means = mean_scores(score, background, z) if len(background) else None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            phi = np.concatenate([kernel_contributions(own[at:at + block], background, z, design, score, means)
                                  for at in range(0, len(own), block)])
            shap = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, d, dtype=np.int32)), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("__k"), batch.column("__x"), shap], ["__k", "__x", "__shap"])

    kind = x.schema["__k"].dataType.simpleString()
    out = x.mapInArrow(run, f"__k {kind}, __x array<double>, __shap array<double>")
    items = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), F.col("__x").alias("value"),
                         F.col("__shap").alias("shap"))
    return out.select(F.col("__k").alias(key), F.inline(items)).select(
        key, "feature", "value", "shap", F.lit(expected).alias("expected_value"))


def to_wide(long: DataFrame, key: str) -> DataFrame:
    """(key, contrib array) from the long form (one bounded group per key)."""
    return long.groupBy(key, "expected_value").agg(
        F.array_sort(F.collect_list(F.struct("feature", "value", "shap"))).alias("contrib"))
