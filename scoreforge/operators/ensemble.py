"""A fitted tree ensemble as flat numpy arrays: scoring inside Arrow batches without a model object.

The node table of a saved model (bounded by trees x 2^depth) becomes arrays that
are broadcast once; a batch steps down each tree together.  ``trees_of`` says which trees
split on a feature, so that work which changes one feature touches those trees only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import treeshap


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray          # -1: a leaf
    right: np.ndarray
    value: np.ndarray         # prediction times tree weight

    def walk(self, x: np.ndarray) -> np.ndarray:
        """Leaf value of every row."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.left[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[node]

    def paths(self) -> list[tuple[list[int], list[list[tuple[float, bool]]], float]]:
        """Per leaf: the features split on, each one's splits as (threshold, goes left), and the leaf's value."""
        out, todo = [], [(0, {})]
        while todo:
            node, splits = todo.pop()
            if self.left[node] < 0:
                out.append((list(splits), list(splits.values()), float(self.value[node])))
                continue
            f, t = int(self.feature[node]), float(self.threshold[node])
            for child, left in ((self.left[node], True), (self.right[node], False)):
                todo.append((int(child), {**splits, f: [*splits.get(f, []), (t, left)]}))
        return out


def followed(column: np.ndarray, splits: list[tuple[float, bool]]) -> np.ndarray:
    """Which values keep to all of the splits; what is not a number goes right."""
    ok = np.ones(len(column), bool)
    for threshold, left in splits:
        ok &= (column <= threshold) if left else ~(column <= threshold)
    return ok


class Ensemble:
    """Trees with their weights folded into the leaf values."""

    def __init__(self, nodes: dict[int, dict[int, treeshap.Node]], weights: list[float]):
        self.trees: list[Tree] = []
        self.trees_of: dict[int, list[int]] = {}
        for place, (tid, own) in enumerate(sorted(nodes.items())):
            ids = sorted(own)
            at = {node: k for k, node in enumerate(ids)}
            flat = [own[i] for i in ids]
            self.trees.append(Tree(np.array([max(n.feature, 0) for n in flat]), np.array([n.threshold for n in flat]),
                                   np.array([at.get(n.left, -1) for n in flat]), np.array([at.get(n.right, -1) for n in flat]),
                                   np.array([n.prediction * weights[tid] for n in flat])))
            for f in sorted({n.feature for n in flat if n.left >= 0}):
                self.trees_of.setdefault(f, []).append(place)

    def tree_values(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf values."""
        return np.stack([t.walk(x) for t in self.trees], axis=1) if self.trees else np.zeros((len(x), 0))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values in the order of the trees."""
        total = np.zeros(len(x))
        for t in self.trees:
            total += t.walk(x)
        return total

    __call__ = predict

    def mean_over(self, background: np.ndarray, z: np.ndarray):
        """Function of rows: (rows, coalitions) mean scores where features outside a coalition come from the background.

        A leaf counts for a row as far as the row keeps to the path's splits on the coalition's features, times the share of
        background rows that keep to the others: those shares are counted here, once per leaf and distinct part of a coalition.
        """
        plan, fixed = [], np.zeros(len(z))
        for tree in self.trees:
            for features, splits, value in tree.paths():
                own = np.stack([followed(background[:, f], s) for f, s in zip(features, splits)], axis=1) if features \
                    else np.ones((len(background), 0), bool)
                parts, where = np.unique(z[:, features] > 0, axis=0, return_inverse=True)
                where = where.ravel()
                for i, inside in enumerate(parts):
                    amount = value * float((own | inside).all(axis=1).mean())
                    held = [k for k in range(len(features)) if inside[k]]
                    if not held:
                        fixed[where == i] += amount
                    elif amount:
                        plan.append(([(features[k], splits[k]) for k in held], np.flatnonzero(where == i), amount))

        def means(x: np.ndarray) -> np.ndarray:
            out = np.tile(fixed, (len(x), 1))
            for held, columns, amount in plan:
                keeps = np.ones(len(x), bool)
                for f, s in held:
                    keeps &= followed(x[:, f], s)
                out[np.ix_(np.flatnonzero(keeps), columns)] += amount
            return out
        return means

    def changed(self, x: np.ndarray, values: np.ndarray, feature: int, other: np.ndarray) -> np.ndarray:
        """Change of each row's score when ``feature`` takes the values ``other``: only its own trees are walked again."""
        change = np.zeros(len(x))
        rows = np.flatnonzero(x[:, feature] != other)
        if len(rows):
            mixed = x[rows]
            mixed[:, feature] = other[rows]
            for t in self.trees_of.get(feature, ()):
                change[rows] += self.trees[t].walk(mixed) - values[rows, t]
        return change


def matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def dense(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix over its buffer, nothing copied."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def predictions(ensemble: Ensemble, spark, features: Column, lo: float | None = 0.0, hi: float | None = 1.0) -> Column:
    """Scores of a vector column by a broadcast ensemble, clipped; row-local in any batch or streaming plan."""
    shared = spark.sparkContext.broadcast(ensemble)

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.predict(dense(x)))
    raw = score(vector_to_array(features))
    return raw if lo is None and hi is None else X.clip(raw, lo, hi)


# ------------------------------------------------------------------ permutation importance
def partnered(data: DataFrame, key: str, label: str, features: str, seed: int, buckets: int) -> DataFrame:
    """Rows in a random order that needs no window: (bucket, last, h, k, y, x) dealt and sorted by ``bucket``.

    A row's partner is the next row by (hash of key and seed, key), after the last comes the first.
    Buckets are equal ranges of the hash, so the order is the same for any number of them; each one ends with a
    copy of the next one's first row (``last`` = 1).
    """
    h = X.hash_int(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    rows = data.where(F.col(label).isNotNull()).select(
        F.floor(h * buckets / F.lit(2 ** 32)).cast("int").alias("bucket"), F.lit(0).alias("last"), h.alias("h"),
        F.col(key).alias("k"), F.col(label).cast("double").alias("y"), vector_to_array(F.col(features)).alias("x"))
    first = rows.groupBy("bucket").agg(F.min(F.struct("h", "k", "y", "x")).alias("r"))
    order = sorted(r["bucket"] for r in first.select("bucket").collect())      # one number per bucket
    before = [(b, order[i - 1]) for i, b in enumerate(order)]
    ends = first.join(data.sparkSession.createDataFrame(before, "bucket int, ends int"), "bucket").select(
        F.col("ends").alias("bucket"), F.lit(1).alias("last"), "r.h", "r.k", "r.y", "r.x")
    return rows.unionByName(ends).repartition(buckets, "bucket").sortWithinPartitions("bucket", "last", "h", "k")


def permutation_errors(ensemble: Ensemble, dealt: DataFrame, width: int) -> DataFrame:
    """(feature, sse, n): squared error with a feature taken from the partners; feature -1: unchanged."""
    shared = dealt.sparkSession.sparkContext.broadcast(ensemble)

    def run(batches):
        model = shared.value
        own = sorted(model.trees_of)
        sse, n, held = np.zeros(len(own) + 1), 0, None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            held = pdf.iloc[-1:]
            if len(pdf) < 2:
                continue
            x, mine = matrix(pdf["x"], width), np.flatnonzero(pdf["last"].to_numpy()[:-1] == 0)
            here, partner, y = x[mine], x[mine + 1], pdf["y"].to_numpy()[mine]
            values = model.tree_values(here)
            off = values.sum(axis=1) - y
            n += len(mine)
            sse[0] += float(off @ off)
            for i, f in enumerate(own):
                new = off + model.changed(here, values, f, partner[:, f])
                sse[i + 1] += float(new @ new)
        yield pd.DataFrame({"feature": [-1, *own], "sse": sse, "n": n})

    narrow = dealt.select("last", "y", "x").mapInPandas(run, "feature int, sse double, n long")
    return narrow.groupBy("feature").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
