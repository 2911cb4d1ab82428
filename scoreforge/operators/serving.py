"""A fitted pipeline and model as versioned state that batch and streaming jobs read.

``publish`` writes a bundle (features, model) under a new version number and appends it to a log;
``current`` reads the newest one.  A running stream looks at the log before each micro-batch, so a new version is
served without a restart.  The state is bounded (vocabulary, labels, numbers, trees), its ensemble is
broadcast, and scoring is row-local: every input row keeps its columns, whatever its id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bundle
from . import explain as E
from . import features as FT
from . import model as MD
from . import treeshap
from .ensemble import Ensemble, dense, predictions

#: Rows explained at a time.
BLOCK_ROWS = 2048
LOG = "version long, path string, published_at string"


@dataclass
class Served:
    """One version: fitted features, flat trees, and what explanations need."""

    version: int
    features: FT.FittedFeatures
    ensemble: Ensemble
    nodes: dict
    weights: list

    @property
    def names(self) -> list[str]:
        return self.features.feature_names()


def served(spark: SparkSession, version: int, features: FT.FittedFeatures, path: str) -> Served:
    """The state of a bundle saved at ``path`` (by ``model.save_model``)."""
    nodes, weights = MD.node_table(spark, path)
    return Served(version, features, Ensemble(nodes, weights), nodes, weights)


def publish(spark: SparkSession, root: str, fm: MD.FittedModel, features: FT.FittedFeatures, version: int,
            published_at: str = "") -> Served:
    """Write version ``version`` and then, as the last step, its line of the log: readers never see half a bundle."""
    path = f"{root}/versions/{version}"
    MD.save_model(fm, spark, path, {"model_version": str(version)})
    features.save(spark, f"{path}/features")
    bundle.write_manifest(spark, path)
    spark.createDataFrame([(version, path, published_at)], LOG).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/log/entry={version}")
    return served(spark, version, features, path)


class Server:
    """Reads the newest version of ``root``, keeping the one it has until there is another."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.held = spark, root, None

    def current(self) -> Served:
        newest = self.spark.read.schema(LOG).parquet(f"{self.root}/log").orderBy(F.desc("version")).first()
        if newest is None:
            raise ValueError("no version is published")
        if self.held is None or self.held.version != newest["version"]:
            features = FT.FittedFeatures.load(self.spark, f"{newest['path']}/features")
            self.held = served(self.spark, newest["version"], features, newest["path"])
        return self.held


def scored(df: DataFrame, state: Served, out: str = "prediction", explain: str | None = None,
           keep: Sequence[str] = ()) -> DataFrame:
    """``df`` with the clipped prediction in ``out`` and, if named, the contributions of ``explain`` as an array.

    The feature columns replace those of the input of the same name, except those in ``keep``.
    """
    held = {c: f"__kept_{c}" for c in keep if c in df.columns}
    rows = df.select("*", *[F.col(c).alias(k) for c, k in held.items()])
    rows = state.features.transform(rows, "__features")
    rows = rows.withColumn(out, predictions(state.ensemble, df.sparkSession, F.col("__features")))
    if explain is not None:
        rows = rows.withColumn(explain, contribution_column(df.sparkSession, state.nodes, state.weights, state.names,
                                                            F.col("__features")))
    for c, k in held.items():
        rows = rows.withColumn(c, F.col(k)).drop(k)
    return rows.drop("__features")


def contribution_column(spark: SparkSession, nodes: dict, weights: list, names: Sequence[str], features: Column) -> Column:
    """Tree SHAP of a vector column as array<struct<feature, value, shap>>, zero entries of zero values left out."""
    shared, n = spark.sparkContext.broadcast((nodes, weights)), len(names)
    made: list = []                                    # a task's paths

    @F.arrow_udf("array<double>")
    def shap(column: pa.Array) -> pa.Array:
        if not made:
            made.append([p for tid, own in sorted(shared.value[0].items())
                         for p in treeshap.leaf_paths(own, min(own), shared.value[1][tid])[0]])
        x, phi = dense(column), np.zeros((len(column), n))
        for at in range(0, len(x), BLOCK_ROWS):
            phi[at:at + BLOCK_ROWS] = treeshap.contributions(x[at:at + BLOCK_ROWS], made[0], n)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(n)), pa.array(phi.ravel()))

    x = vector_to_array(features)
    labels = F.array(*[F.lit(c) for c in names])
    pairs = F.arrays_zip(labels.alias("feature"), x.alias("value"), shap(x).alias("shap"))
    return F.filter(F.transform(pairs, lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value"),
                                                          c["shap"].alias("shap"))),
                    lambda c: (c["shap"] != 0) | (c["value"] != 0)).cast(E.CONTRIB_TYPE)
