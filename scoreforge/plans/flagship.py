"""Flagship query: fenced, standardised and scored lineitem summarised by tier.

scan -> exact quartile fences (fit) -> cap -> standardise (fit) -> linear
score clamped to [0, 1] -> tier -> per-tier error aggregates.  The fitted
state is a handful of literals, so the scoring is one codegen'd projection
and the only shuffle is the final partial/final aggregate over three tiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import features as FT
from ..session import prepare
from ..sources import views as V
from ..sources.tables import Tables

# fixed values: linear score weights on standardised lineitem columns
WEIGHTS = {"l_quantity": 0.12, "l_extendedprice": 0.10, "l_discount": -0.08, "l_tax": 0.05}
INTERCEPT = 0.5


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    li = Tables(spark, sf_dir).lineitem.select(*V.LINE_NUMERIC)
    state = FT.numeric_fit(li, V.LINE_NUMERIC)
    scaled = FT.standardize(FT.iqr_cap(li, state.bounds), state, suffix="_z")
    lin = X.sum_columns([F.lit(w) * F.col(f"{c}_z") for c, w in WEIGHTS.items()])
    score = X.clip(F.lit(INTERCEPT) + lin, 0.0, 1.0)
    y = F.col("l_tax") * 10
    scored = scaled.select(score.alias("score"), y.alias("y"))
    e = F.col("score") - F.col("y")
    out = scored.groupBy(X.tier("score").alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"),
        F.max("score").alias("max_score"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return out.select("tier", "n", *[X.r6(c).alias(c) for c in ["mean_score", "min_score", "max_score", "rmse", "mae"]])
