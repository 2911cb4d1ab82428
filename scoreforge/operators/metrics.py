"""Model-error operators (A5, A6) and global importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

TOLERANCES = (0.05, 0.1, 0.15, 0.2)


def regression_metrics(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """A5: rmse, mae, r2, explained variance, max error, MAPE, median absolute
    error and the population std of the residual, as one row.

    Everything but the median is one partial+final aggregate; the median of the
    absolute error uses the exact distributed selection.
    """
    e = F.col(y_hat) - F.col(y)
    resid = F.col(y) - F.col(y_hat)
    base = df.select(F.col(y).cast("double").alias("_y"), F.col(y_hat).cast("double").alias("_p"))
    base = base.withColumn("_ae", F.abs(F.col("_p") - F.col("_y")))
    med = exact_quantiles(base, ["_ae"], [0.5])[("_ae", 0.5)]
    e = F.col("_p") - F.col("_y")
    resid = F.col("_y") - F.col("_p")
    agg = base.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / (F.var_pop("_y") * F.count(F.lit(1)))).alias("r2"),
        (F.lit(1.0) - F.var_pop(resid) / F.var_pop("_y")).alias("explained_variance"),
        F.max(F.abs(e)).alias("max_error"),
        (F.avg(F.abs(e) / F.greatest(F.col("_y"), F.lit(1e-8))) * 100).alias("mape"),
        F.stddev_pop(resid).alias("std_residual"),
    )
    return agg.withColumn("median_ae", F.lit(med).cast("double"))


def tolerance_bands(df: DataFrame, y: str = "y", y_hat: str = "y_hat",
                    tolerances: Sequence[float] = TOLERANCES) -> DataFrame:
    """Percent of rows whose absolute error is within each tolerance."""
    ae = F.abs(F.col(y_hat) - F.col(y))
    aggs = [F.avg(F.when(ae <= F.lit(t), 100.0).otherwise(0.0)).alias(f"within_{int(round(t * 100)):02d}")
            for t in tolerances]
    return df.agg(*aggs)


def global_importance(contrib_long: DataFrame, feature: str = "feature", shap: str = "shap") -> DataFrame:
    """Mean absolute contribution per feature (partial aggregate, tiny shuffle)."""
    return contrib_long.groupBy(feature).agg(F.avg(F.abs(F.col(shap))).alias("mean_abs_shap"))
