"""Profiling operators (A1-A4): one wide aggregate per table, long outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles


def _long_one_row(row_df: DataFrame, cols: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Turn a one-row wide aggregate ``<col>__<stat>`` into (column, stat...) rows."""
    parts = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols]
    return row_df.select(F.inline(F.array(*parts)))


def number(column: str) -> Column:
    """The column as a double; NaN reads as null, so that it does not spoil an aggregate."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1: mean, sample std, min, max per numeric column in one pass (no unpivot
    of the data: only the one-row result is turned into long form)."""
    aggs = []
    for c in cols:
        x = number(c)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    return _long_one_row(df.agg(*aggs), cols, ["mean", "std", "min", "max"])


def target_profile(df: DataFrame, target: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A2: count, mean, std, min, max and exact quartiles of the target."""
    spark = df.sparkSession
    q = exact_quantiles(df, [target], probs)
    x = number(target)
    base = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).alias("min"), F.max(x).alias("max"))
    for p in probs:
        base = base.withColumn(f"q{int(round(p * 100)):02d}", F.lit(q[(target, p)]).cast("double"))
    return base.select(F.lit(target).alias("column"), "*")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: rows per distinct value of each categorical column, nulls left out.

    The columns are unpivoted and counted in one grouped aggregate; partial
    aggregation collapses each task's rows before the shuffle, so a value
    holding a third of the rows costs one row per task."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("r"))
    return (long.select("r.column", "r.value").where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> dict[str, tuple]:
    """Exact Q1, Q3 and the fences ``Q1 - k*IQR``, ``Q3 + k*IQR`` per column."""
    q = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            out[c] = (None, None, None, None)
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - factor * iqr, q3 + factor * iqr)
    return out


def outlier_report(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    """A4: quartiles, fences and the number of rows strictly outside them."""
    b = iqr_bounds(df, cols, factor)
    aggs = [F.count_if((number(c) < F.lit(b[c][2])) | (number(c) > F.lit(b[c][3]))).alias(f"{c}__n_outliers")
            for c in cols]
    counted = df.agg(*aggs)
    for c in cols:
        q1, q3, lo, hi = b[c]
        counted = (counted.withColumn(f"{c}__q1", F.lit(q1).cast("double"))
                   .withColumn(f"{c}__q3", F.lit(q3).cast("double"))
                   .withColumn(f"{c}__lower_bound", F.lit(lo).cast("double"))
                   .withColumn(f"{c}__upper_bound", F.lit(hi).cast("double")))
    return _long_one_row(counted, cols, ["q1", "q3", "lower_bound", "upper_bound", "n_outliers"])
