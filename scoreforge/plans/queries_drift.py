"""Registered drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.quantiles import exact_median
from ..operators import drift as D
from ..sources import views as V
from .queries_core import _round_doubles, _t
from .registry import query


def order_split(t):
    o = t.orders.withColumn("_epoch", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    med = exact_median(o, "_epoch")
    return o.where(F.col("_epoch") < F.lit(med)), o.where(F.col("_epoch") >= F.lit(med))


@query("d1_numeric_drift")
def d1(spark, sf_dir):
    ref, cur = V.ship_split(_t(spark, sf_dir))
    return _round_doubles(D.numeric_drift(ref, cur, V.LINE_NUMERIC))


@query("d2_categorical_drift")
def d2(spark, sf_dir):
    ref, cur = order_split(_t(spark, sf_dir))
    return _round_doubles(D.categorical_drift(ref, cur, ["o_orderstatus", "o_orderpriority"]))


@query("d3_dataset_drift")
def d3(spark, sf_dir):
    ref, cur = V.ship_split(_t(spark, sf_dir))
    num = D.numeric_drift(ref, cur, V.LINE_NUMERIC)
    cat = D.categorical_drift(ref, cur, V.LINE_CATEGORICAL)
    return _round_doubles(D.dataset_drift(num, cat))


@query("d5_output_drift")
def d5(spark, sf_dir):
    ref, cur = V.ship_split(_t(spark, sf_dir))
    pred = lambda df: df.select(X.clip(F.col("l_discount") * 8, 0.0, 1.0).alias("y_hat"))
    return _round_doubles(D.numeric_drift(pred(ref), pred(cur), ["y_hat"]))
