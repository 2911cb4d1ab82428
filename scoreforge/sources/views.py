"""Derived views built from the input tables (the same definitions exist as
DuckDB SQL in ``checks/oracle_sql.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..functions.quantiles import exact_median
from .tables import Tables

CASE_CATEGORICAL = ["risk_category", "region", "business_type", "regulatory_status", "compliance_level"]
CASE_NUMERIC = [
    "revenue", "employee_count", "years_in_business", "credit_score", "debt_to_equity_ratio",
    "liquidity_ratio", "market_share", "growth_rate", "profitability_margin",
    "customer_satisfaction", "operational_efficiency", "regulatory_violations", "audit_score",
]
CASE_TEXT = "description"
CASE_TARGET = "case_score"

LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORICAL = ["l_returnflag", "l_linestatus"]
# fixed values: weights of the linear contribution view
LINE_WEIGHTS = {"l_quantity": 0.01, "l_extendedprice": 0.00001, "l_discount": 2.0, "l_tax": -3.0}


def cases(t: Tables, with_description: bool = True, with_target: bool = False) -> DataFrame:
    """One business case per customer that has orders.

    Orders are pre-aggregated per customer before the join (map-side partial
    aggregation absorbs a customer holding a large share of the orders); the
    nation and region dimensions are tiny and broadcast by Spark's size check.
    """
    per_cust = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    k = F.col("c_custkey")
    base = (t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(per_cust, F.col("c_custkey") == F.col("o_custkey"))
            .join(t.nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    out = base.select(
        k.alias("case_id"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("C"), k.cast("string"))).alias("gid"),
        X.pick(K.RISK_CATEGORIES, k % 4).alias("risk_category"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("business_type"),
        X.pick(K.REGULATORY_STATUSES, k % 5).alias("regulatory_status"),
        X.pick(K.COMPLIANCE_LEVELS, F.floor(k / 5).cast("long") % 5).alias("compliance_level"),
        F.col("total").alias("revenue"),
        F.col("n_orders").cast("int").alias("employee_count"),
        (F.lit(1) + k % 40).cast("int").alias("years_in_business"),
        (F.lit(300) + (k * 37) % 551).cast("int").alias("credit_score"),
        ((k % 31) / 10.0).alias("debt_to_equity_ratio"),
        ((k % 29) / 10.0).alias("liquidity_ratio"),
        ((k % 51) / 100.0).alias("market_share"),
        ((k % 41 - 10) / 100.0).alias("growth_rate"),
        ((k % 31 - 5) / 100.0).alias("profitability_margin"),
        (k % 101).cast("double").alias("customer_satisfaction"),
        ((k * 3) % 101).cast("double").alias("operational_efficiency"),
        (k % 9).cast("int").alias("regulatory_violations"),
        ((k * 7) % 101).cast("double").alias("audit_score"),
    )
    if with_description:
        out = out.withColumn(CASE_TEXT, X.render_description("case_id"))
    if with_target:
        out = out.withColumn(CASE_TARGET, X.weighted_score())
    return out


def scored(t: Tables) -> DataFrame:
    """lineitem with a target ``y`` and a fixed prediction ``y_hat``."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_tax") * 10).alias("y"),
        X.clip(F.col("l_discount") * 8, 0.0, 1.0).alias("y_hat"),
    )


def line_id() -> F.Column:
    """Row key of lineitem: order, line, part and supplier."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def contributions_wide(t: Tables, weights: dict[str, float] = LINE_WEIGHTS) -> DataFrame:
    """Linear contributions ``w * (x - mean x)`` as one array per row."""
    from ..operators.explain import linear_contributions
    return linear_contributions(t.lineitem.withColumn("id", line_id()), "id", weights)


def contributions_long(t: Tables) -> DataFrame:
    return contributions_wide(t).select("id", F.inline("contrib"))


def ship_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """lineitem before / from the median ship date (exact median of epoch seconds)."""
    li = t.lineitem.withColumn("_epoch", F.unix_seconds(F.col("l_shipdate").cast("timestamp")))
    med = exact_median(li, "_epoch")
    ref = li.where(F.col("_epoch") < F.lit(med)).drop("_epoch")
    cur = li.where(F.col("_epoch") >= F.lit(med)).drop("_epoch")
    return ref, cur
