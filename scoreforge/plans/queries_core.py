"""Registered queries over the driver tables: profiling, validation,
scalar functions, metrics and explanations.  Every query reads whole tables;
doubles are rounded to 6 decimals (``r6``) only at the output so the DuckDB
oracle can compare values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import explain as E
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import quality as Q
from ..operators.ranking import rank_features
from ..session import prepare
from ..sources import views as V
from ..sources.tables import Tables
from .registry import query


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    prepare(spark)
    return Tables(spark, sf_dir)


def _round_doubles(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(X.r6(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


# ---------------------------------------------------------------- profiling
@query("a1_numeric_profile")
def a1(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _round_doubles(P.numeric_profile(t.lineitem, V.LINE_NUMERIC))


@query("a2_target_profile")
def a2(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _round_doubles(P.target_profile(t.orders, "o_totalprice"))


@query("a3_value_counts")
def a3(spark, sf_dir):
    t = _t(spark, sf_dir)
    return P.value_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("a4_outlier_report")
def a4(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _round_doubles(P.outlier_report(t.lineitem, V.LINE_NUMERIC))


@query("a5_regression_metrics")
def a5(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _round_doubles(M.regression_metrics(V.scored(t)))


@query("a6_tolerance_bands")
def a6(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _round_doubles(M.tolerance_bands(V.scored(t)))


@query("a7_global_importance")
def a7(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _round_doubles(M.global_importance(V.contributions_long(t)))


@query("s5_count_rows")
def s5(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t.lineitem.agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------ projections/scalars
@query("p5_project_drop")
def p5(spark, sf_dir):
    t = _t(spark, sf_dir)
    return Q.project_drop(t.part, drop=["p_retailprice"], keep=["p_partkey", "p_brand", "p_type", "p_size"])


def nullified_part(t: Tables) -> DataFrame:
    """part with nulls placed by key: name every 11th, brand every 7th, type every 5th."""
    k = F.col("p_partkey")
    return t.part.select(
        "p_partkey",
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("p_name"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("p_type"),
        "p_size")


@query("p6_fill_null")
def p6(spark, sf_dir):
    t = _t(spark, sf_dir)
    return Q.fill_null(nullified_part(t), text_cols=["p_name"], cat_cols=["p_brand", "p_type"])


@query("p7_clip")
def p7(spark, sf_dir):
    t = _t(spark, sf_dir)
    li = t.lineitem
    return _round_doubles(li.select(
        "l_orderkey", "l_linenumber",
        X.clip("l_quantity", 5.0, 45.0).alias("quantity_clipped"),
        X.clip("l_discount", 0.01, 0.09).alias("discount_clipped"),
        X.clip("l_tax", None, 0.05).alias("tax_clipped")))


@query("p9_tier")
def p9(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = F.col("l_discount") * 8
    return t.lineitem.select("l_orderkey", "l_linenumber", X.tier(s).alias("tier"))


@query("p10_round_score")
def p10(spark, sf_dir):
    t = _t(spark, sf_dir)
    unit = X.safe_div(F.col("l_extendedprice"), F.col("l_quantity") * 1000.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", (X.round_score(unit, 4) + 0.0).alias("score_4"))


@query("p11_map_lookup")
def p11(spark, sf_dir):
    t = _t(spark, sf_dir)
    # fixed values: priority weights of the lookup example
    weights = {"1-URGENT": 1.0, "2-HIGH": 0.8, "3-MEDIUM": 0.5, "4-NOT SPECIFIED": 0.2}
    table = spark.createDataFrame(list(weights.items()), "priority string, weight double")
    joined = X.map_join(t.orders, "o_orderpriority", table, "priority", "weight", "joined_weight")
    return joined.select(
        "o_orderkey", X.map_lookup("o_orderpriority", weights, 0.0).alias("priority_weight"), "joined_weight",
        F.array_join(Q.violations([Q.Known("o_orderpriority", tuple(weights))]), ",").alias("violations"))


@query("p12_weighted_score")
def p12(spark, sf_dir):
    t = _t(spark, sf_dir)
    return V.cases(t, with_description=False).select("case_id", X.weighted_score().alias("case_score"))


@query("p13_render_text")
def p13(spark, sf_dir):
    t = _t(spark, sf_dir)
    return V.cases(t).select("case_id", "description")


# --------------------------------------------------------------- validation
def line_constraints():
    return [Q.Range("l_quantity", ge=1, le=45), Q.Range("l_discount", le=0.08),
            Q.Range("l_tax", ge=0.01), Q.Range("l_extendedprice", ge=0)]


def order_constraints():
    return [Q.Domain("o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),
            Q.Domain("o_orderstatus", ("F", "O")), Q.Range("o_totalprice", ge=1000.0)]


@query("p1_range_check")
def p1(spark, sf_dir):
    t = _t(spark, sf_dir)
    return (Q.with_violations(t.lineitem, line_constraints())
            .select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("violations")))


@query("p2_domain_check")
def p2(spark, sf_dir):
    t = _t(spark, sf_dir)
    return (Q.with_violations(t.orders, order_constraints()[:2])
            .select("o_orderkey", F.array_join("violations", ",").alias("violations")))


@query("p3_required_columns")
def p3(spark, sf_dir):
    t = _t(spark, sf_dir)
    cases = V.cases(t)
    req = [Q.Required(c) for c in ["gid"] + V.CASE_CATEGORICAL + V.CASE_NUMERIC + [V.CASE_TEXT]]
    return (Q.with_violations(cases, req)
            .select("case_id", F.array_join("violations", ",").alias("violations")))


@query("p4_split_valid_invalid")
def p4(spark, sf_dir):
    t = _t(spark, sf_dir)
    valid, invalid = Q.split_valid_invalid(t.orders, order_constraints())
    return (valid.select("o_orderkey", F.lit("valid").alias("status"), F.lit("").alias("reasons"))
            .unionByName(invalid.select("o_orderkey", F.lit("invalid").alias("status"),
                                        F.array_join("reasons", ",").alias("reasons"))))


# ------------------------------------------------------------- explanations
def _contrib(spark, sf_dir):
    return V.contributions_wide(_t(spark, sf_dir))


@query("e3_linear_contributions")
def e3(spark, sf_dir):
    return _round_doubles(_contrib(spark, sf_dir).select("id", F.inline("contrib")))


@query("w1_topk_signed")
def w1(spark, sf_dir):
    return _round_doubles(E.topk_signed(_contrib(spark, sf_dir)))


@query("w2_rank_features")
def w2(spark, sf_dir):
    imp = M.global_importance(V.contributions_long(_t(spark, sf_dir)))
    return _round_doubles(rank_features(imp, n=10))


@query("w3_contribution_list")
def w3(spark, sf_dir):
    c = _contrib(spark, sf_dir)
    return c.select("id", E.contrib_text(E.contribution_list(F.col("contrib"))).alias("contributions"))


@query("e4_explanation_text")
def e4(spark, sf_dir):
    c = _contrib(spark, sf_dir)
    return c.select("id", E.explanation_text(F.col("prediction"), F.col("contrib")).alias("explanation_summary"))


@query("e5_explanation_record")
def e5(spark, sf_dir):
    rec = E.explanation_record(_contrib(spark, sf_dir))
    return _round_doubles(rec.select(
        "instance_id", "prediction", "expected_value",
        E.contrib_text(F.col("feature_contributions")).alias("feature_contributions"),
        E.contrib_text(F.col("top_positive_features")).alias("top_positive_features"),
        E.contrib_text(F.col("top_negative_features")).alias("top_negative_features"),
        "explanation_summary"))


@query("e6_name_alignment")
def e6(spark, sf_dir):
    c = _contrib(spark, sf_dir)
    shap = F.col("contrib")["shap"]
    values = F.slice(F.col("contrib")["value"], 1, 3)
    # a six-name catalog against four contributions: names fall back to feature_<i>; a fitting one is used
    kinds = (("other", V.LINE_CATEGORICAL + V.LINE_NUMERIC), ("fitting", V.LINE_NUMERIC))
    both = F.array(*[F.struct(F.lit(kind).alias("catalog"), E.align_names(shap, values, names).alias("items"))
                     for kind, names in kinds])
    out = c.select("id", F.inline(both)).select("catalog", "id", F.posexplode("items").alias("idx", "item"))
    return _round_doubles(out.select("catalog", "id", "idx", "item.feature", "item.value", "item.shap"))


@query("flagship_tier_summary")
def flagship_q(spark, sf_dir):
    from .flagship import flagship
    return flagship(spark, sf_dir)
