"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.text import tokenize
from ..operators import features as FT
from ..session import work_path
from ..sources import views as V
from .queries_core import _round_doubles, _t, nullified_part
from .registry import query


def line_keyed(t):
    return t.lineitem.withColumn("id", V.line_id())


def line_pipeline() -> FT.FeaturePipeline:
    return FT.FeaturePipeline(text_col=None, cat_cols=V.LINE_CATEGORICAL, num_cols=V.LINE_NUMERIC)


def case_pipeline() -> FT.FeaturePipeline:
    return FT.FeaturePipeline(text_col=V.CASE_TEXT, cat_cols=V.CASE_CATEGORICAL, num_cols=V.CASE_NUMERIC)


def train_rows(df, key):
    """The 80 % training side of the md5 hash split (M1)."""
    return df.where(X.hash_mod(key, 100) < 80)


@query("f1_tokenize")
def f1(spark, sf_dir):
    t = _t(spark, sf_dir)
    tok = tokenize(t.documents.select("doc_id", "text"), "text")
    return tok.select("doc_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("terms_md5"))


@query("f2_tfidf_fit")
def f2(spark, sf_dir):
    t = _t(spark, sf_dir)
    vocab = FT.tfidf_fit(t.documents.select("text"), "text")
    return _round_doubles(vocab.to_df(spark))


@query("f3_tfidf_transform")
def f3(spark, sf_dir):
    t = _t(spark, sf_dir)
    docs = t.documents.select("doc_id", "text")
    vocab = FT.tfidf_fit(docs.select("text"), "text")
    vec = FT.tfidf_transform(tokenize(docs, "text"), vocab)
    return _round_doubles(FT.tfidf_long(vec, "doc_id"))


@query("f4_label_fit")
def f4(spark, sf_dir):
    t = _t(spark, sf_dir)
    return FT.label_fit(t.part, ["p_brand", "p_type"]).to_df(spark)


@query("f5_label_transform")
def f5(spark, sf_dir):
    t = _t(spark, sf_dir)
    part = nullified_part(t)
    labels = FT.label_fit(part.where(X.hash_mod("p_partkey", 100) < 20), ["p_name", "p_brand", "p_type"])
    return FT.label_transform(part, labels).select("p_partkey", "p_name", "p_brand", "p_type")


@query("f6_iqr_cap")
def f6(spark, sf_dir):
    t = _t(spark, sf_dir)
    li = line_keyed(t)
    from ..operators.profile import iqr_bounds
    capped = FT.iqr_cap(li, iqr_bounds(li, V.LINE_NUMERIC))
    return _round_doubles(capped.select("id", *V.LINE_NUMERIC))


@query("f7_standardize")
def f7(spark, sf_dir):
    t = _t(spark, sf_dir)
    li = line_keyed(t)
    state = FT.numeric_fit(li, V.LINE_NUMERIC)
    out = FT.standardize(FT.iqr_cap(li, state.bounds), state)
    return _round_doubles(out.select("id", *V.LINE_NUMERIC))


@query("f8_assemble")
def f8(spark, sf_dir):
    t = _t(spark, sf_dir)
    cases = V.cases(t)
    fitted = case_pipeline().fit(cases)
    return _round_doubles(fitted.long_form(cases, "case_id"))


@query("f9_feature_catalog")
def f9(spark, sf_dir):
    t = _t(spark, sf_dir)
    return case_pipeline().fit(V.cases(t)).catalog(spark)


@query("f10_target_column")
def f10(spark, sf_dir):
    t = _t(spark, sf_dir)
    return FT.target_column(t.orders, "o_totalprice", key="o_orderkey")


@query("f11_pipeline_fit_transform")
def f11(spark, sf_dir):
    t = _t(spark, sf_dir)
    li = line_keyed(t)
    fitted = line_pipeline().fit(train_rows(li, "id"))
    return _round_doubles(fitted.long_form(li, "id"))


@query("f12_state_save_load")
def f12(spark, sf_dir):
    t = _t(spark, sf_dir)
    li = line_keyed(t)
    fitted = line_pipeline().fit(train_rows(li, "id"))
    path = work_path(spark, "state", "lineitem_features")
    fitted.save(spark, path)
    loaded = FT.FittedFeatures.load(spark, path)
    return _round_doubles(loaded.long_form(li, "id"))


@query("f12_text_state")
def f12_text(spark, sf_dir):
    """The state of the whole pipeline - vocabulary, dictionaries, numbers - saved, loaded and applied."""
    cases = V.cases(_t(spark, sf_dir))
    path = work_path(spark, "state", "case_features")
    case_pipeline().fit(cases).save(spark, path)
    return _round_doubles(FT.FittedFeatures.load(spark, path).long_form(cases, "case_id"))
