import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scoreforge.functions.text import tokenize
from scoreforge.operators import features as FT


def test_tokenizer_folds_accents_and_removes_stop_words(spark):
    df = spark.createDataFrame([(1, "Héllo the Wörld, naïve café x"), (2, None), (3, "")], "id long, text string")
    rows = {r["id"]: r["terms"] for r in tokenize(df, "text").collect()}
    assert rows[1] == ["hello", "world", "naive", "cafe", "hello world", "world naive", "naive cafe"]
    assert rows[2] == [] and rows[3] == []


def _docs(spark):
    texts = ["red apple pie", "green apple tart", "red apple", "blue sky", "", None, "apple apple red sky"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tfidf_fit_thresholds_and_order(spark):
    v = FT.tfidf_fit(_docs(spark), "text", max_features=3, min_df=2, max_df=0.95)
    # df >= 2: apple(4), red(3), sky(2), red apple(2); most frequent 3: apple, red, then sky/red apple tie by term
    assert v.terms == sorted(v.terms)
    assert set(v.terms) == {"apple", "red", "red apple"}
    n = v.n_docs
    assert v.idf[v.terms.index("apple")] == pytest.approx(math.log((1 + n) / (1 + 4)) + 1)


def test_tfidf_transform_l2_and_empty_docs(spark):
    docs = _docs(spark)
    v = FT.tfidf_fit(docs, "text", max_features=10)
    out = FT.tfidf_transform(tokenize(docs, "text"), v).select("doc_id", vector_to_array("tfidf").alias("w"))
    for r in out.collect():
        norm = float(np.linalg.norm(r["w"]))
        assert norm == pytest.approx(1.0) or norm == 0.0
    empty = {r["doc_id"] for r in out.collect() if not any(r["w"])}
    assert {4, 5}.issubset(empty)


def test_label_transform_unseen_and_unknown(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    labels = FT.label_fit(fit, ["c"])
    assert [(r["value"], r["code"]) for r in labels.table.orderBy("code").collect()] == [("Unknown", 0), ("a", 1), ("b", 2)]
    assert labels.sizes == {"c": (3, 0)}
    new = spark.createDataFrame([("a",), ("zz",), (None,), ("b",)], "c string")
    assert [r[0] for r in FT.label_transform(new, labels).collect()] == [1, 0, 0, 2]
    # no 'Unknown' at fit: unseen and null get n
    labels2 = FT.label_fit(spark.createDataFrame([("b",), ("a",)], "c string"), ["c"])
    assert [r[0] for r in FT.label_transform(new, labels2).collect()] == [0, 2, 2, 1]


def test_standardize_zero_variance_and_single_row_batch(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (100.0, 5.0)], "a double, b double")
    st = FT.numeric_fit(df, ["a", "b"])
    assert st.std["b"] == 1.0
    one = spark.createDataFrame([(1000.0, 5.0)], "a double, b double")
    capped = FT.iqr_cap(one, st.bounds).first()
    assert capped["a"] == st.bounds["a"][3]  # fitted fences cap a single-row batch
    batch = FT.iqr_cap(one, FT.iqr_bounds(one, ["a"])).first()
    assert batch["a"] == 1000.0  # a single row is its own fence in batch mode


def test_pipeline_errors_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 3} common text", "x" if i % 2 else "y", float(i)) for i in range(20)],
                               "id long, t string, c string, n double")
    pipe = FT.FeaturePipeline(text_col="t", cat_cols=["c"], num_cols=["n"])
    with pytest.raises(ValueError):
        pipe.transform(df)
    with pytest.raises(ValueError):
        FT.FeaturePipeline(num_cols=["missing"]).fit(df)
    with pytest.raises(ValueError):
        FT.FeaturePipeline(num_cols=["n"], scaler="minmax").fit(df)
    fitted = pipe.fit(df)
    path = str(tmp_path / "state")
    fitted.save(spark, path)
    loaded = FT.FittedFeatures.load(spark, path)
    a = sorted(tuple(r) for r in fitted.long_form(df, "id").collect())
    b = sorted(tuple(r) for r in loaded.long_form(df, "id").collect())
    assert a == b
    # result does not depend on partitioning
    c = sorted(tuple(r) for r in fitted.long_form(df.repartition(7), "id").collect())
    assert a == c
    assert fitted.feature_names()[-2:] == ["c", "n"]


def test_nan_spoils_no_aggregate(spark):
    from scoreforge.operators.profile import numeric_profile, outlier_report, target_profile
    from scoreforge.operators.quality import Range, violations
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, nan), (4.0, 2.0), (nan, nan)], "x double, y double")
    state = FT.numeric_fit(df, ["x"], cap=False)
    assert state.mean["x"] == 2.5 and state.std["x"] == pytest.approx(np.std([1, 2, 3, 4]))
    out = [r["x"] for r in FT.standardize(df, state).collect()]
    assert sum(math.isnan(v) for v in out) == 1
    row, = numeric_profile(df, ["x"]).collect()
    assert (row["mean"], row["min"], row["max"]) == (2.5, 1.0, 4.0)
    assert target_profile(df, "x").first()["mean"] == 2.5 and target_profile(df, "x").first()["count"] == 4
    assert outlier_report(df, ["x"]).first()["n_outliers"] == 0
    bad = df.select(violations([Range("x", ge=0.0)]).alias("v")).collect()
    assert [r["v"] for r in bad] == [[], [], [], [], ["x:ge"]]
    empty = FT.numeric_fit(df.select(F.lit(nan).alias("z")), ["z"])
    assert empty.mean["z"] == 0.0 and empty.std["z"] == 1.0


def test_an_empty_vocabulary_gives_zero_vectors(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    v = FT.tfidf_fit(docs, "text", min_df=2)
    assert v.terms == [] and v.n_docs == 2
    out = FT.tfidf_transform(tokenize(docs, "text"), v).select(vector_to_array("tfidf").alias("w")).collect()
    assert all(len(r["w"]) == 0 for r in out)


def test_an_empty_vocabulary_passes_the_whole_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two", 1.0), (2, None, 3.0)], "doc_id long, text string, x double")
    for num in (["x"], []):
        fitted = FT.FeaturePipeline(text_col="text", num_cols=num, min_df=2).fit(docs)
        fitted.save(spark, str(tmp_path / f"state{len(num)}"))
        for state in (fitted, FT.FittedFeatures.load(spark, str(tmp_path / f"state{len(num)}"))):
            sizes = {r["features"].size for r in state.transform(docs).collect()}
            assert sizes == {len(state.feature_names())} == {len(num)}
            assert state.long_form(docs, "doc_id").count() == 2 * len(num)


def test_accents_of_all_scripts_are_folded(spark):
    df = spark.createDataFrame([(1, "việt re\u0301sume\u0301 ＡＢＣ ά")], "id long, text string")
    assert tokenize(df, "text", ngram=False).first()["terms"] == ["viet", "resume", "abc"]
