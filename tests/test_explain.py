from pyspark.sql import functions as F

from scoreforge.operators import explain as E

SCHEMA = "id string, contrib array<struct<feature:string,value:double,shap:double>>, prediction double"


def _rows(spark):
    data = [
        ("a", [("f1", 1.0, 0.3), ("f2", 2.0, -0.1), ("f3", 0.0, 0.0), ("f4", 1.0, 0.3), ("f5", 1.0, 0.05),
               ("f6", 1.0, 0.2)], 0.742),
        ("b", [("f1", 1.0, -0.2), ("f2", 1.0, -0.2), ("f3", 1.0, -0.5)], 0.4),
        ("c", [("f1", 0.0, 0.0)], 0.7),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_topk_signed_ties_zero_and_all_negative(spark):
    rows = E.topk_signed(_rows(spark)).collect()
    a_pos = [(r["rank"], r["feature"]) for r in rows if r["id"] == "a" and r["sign"] == "positive"]
    assert a_pos == [(1, "f1"), (2, "f4"), (3, "f6")]  # tie 0.3 broken by name
    assert not [r for r in rows if r["feature"] == "f3" and r["id"] == "a"]  # zero is in neither
    b = [(r["sign"], r["feature"]) for r in rows if r["id"] == "b"]
    assert b == [("negative", "f3"), ("negative", "f1"), ("negative", "f2")]
    assert not [r for r in rows if r["id"] == "c"]


def test_explanation_text_parts(spark):
    got = {r["id"]: r["t"] for r in _rows(spark).select(
        "id", E.explanation_text(F.col("prediction"), F.col("contrib")).alias("t")).collect()}
    assert got["a"] == "Score: 0.742 (High confidence); Main positive factors: f1, f4; Main risk factors: f2"
    assert got["b"] == "Score: 0.400 (Low confidence); Main risk factors: f3, f1"
    assert got["c"] == "Score: 0.700 (Medium confidence)"


def test_record_and_list(spark):
    rec = E.explanation_record(_rows(spark).withColumn("expected_value", F.lit(0.5))).collect()
    a = [r for r in rec if r["instance_id"] == "a"][0]
    assert [c["feature"] for c in a["feature_contributions"]] == ["f1", "f4", "f6", "f2"]
    assert len(a["top_positive_features"]) == 3


def test_align_names(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], [1.0])], "s array<double>, v array<double>")
    got = df.select(E.align_names(F.col("s"), F.col("v"), ["a", "b"]).alias("x")).first()["x"]
    assert [g["feature"] for g in got] == ["feature_0", "feature_1", "feature_2"]
    assert [g["value"] for g in got] == [1.0, 0.0, 0.0]
    got = df.select(E.align_names(F.col("s"), F.col("v"), ["a", "b", "c"]).alias("x")).first()["x"]
    assert [g["feature"] for g in got] == ["a", "b", "c"]
