"""Intent of the reference's own tests: fit/transform shapes, train/test
consistency, predictions within [0, 1], and scoring that echoes ids."""

from pyspark.sql import functions as F

from scoreforge.operators import model as MD
from scoreforge.plans import models as J
from scoreforge.sources import views as V
from scoreforge.sources.tables import Tables

from conftest import SF001


def test_fit_transform_shapes_and_consistency(spark):
    p = J.prepare_cases(Tables(spark, SF001))
    n = p.data.count()
    assert n == V.cases(Tables(spark, SF001)).count()
    sizes = {r["features"].size for r in p.data.select("features").collect()}
    assert sizes == {len(p.names)}  # train and test rows share one feature layout
    assert p.names[-13:] == V.CASE_NUMERIC and p.names[-18:-13] == V.CASE_CATEGORICAL
    p.data.unpersist()


def test_train_and_predict_range(spark, tmp_path):
    p = J.prepare_cases(Tables(spark, SF001))
    fm = J.fit_model(p, {"maxIter": 5, "maxDepth": 3, "maxBins": 16, "seed": 42}, early=None)
    pred = fm.predict(p.data)
    lo, hi, cnt = pred.agg(F.min("prediction"), F.max("prediction"), F.count("prediction")).first()
    assert cnt == p.data.count() and 0.0 <= lo <= hi <= 1.0
    path = str(tmp_path / "bundle")
    MD.save_model(fm, spark, path)
    back = MD.load_model(spark, path)
    assert MD.reload_check(pred, back.predict(p.data), "case_id").first()["ok"]
    p.data.unpersist()


def test_batch_score_echoes_ids_and_rejects_invalid(spark):
    from scoreforge.operators import features as FT
    cases = V.cases(Tables(spark, SF001))
    bad = cases.withColumn("credit_score", F.when(F.col("case_id") % 7 == 0, F.lit(100)).otherwise(F.col("credit_score")))
    fitted = FT.FeaturePipeline(num_cols=list(J.LINEAR_WEIGHTS)).fit(cases)
    out = J.batch_score(bad, fitted, scored_at="2024-01-31T00:00:00", position="case_id").collect()
    assert len(out) == cases.count()
    for r in out:
        if r["case_id"] % 7 == 0:
            assert r["status"] == "rejected" and "credit_score:ge" in r["reasons"] and r["prediction"] is None
        else:
            assert r["status"] == "scored" and 0.0 <= r["prediction"] <= 1.0
        assert r["gid"] == (f"C{r['case_id']}" if r["case_id"] % 10 else f"batch_{r['case_id']}")


def test_any_number_of_categories_as_a_table(spark, tmp_path):
    from scoreforge.operators import features as FT
    df = spark.createDataFrame([(f"v{i % 700:03d}" if i % 7 else None, float(i)) for i in range(3000)], "c string, x double")
    want = sorted({f"v{i % 700:03d}" if i % 7 else "Unknown" for i in range(3000)})
    fitted = FT.FeaturePipeline(cat_cols=["c"], num_cols=["x"]).fit(df)
    assert {(r["value"], r["code"]) for r in fitted.labels.table.collect()} == set(zip(want, range(len(want))))
    fitted.save(spark, str(tmp_path / "state"))
    back = FT.FittedFeatures.load(spark, str(tmp_path / "state"))
    new = spark.createDataFrame([("v001", 1.0), ("never seen", 2.0), (None, 3.0), ("v699", None)], "c string, x double")
    unknown = want.index("Unknown")
    codes = [want.index("v001"), unknown, unknown, want.index("v699")]
    for labels in (fitted.labels, back.labels):
        assert [r["c"] for r in FT.label_transform(new, labels).collect()] == codes
    assert [r["features"].toArray()[0] for r in back.transform(new).collect()] == codes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # a dictionary too large to send around
    try:
        assert sorted(r["c"] for r in FT.label_transform(new, fitted.labels).collect()) == sorted(codes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    without = FT.label_fit(spark.createDataFrame([("b",), ("a",)], "c string"), ["c"])
    assert [r["c"] for r in FT.label_transform(new, without).collect()] == [2, 2, 2, 2]
    empty = FT.label_fit(df.where("false"), ["c"])
    assert empty.sizes == {"c": (0, 0)} and FT.label_transform(new, empty).count() == 4


def test_hash_split_is_stable_under_repartitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in MD.hash_split(df.repartition(1), "k", 20, 10).collect()}
    b = {r["k"]: r["split"] for r in MD.hash_split(df.repartition(13), "k", 20, 10).collect()}
    assert a == b
    share = sum(v == "train" for v in a.values()) / len(a)
    assert 0.65 < share < 0.75


def test_batch_keeps_null_and_repeated_ids(spark, tmp_path):
    from scoreforge.operators import features as FT
    from scoreforge.operators import serving as SV
    cases = V.cases(Tables(spark, SF001), with_target=True)
    fitted = FT.FeaturePipeline(num_cols=J.ONE_SPLIT_CASES).fit(cases)
    data = fitted.transform(cases).select("features", F.col(V.CASE_TARGET).alias("label"))
    fm = MD.gbt_fit(data, params={"maxIter": 5, "maxDepth": 3, "maxBins": 16, "seed": 42}, feature_names=J.ONE_SPLIT_CASES)
    state = SV.publish(spark, str(tmp_path / "served"), fm, fitted, 1)
    one = cases.limit(1)
    asked = cases.unionByName(one).unionByName(one).unionByName(one.withColumn("case_id", F.lit(None).cast("long")))
    out = J.batch_score(asked, state=state, explain=True, scored_at="x").collect()
    assert len(out) == cases.count() + 3
    raw = {r["case_id"]: r["p"] for r in fm.predict(fitted.transform(cases)).select("case_id", F.col("prediction").alias("p")).collect()}
    for r in out:
        if r["case_id"] is not None and r["status"] == "scored":
            assert abs(r["prediction"] - raw[r["case_id"]]) <= 5.1e-5 and "confidence)" in r["explanation_summary"]


def test_a_running_server_takes_the_newest_version(spark, tmp_path):
    from scoreforge.operators import serving as SV
    from scoreforge.streaming import streams as S
    lines = Tables(spark, SF001).lineitem
    fitted, fm = J.fit_lines(lines)
    root = str(tmp_path / "served")
    SV.publish(spark, root, fm, fitted, 1)
    server = SV.Server(spark, root)
    first = server.current()
    assert first.version == 1 and server.current() is first
    src = str(tmp_path / "in")
    rows = lines.select("l_orderkey", *J.ONE_SPLIT_FEATURES)

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(src)
        S.run_scores(stream, server, ["l_orderkey"], str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        return {r["model_version"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("model_version").agg(
            F.count("*").alias("n")).collect()}

    rows.limit(50).write.parquet(src)
    assert run() == {1: 50}
    SV.publish(spark, root, fm, fitted, 2)
    rows.limit(30).write.mode("append").parquet(src)
    assert run() == {1: 50, 2: 30}


def test_early_stopping_equals_one_long_fit():
    assert MD.stopping_point([5, 4, 3, 3.5, 3.4, 3.3], 3) == (2, True)
    assert MD.stopping_point([5, 4, 3, 3.5, 3.4], 3) == (2, False)
    assert MD.stopping_point([3, 2, 1], None) == (2, False) and MD.stopping_point([1.0], 1) == (0, False)


def test_rounds_keep_the_trees_of_one_fit(spark):
    p = J.prepare_cases(Tables(spark, SF001))
    train, held = p.data.where("split = 'train'"), p.data.where("split = 'validation'")
    params = {"maxIter": 30, "maxDepth": 2, "maxBins": 16, "stepSize": 0.5, "seed": 42}
    fm = MD.gbt_fit(train, label=V.CASE_TARGET, params=params, validation=held, early_stopping_rounds=2)
    whole = MD.gbt_fit(train, label=V.CASE_TARGET, params=params)
    errors = whole.model.evaluateEachIteration(held, "squared")
    assert fm.best_iteration == MD.stopping_point(errors, 2)[0] and fm.model.getNumTrees == fm.best_iteration + 1
    a = fm.predict(held, clip=False).select("case_id", "prediction").collect()
    b = MD.FittedModel(MD.first_trees(whole.model, fm.best_iteration + 1), {}).predict(held, clip=False).select(
        "case_id", "prediction").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_permuted_features_match_a_plain_permutation(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"id": range(300), "a": rng.normal(size=300), "b": rng.integers(0, 3, 300).astype(float),
                          "c": rng.normal(size=300)})
    frame["y"] = frame["a"] * frame["b"]
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(frame))
    fm = MD.gbt_fit(df, label="y", params={"maxIter": 4, "maxDepth": 3, "maxBins": 16, "seed": 42}, feature_names=["a", "b", "c"])
    import hashlib
    order = sorted(range(300), key=lambda i: (int(hashlib.md5(f"{i}-42".encode()).hexdigest()[:8], 16), i))
    x, y = frame[["a", "b", "c"]].to_numpy(), frame["y"].to_numpy()
    partner = np.empty(300, int)
    partner[order] = order[1:] + order[:1]
    model = MD.ensemble_of(fm, spark)
    rmse = lambda m: float(np.sqrt(np.mean((model.predict(m) - y) ** 2)))
    for buckets in (1, 3, 40):
        got = {r["feature"]: r["importance"] for r in MD.permutation_importance(
            fm, df, "id", "y", ["a", "b", "c"], buckets=buckets).collect()}
        for j, name in enumerate("abc"):
            mixed = x.copy()
            mixed[:, j] = x[partner, j]
            assert abs(got[name] - (rmse(mixed) - rmse(x))) < 1e-9
            if j not in model.trees_of:
                assert got[name] == 0.0
