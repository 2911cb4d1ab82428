"""Registered model and explanation queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import bundle as B
from ..operators import features as FT
from ..operators import model as MD
from ..operators import serving as SV
from ..session import work_path
from ..sources import views as V
from . import models as J
from .queries_core import _round_doubles, _t
from .registry import query


@query("m1_split")
def m1(spark, sf_dir):
    return MD.hash_split(_t(spark, sf_dir).orders, "o_orderkey").select("o_orderkey", "split")


@query("m2_gbt_fit")
def m2(spark, sf_dir):
    fm = J.trained(spark, sf_dir).model
    return spark.createDataFrame(fm.history, "iteration int, train_rmse double, validation_rmse double") \
        .withColumn("best_iteration", F.lit(fm.best_iteration))


@query("m3_predict_clipped")
def m3(spark, sf_dir):
    job = J.trained(spark, sf_dir)
    return job.model.predict(job.prepared.data).select("case_id", "split", "prediction")


@query("m4_cross_validate")
def m4(spark, sf_dir):
    p = J.trained(spark, sf_dir).prepared
    cv = MD.cross_validate(p.data, "case_id", "features", V.CASE_TARGET, {**J.QUICK_PARAMS, "maxIter": 15}, k=5)
    s = MD.cv_summary(cv).first()
    return cv.withColumn("mean_rmse", F.lit(s["mean_rmse"])).withColumn("std_rmse", F.lit(s["std_rmse"]))


@query("m5_tune")
def m5(spark, sf_dir):
    """Nested search: 12 candidates over the three searched parameters, 4 families, 3 folds."""
    p = J.trained(spark, sf_dir).prepared
    space = {"maxDepth": [3, 4], "stepSize": [0.1, 0.2], "maxIter": [5, 10, 20]}
    return MD.tune(p.data, "case_id", "features", V.CASE_TARGET, space, k=3, base=J.QUICK_PARAMS, refit=False).results


def one_split(t):
    """lineitem with three features of few values and a price label: SQL can state its best single splits."""
    li = t.lineitem.select(V.line_id().alias("id"), *[F.col(c).cast("double") for c in J.ONE_SPLIT_FEATURES],
                           X.clip(F.col("l_extendedprice") / 100000, 0.0, 1.0).alias("label"))
    return VectorAssembler(inputCols=J.ONE_SPLIT_FEATURES, outputCol="features").transform(li).select("id", "features", "label")


@query("m3_one_split")
def m3_one_split(spark, sf_dir):
    """M2 and M3 by value: one boosted tree of one split, its prediction for every row, split and leaves."""
    data = one_split(_t(spark, sf_dir))
    fm = MD.gbt_fit(data, params=J.ONE_SPLIT_PARAMS, feature_names=J.ONE_SPLIT_FEATURES)
    tree = MD.ensemble_of(fm, spark).trees[0]
    scored = fm.predict(data).select("id", "prediction")
    return _round_doubles(scored.withColumn("feature", F.lit(J.ONE_SPLIT_FEATURES[int(tree.feature[0])]))
                          .withColumn("threshold", F.lit(float(tree.threshold[0]))))


@query("m4_one_split")
def m4_one_split(spark, sf_dir):
    """M4 by value: five fits of one split, each fold's errors."""
    cv = MD.cross_validate(one_split(_t(spark, sf_dir)), "id", "features", "label", J.ONE_SPLIT_PARAMS, k=5, write_folds=True)
    return _round_doubles(cv)


@query("m5_one_split")
def m5_one_split(spark, sf_dir):
    """M5 by value: candidates of one and two trees at two step sizes, two fits a fold, scores and winner."""
    found = MD.tune(one_split(_t(spark, sf_dir)), "id", "features", "label", {"maxIter": [1, 2], "stepSize": [0.1, 0.5]},
                    k=5, base=J.ONE_SPLIT_PARAMS, refit=False, write_folds=True)
    return _round_doubles(found.results)


@query("m6_one_split")
def m6_one_split(spark, sf_dir):
    """M6 by value: permutation importance of a one-split tree; features it never splits on are exactly 0."""
    data = one_split(_t(spark, sf_dir))
    fm = MD.gbt_fit(data, params=J.ONE_SPLIT_PARAMS, feature_names=J.ONE_SPLIT_FEATURES)
    imp = MD.feature_importance(fm, spark, importance_type="permutation", data=data, key="id", label="label")
    return _round_doubles(imp.withColumn("is_zero", F.col("importance") == 0.0))


@query("m6_feature_importance")
def m6(spark, sf_dir):
    job = J.trained(spark, sf_dir)
    p = job.prepared
    gain = MD.feature_importance(job.model, spark).withColumn("type", F.lit("gain"))
    test = p.data.where(F.col("split") == "test")
    perm = MD.feature_importance(job.model, spark, importance_type="permutation", data=test, key="case_id",
                                 label=V.CASE_TARGET).withColumn("type", F.lit("permutation"))
    cat = p.features.catalog(spark).withColumnRenamed("name", "feature")
    return gain.unionByName(perm).join(F.broadcast(cat), "feature", "left")


@query("m7_model_save_load")
def m7(spark, sf_dir):
    """What a reloaded bundle says: trees, history, settings, cross-validation scores, random state."""
    job = J.trained(spark, sf_dir)
    path = work_path(spark, "models", "m7")
    MD.save_model(job.model, spark, path, {"cv_scores": {"mean_rmse": 0.5}, "best_params": job.model.params,
                                           "random_state": job.model.params["seed"]})
    back = MD.load_model(spark, path)
    return spark.createDataFrame(
        [(back.meta["model_type"], back.model.numFeatures, back.model.getNumTrees, back.best_iteration, len(back.history),
          len(back.feature_names), back.meta["cv_scores"]["mean_rmse"], back.meta["best_params"]["maxDepth"],
          back.meta["random_state"])],
        "model_type string, n_features int, n_trees int, best_iteration int, n_history int, n_names int, "
        "cv_mean_rmse double, best_depth int, random_state int")


@query("m8_reload_check")
def m8(spark, sf_dir):
    job = J.trained(spark, sf_dir)
    back = MD.load_model(spark, job.path)
    return MD.reload_check(job.model.predict(job.prepared.data), back.predict(job.prepared.data), "case_id")


@query("e1_tree_contributions")
def e1(spark, sf_dir):
    job = J.trained(spark, sf_dir)
    data = job.prepared.data
    contrib = MD.tree_contributions(data, spark, job.path, job.prepared.names, "case_id")
    raw = job.model.predict(data, clip=False).select("case_id", F.col("prediction").alias("model_prediction"))
    sums = contrib.select(
        "case_id", "expected_value", F.aggregate(F.col("contrib"), F.lit(0.0), lambda a, c: a + c["shap"]).alias("shap_sum"),
        F.size("contrib").alias("n_nonzero"))                  # summed first: the join moves numbers, not arrays
    return sums.join(raw, "case_id").select(
        "case_id", "expected_value", "model_prediction", "shap_sum", "n_nonzero",
        F.abs(F.col("expected_value") + F.col("shap_sum") - F.col("model_prediction")).alias("additivity_error"))


@query("e7_evaluate_and_explain")
def e7(spark, sf_dir):
    return J.evaluate_and_explain(spark, J.trained(spark, sf_dir))


@query("m13_train_job")
def m13(spark, sf_dir):
    return J.train_job(spark, _t(spark, sf_dir), J.QUICK_PARAMS)


@query("m12_batch_score")
def m12(spark, sf_dir):
    t = _t(spark, sf_dir)
    cases = V.cases(t)
    fitted = FT.FeaturePipeline(cat_cols=[], num_cols=list(J.LINEAR_WEIGHTS)).fit(cases)
    out = J.batch_score(cases, fitted, model_version="1.0.0", scored_at="2024-01-31T00:00:00",
                        position="case_id", explain=True)
    return _round_doubles(out)


@query("m12_model_batch")
def m12_model(spark, sf_dir):
    """The batch scored and explained by the trained model: what a row must satisfy whatever the fit, per case."""
    out = J.batch_score(V.cases(_t(spark, sf_dir)), state=J.trained(spark, sf_dir).state, position="case_id", explain=True)
    return out.select("case_id", "gid", "status", "reasons",
                      F.coalesce((F.col("prediction") >= 0) & (F.col("prediction") <= 1), F.lit(True)).alias("in_range"),
                      F.when(F.col("status") == "scored", F.col("explanation_summary").contains("confidence)"))
                      .alias("explained"),
                      F.when(F.col("status") == "scored", F.col("explanation_summary").startswith("Score: ")).alias("labelled"))


@query("m12_one_split")
def m12_one_split(spark, sf_dir):
    """M12 by value: cases scored and explained by a served one-split model; null and repeated ids stay as they are."""
    cases = V.cases(_t(spark, sf_dir), with_target=True)
    fitted = FT.FeaturePipeline(num_cols=J.ONE_SPLIT_CASES).fit(cases)
    data = fitted.transform(cases.withColumn("__y", F.col(V.CASE_TARGET))).select("features", F.col("__y").alias("label"))
    fm = MD.gbt_fit(data, params=J.ONE_SPLIT_PARAMS, feature_names=J.ONE_SPLIT_CASES)
    state = SV.publish(spark, work_path(spark, "models", "m12"), fm, fitted, 1)
    asked = cases.unionByName(cases.where("case_id % 10 = 0")).unionByName(
        cases.where("case_id % 10 = 1").withColumn("case_id", F.lit(None).cast("long")))
    out = J.batch_score(asked, state=state, scored_at="2024-01-31T00:00:00", position="case_id", explain=True)
    return _round_doubles(out)


@query("m3_predict_checks")
def m3_checks(spark, sf_dir):
    """M3's real predictions, reduced to what holds for any fit: every case once, its split, its range."""
    job = J.trained(spark, sf_dir)
    return job.model.predict(job.prepared.data).groupBy("case_id", "split").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and((F.col("prediction") >= 0) & (F.col("prediction") <= 1)).alias("in_range"))


@query("m4_fold_checks")
def m4_checks(spark, sf_dir):
    """The folds of M4: every case is held out in exactly one of them (m4_one_split checks their fits)."""
    p = J.trained(spark, sf_dir).prepared
    return MD.hash_folds(p.data, "case_id", 5).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("case_id").alias("sum_case_id"))


@query("e1_additivity")
def e1_checks(spark, sf_dir):
    """E1's real contributions: per case they add up to the raw prediction."""
    return e1(spark, sf_dir).select("case_id", (F.col("additivity_error") < 1e-6).alias("adds_up"))


@query("m9_bundle_check")
def m9(spark, sf_dir):
    t = _t(spark, sf_dir)
    docs = t.documents.select("doc_id", "text")
    meta = FT.tfidf_fit(docs.where(X.hash_mod("doc_id", 100) < 50), "text").to_df(spark)
    state = FT.tfidf_fit(docs, "text").to_df(spark)
    return MD.bundle_check(meta, state, "term")


@query("m10_run_log")
def m10(spark, sf_dir):
    t = _t(spark, sf_dir)
    started = t.lineitem.groupBy(F.concat(F.lit("run_"), "l_returnflag").alias("run_id")).agg(
        F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("started_at"))
    scored = t.lineitem.select(F.concat(F.lit("run_"), "l_returnflag").alias("run_id"),
                               (F.col("l_tax") * 10).alias("y"), X.clip(F.col("l_discount") * 8, 0.0, 1.0).alias("p"))
    runs = MD.grouped_metrics(scored, "run_id", "y", "p").join(started, "run_id")
    path = work_path(spark, "tables", "run_log")
    MD.run_log_rows(runs, "run_id", {"model": "linear", "started_at": F.col("started_at")}, ["rmse", "mae", "r2"]).write.mode("append").parquet(path)
    log = spark.read.parquet(path)
    ranked = MD.best_runs(log, "rmse")
    wide = log.where(F.col("kind") == "metric").groupBy("run_id").pivot("key", ["mae", "r2"]).agg(F.first("value"))
    newest = MD.latest_run(log).select("run_id", F.lit(True).alias("is_latest"))
    return _round_doubles(ranked.join(wide, "run_id").join(newest, "run_id", "left").na.fill(False, ["is_latest"]))


@query("m11_model_info")
def m11(spark, sf_dir):
    """From a saved bundle; the number of trees follows the fit and is left to M2."""
    return MD.model_info(spark, J.trained(spark, sf_dir).path).select(
        "model_type", "model_version", "n_features", "first_features", "params",
        (F.col("best_iteration") < F.col("n_history")).alias("best_in_history"), "is_fitted")


@query("e2_sampled_contributions")
def e2(spark, sf_dir):
    """Kernel contributions of a linear scorer on lineitem (6 features: all 62 coalitions, 100 background rows)."""
    from ..operators.sampling_shap import LinearScore, sampled_contributions
    t = _t(spark, sf_dir)
    li = t.lineitem.withColumn("id", V.line_id())
    fitted = FT.FeaturePipeline(cat_cols=V.LINE_CATEGORICAL, num_cols=V.LINE_NUMERIC).fit(li)
    feats = fitted.transform(li).select("id", "features")
    # fixed values: the linear scorer of the check
    w = [0.0, 0.0, 0.02, 0.05, -0.04, 0.01]
    return _round_doubles(sampled_contributions(feats, "id", "features", LinearScore(0.5, w), fitted.feature_names(),
                                                background=100))


@query("e2_tree_contributions")
def e2_tree(spark, sf_dir):
    """Kernel contributions of a fitted tree (one split, three features): the whole difference is the split feature's."""
    from ..operators.sampling_shap import sampled_contributions
    data = one_split(_t(spark, sf_dir))
    fm = MD.gbt_fit(data, params=J.ONE_SPLIT_PARAMS, feature_names=J.ONE_SPLIT_FEATURES)
    model = MD.ensemble_of(fm, spark)
    return _round_doubles(sampled_contributions(data, "id", "features", model, J.ONE_SPLIT_FEATURES))


@query("m9_bundle_parts")
def m9_parts(spark, sf_dir):
    """A published bundle against its manifest: as it is, and a copy with a missing, a changed and an older part."""
    fitted, fm = J.fit_lines(_t(spark, sf_dir).lineitem)
    root = work_path(spark, "models", "m9")
    SV.publish(spark, root, fm, fitted, 1)
    sound, spoilt = f"{root}/versions/1", f"{root}/spoilt"
    B.copy_bundle(spark, sound, spoilt, leave_out=["features/num_stats"], cut=["model/data"], versions={"pyspark": "0.0"})
    name = lambda df, n: df.withColumn("bundle", F.lit(n))
    return name(B.check_parts(spark, sound), "sound").unionByName(name(B.check_parts(spark, spoilt), "spoilt"))
