"""Composite model jobs: the case training set, the train job (M13), batch
scoring (M12) and evaluation with explanations (E7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import explain as E
from ..operators import features as FT
from ..operators import metrics as M
from ..operators import model as MD
from ..operators import quality as Q
from ..operators import serving as SV
from ..operators.ranking import rank_features
from ..session import work_path, written
from ..sources import io as IO
from ..sources import views as V
from ..sources.tables import Tables

# settings of the registered checks; production callers pass their own
QUICK_PARAMS = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "maxBins": 32, "seed": 42}
TRAIN_PARAMS = {"maxIter": 40, "maxDepth": 6, "stepSize": 0.1, "maxBins": 64, "seed": 42}
ONE_SPLIT_PARAMS = {"maxIter": 1, "maxDepth": 1, "maxBins": 128, "stepSize": 0.1, "seed": 42}
ONE_SPLIT_FEATURES = ["l_quantity", "l_discount", "l_tax"]
ONE_SPLIT_CASES = ["debt_to_equity_ratio", "liquidity_ratio", "audit_score", "regulatory_violations"]


def case_pipeline() -> FT.FeaturePipeline:
    return FT.FeaturePipeline(text_col=V.CASE_TEXT, cat_cols=V.CASE_CATEGORICAL, num_cols=V.CASE_NUMERIC)


@dataclass
class Prepared:
    data: DataFrame            # case_id, split, features, case_score
    features: FT.FittedFeatures
    names: list


def prepare_cases(t: Tables, val_pct: int = 10, test_pct: int = 20, cases: DataFrame | None = None) -> Prepared:
    """Cases with the composite score as target, split by key hash first,
    features fitted on the training side only (no leak), then applied to all.
    The result is a written table: iterative fits and explanations read it many times."""
    cases = MD.hash_split(cases if cases is not None else V.cases(t, with_target=True), "case_id", test_pct, val_pct)
    fitted = case_pipeline().fit(cases.where(F.col("split") == "train"))
    data = written(fitted.transform(cases).select("case_id", "split", "features", V.CASE_TARGET), "prepared-cases", "case_id")
    return Prepared(data, fitted, fitted.feature_names())


def fit_model(p: Prepared, params: dict | None = None, early: int | None = 10) -> MD.FittedModel:
    d = p.data
    return MD.gbt_fit(MD.in_few_tasks(d.where(F.col("split") == "train")), "features", V.CASE_TARGET, params or TRAIN_PARAMS,
                      validation=d.where(F.col("split") == "validation"), early_stopping_rounds=early,
                      feature_names=p.names)


@dataclass
class Trained:
    prepared: Prepared
    model: MD.FittedModel
    state: SV.Served
    path: str


_TRAINED: dict[tuple, Trained] = {}


def trained(spark: SparkSession, sf_dir: str) -> Trained:
    """The case model of a folder of tables, trained and published once per session: train once, read often."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        p = prepare_cases(Tables(spark, sf_dir))
        fm = fit_model(p)
        root = work_path(spark, "models", "cases")
        state = SV.publish(spark, root, fm, p.features, 1)
        _TRAINED[key] = Trained(p, fm, state, f"{root}/versions/1")
    return _TRAINED[key]


def fit_lines(lines: DataFrame) -> tuple[FT.FittedFeatures, MD.FittedModel]:
    """The line model: three numeric features, one split; its price label is a number SQL can average."""
    fitted = FT.FeaturePipeline(cat_cols=[], num_cols=ONE_SPLIT_FEATURES).fit(lines)
    label = X.clip(F.col("l_extendedprice") / 100000, 0.0, 1.0)
    data = fitted.transform(lines.withColumn("__y", label)).select("features", F.col("__y").alias("label"))
    return fitted, MD.gbt_fit(data, params=ONE_SPLIT_PARAMS, feature_names=ONE_SPLIT_FEATURES)


def train_from_log(spark: SparkSession, log: DataFrame, runs: str, run_id: str, params: dict | None = None,
                   folds: int = 3, root: str | None = None) -> DataFrame:
    """Cases from the labelled log table (its payload and target) -> features -> fit with validation -> test
    metrics -> cross-validation -> importance -> save -> reload check -> explanations of the test rows -> run log.
    Returns a (metric, value) table."""
    schema = IO.case_schema().add("case_id", "long")
    rows = log.select("payload_json", F.col("target").alias(V.CASE_TARGET)).where(F.col("target").isNotNull())
    p = prepare_cases(None, cases=IO.flatten_payload(rows, "payload_json", schema))
    fm = fit_model(p, params)
    test = p.data.where(F.col("split") == "test")
    scored = written(fm.predict(test), "train-scored", "case_id")
    metrics = M.regression_metrics(scored, V.CASE_TARGET, "prediction").first().asDict()
    cv = MD.cross_validate(p.data.where(F.col("split") != "test"), "case_id", "features", V.CASE_TARGET,
                           {**fm.params, "maxIter": fm.model.getNumTrees}, folds)
    cv_rows = cv.collect()
    imp = MD.feature_importance(fm, spark)
    top = rank_features(imp, "importance", "feature", 10).collect()
    root = root or work_path(spark, "models", "train")
    fm.meta.update({"cv_scores": {"folds": [r["rmse"] for r in cv_rows], "mean_rmse": sum(r["rmse"] for r in cv_rows) / folds},
                    "best_params": {**fm.params, "maxIter": fm.model.getNumTrees}, "random_state": fm.params["seed"]})
    state = SV.publish(spark, root, fm, p.features, 1)
    path = f"{root}/versions/1"
    loaded = MD.load_model(spark, path)
    check = MD.reload_check(scored, loaded.predict(test), "case_id").first()
    contrib = scored.select("case_id", SV.contribution_column(spark, state.nodes, state.weights, p.names,
                                                              F.col("features")).alias("contrib"))
    shap = M.global_importance(contrib.select(F.inline("contrib")))
    explained = rank_features(shap, n=10).collect()
    rows = [(f"test_{k}", float(v)) for k, v in metrics.items() if v is not None]
    rows += [("best_iteration", float(fm.best_iteration or 0)), ("n_features", float(len(p.names))),
             ("n_cases", float(p.data.count())), ("cv_mean_rmse", float(loaded.meta["cv_scores"]["mean_rmse"])),
             ("reload_max_abs_diff", float(check["max_abs_diff"])), ("reload_ok", 1.0 if check["ok"] else 0.0)]
    logged = spark.createDataFrame([(run_id, *[float(v) for _, v in rows])], ["run_id", *[k for k, _ in rows]])
    MD.run_log_rows(logged, "run_id", {k: str(v) for k, v in sorted(fm.params.items())}, [k for k, _ in rows]).write.mode(
        "append").parquet(runs)
    rows += [(f"importance_rank_{r['rank']}:{r['feature']}", float(r["importance"])) for r in top]
    rows += [(f"explained_rank_{r['rank']}:{r['feature']}", float(r["mean_abs_shap"])) for r in explained]
    return spark.createDataFrame(rows, "metric string, value double")


def train_job(spark: SparkSession, t: Tables, params: dict | None = None, out: str | None = None) -> DataFrame:
    """M13 as the reference runs it: the labelled cases are appended to the log table first (S3), then read from it."""
    out = out or work_path(spark, "train-job")
    cases = V.cases(t, with_target=True)
    IO.append_cases(cases, f"{out}/train_data", ["case_id", *IO.case_schema().names], gid="gid", target=V.CASE_TARGET,
                    created_at="2024-01-31T00:00:00")
    return train_from_log(spark, IO.read_cases(spark, f"{out}/train_data"), f"{out}/runs", "run-1", params, root=f"{out}/model")


# fixed values: the linear scorer of the batch-scoring check (standardised inputs)
LINEAR_WEIGHTS = {"credit_score": 0.05, "debt_to_equity_ratio": -0.03, "liquidity_ratio": 0.02, "audit_score": 0.02}
LINEAR_INTERCEPT = 0.5


def batch_score(cases: DataFrame, fitted: FT.FittedFeatures | None = None, *, state: SV.Served | None = None,
                model_version: str = "1.0.0", scored_at: str | None = None, position: str | None = None,
                explain: bool = False) -> DataFrame:
    """Validate, build features, predict, tier, round, default ids, stamp; rejected rows keep their reasons.
    The scorer is the served model ``state``, or the linear one on ``fitted``.
    One narrow plan over all rows (the state is literals, broadcast maps and trees): every case comes out
    once, whatever its id.

    ``explain`` adds ``explanation_summary`` (E4) and the strongest
    ``contributions`` (W3) of every scored row: Tree SHAP of the served model, or the linear scorer's own terms."""
    flagged = Q.with_violations(cases, Q.case_constraints(), "reasons")
    if state is not None:
        feats = SV.scored(flagged, state, "prediction", "contrib" if explain else None)
    else:
        feats = fitted.transform_columns(flagged)
        lin = X.sum_columns([F.lit(w) * F.col(c) for c, w in LINEAR_WEIGHTS.items()])
        feats = feats.withColumn("prediction", X.clip(F.lit(LINEAR_INTERCEPT) + lin, 0.0, 1.0))
        if explain:
            feats = feats.withColumn("contrib", F.array(*[
                F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), (F.lit(w) * F.col(c)).alias("shap"))
                for c, w in LINEAR_WEIGHTS.items()]))
    ok = F.size("reasons") == 0
    shown = [F.when(ok, E.explanation_text(F.col("prediction"), F.col("contrib"))).alias("explanation_summary"),
             F.when(ok, E.contrib_text(E.contribution_list(F.col("contrib")))).alias("contributions")] if explain else []
    stamp = F.lit(scored_at) if scored_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    out = feats.select(
        "case_id",
        X.default_id("gid", position).alias("gid"),
        F.when(ok, "scored").otherwise("rejected").alias("status"),
        F.when(ok, X.round_score("prediction", 4)).alias("prediction"),
        F.when(ok, X.tier("prediction")).alias("confidence"),
        F.array_join("reasons", ",").alias("reasons"),
        F.lit(model_version).alias("model_version"), stamp.alias("scored_at"), *shown)
    return out


def batch_summary(scored: DataFrame, seconds: float) -> DataFrame:
    """M12's totals: all cases, scored and rejected ones, mean score, elapsed seconds."""
    return scored.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if(F.col("status") == "scored").alias("n_scored"),
                      F.count_if(F.col("status") == "rejected").alias("n_rejected"),
                      F.avg("prediction").alias("mean_prediction")).withColumn("seconds", F.lit(float(seconds)))


def evaluate_and_explain(spark: SparkSession, job: Trained) -> DataFrame:
    """Metrics, tolerance bands, tree contributions, global importance and
    the top 10, over one written scored table; long (section, name, value)."""
    test = job.prepared.data.where(F.col("split") == "test")
    scored = written(job.model.predict(test), "evaluated", "case_id")
    m = M.regression_metrics(scored, V.CASE_TARGET, "prediction").first().asDict()
    bands = M.tolerance_bands(scored, V.CASE_TARGET, "prediction").first().asDict()
    contrib = scored.select(SV.contribution_column(spark, job.state.nodes, job.state.weights, job.prepared.names,
                                                   F.col("features")).alias("contrib"))
    imp = M.global_importance(contrib.select(F.inline("contrib")))
    top = rank_features(imp, n=10).collect()
    rows = [("metric", k, float(v)) for k, v in m.items() if v is not None]
    rows += [("tolerance", k, float(v)) for k, v in bands.items()]
    rows += [("top_feature", f"{r['rank']}:{r['feature']}", float(r["mean_abs_shap"])) for r in top]
    return spark.createDataFrame(rows, "section string, name string, value double")
