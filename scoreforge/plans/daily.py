"""The daily monitoring job as one composition of operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import drift as D
from ..operators.serving import Server, publish
from ..operators.serving import scored as model_scored
from ..session import work_exists, work_path, written
from ..sources import io as IO
from ..sources import views as V
from ..sources.tables import Tables
from .models import fit_lines

#: Per-column entry of the JSON summary; the tests that do not apply to a column are null.
TESTS_SCHEMA = ("struct<ks: struct<statistic: double, p_value: double>, wasserstein_norm: double, "
                "chisquare: struct<statistic: double, p_value: double>, jensenshannon: double, psi: double>")


def drift_summary(num: DataFrame, cat: DataFrame) -> DataFrame:
    """Nested per-column summary for the JSON sink (S12), every test under its own name."""
    none = F.lit(None).cast("double")
    pair = lambda a, b: F.struct(a.alias("statistic"), b.alias("p_value"))

    def entry(df, ks, wasserstein, chisquare, jensenshannon):
        tests = F.struct(ks.alias("ks"), wasserstein.alias("wasserstein_norm"), chisquare.alias("chisquare"),
                         jensenshannon.alias("jensenshannon"), F.col("psi").alias("psi")).alias("tests")
        return df.select("column", "n_ref", "n_cur", tests, "stattest", "drift_score", "drifted")

    n = entry(num, pair(F.col("ks_statistic"), F.col("ks_p_value")), F.col("wasserstein_norm"), pair(none, none), none)
    c = entry(cat, pair(none, none), none, pair(F.col("chi2_statistic"), F.col("chi2_p_value")), F.col("js_distance"))
    return n.unionByName(c)


def daily_job(spark: SparkSession, t: Tables, window_days: int = 90, keep_days: int = 30,
              out: str | None = None) -> DataFrame:
    """New batch = the last ``window_days`` of ship dates; reference = before.
    Append labelled rows (S3), score by the fitted model (M12), log (S6),
    drift (D1-D3), write the day's partition (S10) and summary (S12), report
    retention (S11); returns one summary row with the alert flag.

    What needs the reference - the fitted pipeline and model, and its value counts - is made when ``out`` has
    none yet, from one written copy; later runs read the kept model and counts and the new batch only."""
    out = out or work_path(spark, "daily")
    li = t.lineitem.withColumn("id", V.line_id())
    day = li.agg(F.max(F.to_date("l_shipdate")).alias("d")).first()["d"]
    start = F.date_sub(F.lit(day), window_days)
    # the day's batch feeds the append, the scoring, the log and the drift: it is read once and written
    batch = written(li.where(F.to_date("l_shipdate") > start), "daily-batch")
    ds = day.isoformat()
    since = (day - dt.timedelta(days=window_days - 1)).isoformat()
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd")
    kept = D.DayCounts(spark, f"{out}/counts", V.LINE_NUMERIC, V.LINE_CATEGORICAL)
    server = Server(spark, f"{out}/model")
    if not work_exists(spark, f"{out}/model/log"):
        ref = written(li.where(F.to_date("l_shipdate") <= start), "daily-reference")
        fitted, fm = fit_lines(ref)
        kept.backfill(ref, shipped)
        publish(spark, f"{out}/model", fm, fitted, 1, f"{ds}T00:00:00")
    n_new = IO.append_cases(batch, f"{out}/train_data", V.LINE_NUMERIC + V.LINE_CATEGORICAL, gid="id",
                            target=F.col("l_tax") * 10, created_at=f"{ds}T00:00:00")
    state = server.current()
    scored = model_scored(batch.select("id", "l_shipdate", *V.LINE_NUMERIC), state)
    scored = scored.withColumn("prediction", X.round_score("prediction", 4))
    rows = IO.inference_log_rows(scored, "id", F.lit(None).cast("string"), "prediction",
                                 created_at=F.col("l_shipdate").cast("timestamp"))
    logged = Observation()
    IO.append_inference_log(rows.observe(logged, F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean")),
                            f"{out}/inference_logs")
    kept.put_all(batch, shipped)
    num_counts, cat_counts = kept.compared(since, ds)
    # read by the decision and by the report
    num = written(D.numeric_drift_of(num_counts), "daily-numeric")
    cat = written(D.categorical_drift_of(cat_counts), "daily-categorical")
    summary = D.dataset_drift(num, cat).first()
    IO.dated_partition_write(scored.withColumn("run_ts", F.lit(f"{ds} 00:00:00").cast("timestamp")),
                             f"{out}/scored", "run_ts")
    IO.json_summary_sink(drift_summary(num, cat), f"{out}/reports/ds={ds}")
    parts = spark.read.schema(IO.LOG_TABLE_SCHEMA + ", ds string").parquet(f"{out}/inference_logs") \
        .groupBy("ds").agg(F.count(F.lit(1)).alias("n_rows"))
    expired = IO.retention_filter(parts, ds, keep_days).where(F.col("status") == "expired").count()
    n_logged, mean = logged.get["n"], logged.get["mean"]
    return spark.createDataFrame([(ds, n_new, n_logged, state.version, mean, summary["n_columns"], summary["n_drifted"],
                                   float(summary["share_drifted"]), bool(summary["dataset_drift"]), expired,
                                   bool(summary["dataset_drift"]))],
                                 "ds string, n_batch long, n_logged long, model_version long, mean_prediction double, "
                                 "n_columns long, n_drifted long, "
                                 "share_drifted double, dataset_drift boolean, n_expired_partitions long, alert boolean")
