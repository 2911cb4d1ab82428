"""Registered streaming queries (T5-T7): each runs a stream to completion
over the table (availableNow) into a checkpointed sink and returns the
sink's contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.serving import Server, publish
from ..session import work_path
from ..sources import io as IO
from ..sources import views as V
from ..streaming import streams as S
from . import models as J
from .queries_core import _round_doubles, _t
from .registry import query

@query("t5_stream_score")
def t5(spark, sf_dir):
    """lineitem as a stream, scored by the served line model."""
    fitted, fm = J.fit_lines(_t(spark, sf_dir).lineitem)
    root = work_path(spark, "models", "t5")
    publish(spark, root, fm, fitted, 1)
    out, ckpt = work_path(spark, "streams", "scores"), work_path(spark, "checkpoints", "scores")
    lines = S.stream_table(spark, sf_dir, "lineitem").withColumn("id", V.line_id())
    S.run_scores(lines, Server(spark, root), ["id"], out, ckpt).awaitTermination()
    return _round_doubles(spark.read.parquet(out).drop("batch"))


@query("t6_stream_log")
def t6(spark, sf_dir):
    out, ckpt = work_path(spark, "streams", "inference_logs"), work_path(spark, "checkpoints", "inference_logs")
    ev = S.stream_table(spark, sf_dir, "events")
    rows = S.stream_log(ev, "event_id", F.concat(F.lit("U"), F.col("user_id")), F.col("props"),
                        X.round_score(X.clip(F.col("value") / 500.0, 0.0, 1.0), 4))
    q = S.run_to_parquet(rows, out, ckpt, partition_by=["ds"])
    q.awaitTermination()
    return _round_doubles(spark.read.schema("event_id long, " + IO.LOG_TABLE_SCHEMA + ", ds string").parquet(out))


@query("t7_stream_windows")
def t7(spark, sf_dir):
    """All windows, open ones included, from the stream itself."""
    out, ckpt = work_path(spark, "streams", "windows"), work_path(spark, "checkpoints", "windows")
    windows = S.stream_windows(S.stream_table(spark, sf_dir, "events"), F.col("value") / 100.0)
    keys = ["window", "event_type"]
    S.run_upserts(windows, out, ckpt, keys).awaitTermination()
    return _round_doubles(S.window_quantile(S.read_upserts(spark, out, windows.schema, keys)))


@query("d4_daily_job")
def d4(spark, sf_dir):
    from .daily import daily_job
    return _round_doubles(daily_job(spark, _t(spark, sf_dir)))


@query("s12_json_summary_sink")
def s12(spark, sf_dir):
    """D1's and D2's results written as nested JSON, read back and flattened."""
    from ..operators import drift as D
    from .daily import TESTS_SCHEMA, drift_summary
    ref, cur = V.ship_split(_t(spark, sf_dir))
    path = work_path(spark, "reports", "drift")
    IO.json_summary_sink(drift_summary(D.numeric_drift(ref, cur, V.LINE_NUMERIC),
                                       D.categorical_drift(ref, cur, V.LINE_CATEGORICAL)), path)
    schema = (f"column string, n_ref long, n_cur long, tests {TESTS_SCHEMA}, stattest string, drift_score double, "
              "drifted boolean")
    back = spark.read.schema(schema).json(path)
    return _round_doubles(back.select(
        "column", "n_ref", "n_cur", F.col("tests.ks.statistic").alias("ks_statistic"), F.col("tests.ks.p_value").alias("ks_p_value"),
        "tests.wasserstein_norm", F.col("tests.chisquare.statistic").alias("chi2_statistic"),
        F.col("tests.chisquare.p_value").alias("chi2_p_value"), F.col("tests.jensenshannon").alias("js_distance"), "tests.psi",
        "stattest", "drift_score", "drifted"))
