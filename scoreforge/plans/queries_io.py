"""Registered source/sink queries (S1, S3, S4, S6-S11) and the batch id
default (P8).  Each writes to the shared work folder and returns the data a
reader sees afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import work_path
from ..sources import io as IO
from .queries_core import _round_doubles, _t
from .registry import query

AS_OF = "2024-01-31"
LOG_START = "2024-01-10"
LOG_END = "2024-01-20T12:00:00"


@query("s1_write_csv")
def s1(spark, sf_dir):
    t = _t(spark, sf_dir)
    sup = t.supplier
    path = work_path(spark, "csv", "supplier")
    IO.write_csv(sup, path)
    return IO.read_csv(spark, path, sup.schema)


@query("s3_append_cases")
def s3(spark, sf_dir):
    t = _t(spark, sf_dir)
    o = t.orders
    path = work_path(spark, "tables", "train_data")
    IO.append_cases(o, path, ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"],
                    gid=F.concat(F.lit("O"), F.col("o_orderkey").cast("string")),
                    target=F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1e6),
                    created_at=f"{AS_OF}T00:00:00")
    return _round_doubles(IO.read_cases(spark, path))


@query("s4_flatten_payload")
def s4(spark, sf_dir):
    t = _t(spark, sf_dir)
    ev = t.events
    text = IO.payload(["event_type", F.struct("value", "user_id").alias("metrics"),
                       F.from_json("props", "k int").alias("props")])
    schema = "event_type string, metrics struct<value: double, user_id: long>, props struct<k: int>"
    out = IO.flatten_payload(ev.select("event_id", text.alias("payload")), "payload", schema)
    return _round_doubles(out)


def log_rows(t):
    """events as an inference log: id, raw gid (null for every tenth user),
    props as payload (every 13th made unparsable), a clipped prediction."""
    ev = t.events.withColumnRenamed("event_id", "id")
    pred = X.round_score(X.clip(F.col("value") / 500.0, 0.0, 1.0), 4)
    bad = F.when(F.col("id") % 13 == 0, F.lit("not json")).otherwise(F.col("props"))
    gid = F.when(F.col("user_id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("U"), F.col("user_id")))
    return IO.inference_log_rows(ev, gid, bad, pred, created_at="ts", keep=["id"])


@query("s6_append_inference_log")
def s6(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = work_path(spark, "tables", "inference_logs")
    IO.append_inference_log(log_rows(t).drop("id"), path)
    return _round_doubles(IO.read_inference_log(spark, path))


@query("s7_export_table")
def s7(spark, sf_dir):
    t = _t(spark, sf_dir)
    nation = t.nation
    paths = IO.export_table(nation, work_path(spark, "export"), "nation", fmt="both")
    csv = IO.read_csv(spark, paths["csv"], nation.schema).withColumn("fmt", F.lit("csv"))
    pq = spark.read.parquet(paths["parquet"]).withColumn("fmt", F.lit("parquet"))
    return csv.unionByName(pq)


@query("s8_recent_log_query")
def s8(spark, sf_dir):
    t = _t(spark, sf_dir)
    out = IO.recent_log_query(log_rows(t), "k int", limit=50, start=LOG_START, end=LOG_END)
    return _round_doubles(out.select("id", "gid", "prediction", "confidence", "created_at",
                                     F.col("payload.k").alias("k")))


def batch_docs(t, size: int = 50):
    """Batch request documents built from part: ``size`` cases per document
    (bounded by construction), gid null / empty / set by key."""
    k = F.col("p_partkey")
    gid = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("P"), k))
    case = F.struct(k.alias("_k"), gid.alias("gid"), F.col("p_brand").alias("region"),
                    F.col("p_type").alias("business_type"), F.col("p_retailprice").alias("revenue"),
                    F.col("p_size").alias("employee_count"), F.col("p_name").alias("description"))
    per = (t.part.groupBy(F.floor(k / size).alias("b"))
           .agg(F.array_sort(F.collect_list(case)).alias("cases")))
    return per.select(F.concat(F.lit("B"), F.col("b")).alias("batch_id"),
                      F.transform("cases", lambda c: c.dropFields("_k")).alias("cases"),
                      (F.col("b") % 2 == 0).alias("include_explanations"))


@query("s9_read_batch_json")
def s9(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = work_path(spark, "requests", "batches")
    batch_docs(t).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    out = IO.read_batch_json(spark, path)
    return _round_doubles(out.select("batch_id", "include_explanations", "pos", "gid", "region", "business_type",
                                     "revenue", "employee_count", "description"))


@query("p8_default_id")
def p8(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = work_path(spark, "requests", "batches")
    batch_docs(t).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    out = IO.read_batch_json(spark, path)
    return out.select("batch_id", "pos", X.default_id("gid", "pos").alias("gid"))


@query("s10_dated_partition_write")
def s10(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = work_path(spark, "tables", "events_by_day")
    IO.dated_partition_write(t.events.select("event_id", "ts", "event_type", "value"), path, "ts")
    back = spark.read.schema("event_id long, ts timestamp_ntz, event_type string, value double, ds string") \
        .parquet(path)
    return _round_doubles(back.select("event_id", "event_type", "value", "ds"))


@query("s11_retention_filter")
def s11(spark, sf_dir):
    t = _t(spark, sf_dir)
    parts = (t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("ds"))
             .agg(F.count(F.lit(1)).alias("n_rows")))
    return IO.retention_filter(parts, AS_OF, keep_days=7)
