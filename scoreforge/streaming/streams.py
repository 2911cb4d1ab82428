"""Structured Streaming forms of scoring, logging and monitoring.

Sources are file streams over the table folders (``readStream`` with an
explicit schema); sinks are Parquet file sinks with a checkpoint in the
shared folder, which makes them exactly-once across restarts and lost
executors; changing windows go to a keyed table by idempotent upserts.  ``available_now`` runs a stream over what is present and stops.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..functions import exprs as X
from ..operators import monitor as T
from ..operators.serving import Server, scored
from ..sources import io as IO
from ..sources.tables import table_path


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A table file (or folder of files) as a streaming source."""
    path = table_path(sf_dir, name)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rpartition("/")
    return reader.parquet(f"{folder}/{{{name}}}")    # a pattern that matches this name only: a file is no streaming folder


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need ``timestamp``; the tables carry ``timestamp_ntz`` (UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, partition_by: Sequence[str] = (),
                   mode: str = "append", available_now: bool = True) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .outputMode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="15 seconds")
    return w.start()


def stream_score(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """T5: the batch scoring plan applied to a stream.  ``score`` must be
    row-local (fitted state only: literals, broadcast maps, ML models); a
    fence or scaler is never refitted on a micro-batch."""
    return score(stream)


def run_scores(stream: DataFrame, server: Server, keep: Sequence[str], path: str, checkpoint: str, digits: int = 4,
               available_now: bool = True) -> StreamingQuery:
    """T5 by a served model: each micro-batch takes the newest published version, so a renewed model is used without
    a restart.  Scores (``keep``, prediction, confidence, model_version) replace the batch's own partition: a batch that is run
    again leaves the same rows."""
    def put(batch: DataFrame, number: int):
        state = server.current()
        rows = scored(batch, state)
        rows.select(*keep, X.round_score("prediction", digits).alias("prediction"), X.tier("prediction").alias("confidence"),
                    F.lit(state.version).cast("long").alias("model_version")) \
            .write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="15 seconds")).start()


def stream_log(stream: DataFrame, key: str, gid, payload, prediction, ts: str = "ts",
               watermark: str = "10 minutes") -> DataFrame:
    """Log rows with duplicates of ``key`` inside the watermark dropped,
    ready for an append-only, checkpointed file sink partitioned by day."""
    dedup = event_time(stream, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
    return IO.inference_log_rows(dedup, gid, payload, prediction, created_at=ts, keep=[key])


def stream_windows(stream: DataFrame, value, key: str = "event_type", ts: str = "ts", size: str = "1 hour",
                   watermark: str = "10 minutes", bounds: Sequence[float] = K.LATENCY_BOUNDS) -> DataFrame:
    """Windowed request counts and cumulative latency buckets; rows later than the
    watermark are dropped.  Append mode gives closed windows once, update mode every change of one (``run_upserts``).
    The p95 is computed from the buckets (``window_quantile``)."""
    s = event_time(stream, ts).withWatermark(ts, watermark)
    aggs = [F.count(F.lit(1)).alias("n")] + \
           [F.count_if(value <= F.lit(float(b))).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return s.groupBy(F.window(F.col(ts), size).alias("window"), F.col(key)).agg(*aggs)


def run_upserts(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], merge_every: int = 64,
                available_now: bool = True) -> StreamingQuery:
    """A stream in update mode into a keyed table: the newest row of each key counts (``read_upserts``).

    Every micro-batch replaces its own partition, named by the batch id, so one that is run again after a
    restart or a lost driver leaves the same rows.  Each ``merge_every``-th batch also
    carries all rows that still count, and readers start from there; older partitions are left to retention."""
    def put(batch: DataFrame, number: int):
        rows = batch
        if number and number % merge_every == 0:
            before = _newest(_partitions(df.sparkSession, path, df.schema, number - merge_every, number), keys).drop("batch")
            rows = before.join(batch.select(*keys), list(keys), "left_anti").select(batch.columns).unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = df.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="15 seconds")).start()


def _partitions(spark: SparkSession, path: str, schema, first: int, end: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(path)
    rows = rows.where(F.col("batch") >= first)
    return rows if end is None else rows.where(F.col("batch") < end)


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the greatest batch for each key: a partial maximum, then one row per key and task."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def read_upserts(spark: SparkSession, path: str, schema, keys: Sequence[str], merge_every: int = 64) -> DataFrame:
    """The rows that count of a table written by ``run_upserts``: closed and still open windows alike."""
    every = _partitions(spark, path, schema, 0)
    last = every.agg(F.max("batch")).first()[0] or 0
    return _newest(_partitions(spark, path, schema, last // merge_every * merge_every), keys).drop("batch")


def window_quantile(rows: DataFrame, q: float = 0.95, size: str = "1 hour", key: str = "event_type",
                    bounds: Sequence[float] = K.LATENCY_BOUNDS) -> DataFrame:
    cum = F.array(*[F.col(f"le_{i}") for i in range(len(bounds))])
    secs = T.interval_seconds(size)
    return rows.select(F.date_format("window.start", T.TS_TEXT).alias("window_start"), key, "n",
                       (F.col("n") / F.lit(float(secs))).alias("rate"),
                       T.histogram_quantile(q, cum, F.col("n"), bounds).alias(f"p{int(q * 100)}"))
