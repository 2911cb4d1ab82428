import datetime as dt
import os
import time

from pyspark.sql import functions as F

from scoreforge.streaming import streams as S


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "id long, x double")
    df.write.parquet(src)
    score = lambda d: d.select("id", (F.col("x") * 2 + 1).alias("p"))
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = S.run_to_parquet(S.stream_score(stream, score), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in score(df).collect())


def test_late_row_dropped_and_duplicates_removed(spark, tmp_path):
    src = str(tmp_path / "events")
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    first = [(1, t0 + dt.timedelta(minutes=1), "a", 10.0), (2, t0 + dt.timedelta(hours=3), "a", 10.0)]
    # second file moves the watermark again and repeats an id; the third holds a row hours behind it.
    # Spark drops late rows against the watermark of the previous micro-batch, hence three files.
    second = [(4, t0 + dt.timedelta(hours=3, minutes=5), "a", 10.0), (2, t0 + dt.timedelta(hours=3), "a", 10.0)]
    third = [(3, t0 + dt.timedelta(minutes=2), "a", 10.0)]
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # file streams order files by modification time
    files = sorted(f for f in os.listdir(src) if f.endswith(".parquet"))
    assert len(files) == 3
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    rows = S.stream_windows(stream, F.col("value") / 100.0)
    q = S.run_to_parquet(rows, str(tmp_path / "w"), str(tmp_path / "wc"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "w")).collect()
    first_hour = [r for r in out if r["window"]["start"].hour == 0]
    assert first_hour and first_hour[0]["n"] == 1  # the late row at 00:02 was dropped
    logs = S.stream_log(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "event_id",
                        F.lit("g"), F.lit("{}"), F.lit(0.5))
    q = S.run_to_parquet(logs, str(tmp_path / "l"), str(tmp_path / "lc"))
    q.awaitTermination()
    ids = sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "l")).collect())
    assert ids.count(2) == 1


def test_open_windows_come_from_the_stream_across_restarts(spark, tmp_path):
    """Update mode: every window is in the table, late rows are dropped, merged partitions carry the rest."""
    src, out, ckpt = (str(tmp_path / n) for n in ("events", "table", "ckpt"))
    t0 = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    keys = ["window", "event_type"]

    def feed(minutes):
        spark.createDataFrame([(i, t0 + dt.timedelta(minutes=m), "ab"[i % 2], 10.0) for i, m in enumerate(minutes)],
                              schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)

    def run():
        rows = S.stream_windows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src),
                                F.col("value") / 100.0)
        S.run_upserts(rows, out, ckpt, keys, merge_every=2).awaitTermination()
        got = S.read_upserts(spark, out, rows.schema, keys, merge_every=2).collect()
        return {(r["window"]["start"].hour, r["event_type"]): r["n"] for r in got}

    feed([1, 2, 3, 61])
    assert run() == {(0, "a"): 2, (0, "b"): 1, (1, "b"): 1}
    feed([62, 63, 185])
    feed([186])                                # its batch still has the watermark of the one before
    feed([4, 190])                             # minute 4 is behind the watermark by now
    want = {(0, "a"): 2, (0, "b"): 1, (1, "b"): 2, (1, "a"): 1, (3, "a"): 2, (3, "b"): 1}
    assert run() == want
    assert run() == want                       # nothing new
