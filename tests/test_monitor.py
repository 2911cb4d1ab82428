import datetime as dt

from pyspark.sql import functions as F

from scoreforge.operators import monitor as T


def test_histogram_quantile_interpolates(spark):
    df = spark.createDataFrame([([2, 6, 10], 10)], "cum array<int>, total int")
    bounds = [0.1, 0.5, 1.0]
    got = df.select(T.histogram_quantile(0.5, F.col("cum"), F.col("total"), bounds).alias("q")).first()["q"]
    # rank 5 in (0.1, 0.5]: 0.1 + 0.4 * (5 - 2) / 4
    assert abs(got - 0.4) < 1e-12
    over = spark.createDataFrame([([0, 0, 1], 4)], "cum array<int>, total int")
    assert over.select(T.histogram_quantile(0.95, F.col("cum"), F.col("total"), bounds)).first()[0] == 1.0
    empty = spark.createDataFrame([([0, 0, 0], 0)], "cum array<int>, total int")
    assert empty.select(T.histogram_quantile(0.95, F.col("cum"), F.col("total"), bounds)).first()[0] is None


def test_sustained_alert_needs_unbroken_run(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 30)
    slow = [(t0 + dt.timedelta(minutes=m), "predict", 2.0) for m in range(0, 8)]  # 8 minutes of slow calls
    gap = [(t0 + dt.timedelta(hours=1), "predict", 2.0)]  # one slow call: 5 evaluations, under 5 minutes
    df = spark.createDataFrame(slow + gap, "ts timestamp, ep string, v double")
    out = T.sustained_alert(df, "ts", F.col("v"), "ep", threshold=0.5).collect()
    assert len(out) == 1
    assert out[0]["run_start"] == "2024-01-01 00:01:00" and out[0]["n_evaluations"] == 12


def test_runs_merge_over_any_slices(spark):
    import random
    random.seed(1)
    slots = [(k, s) for k in ("a", "b", None) for s in range(100_000, 103_000) if random.random() < 0.97]
    slots += [("one", i) for i in range(-300, 9000)]               # one key, one run through every slice
    by = {}
    for k, s in slots:
        by.setdefault(k, set()).add(s)
    want = []
    for k, own in by.items():
        starts = sorted(s for s in own if s - 1 not in own)
        ends = sorted(s for s in own if s + 1 not in own)
        want += [(k, a, b) for a, b in zip(starts, ends)]
    df = spark.createDataFrame(slots + slots[:50] + [("a", None)], "k string, s long")
    for fan in (64, 3):
        got = T.merged_runs(df, "k", "s", fan).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert T.merged_runs(df.where("false"), "k", "s").count() == 0


def test_one_endpoint_is_not_one_task(spark):
    df = spark.createDataFrame([("only", i) for i in range(5000)], "k string, s long")
    plan = T.merged_runs(df, "k", "s")._jdf.queryExecution().toString()
    assert "Window" not in plan
