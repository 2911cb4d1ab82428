from pyspark.sql import functions as F

from scoreforge.sources import io as IO


def test_retention_boundaries_and_non_dates(spark):
    parts = spark.createDataFrame([("2024-01-01",), ("2024-01-24",), ("2024-01-23",), ("latest",), ("2024-13-40",)],
                                  "ds string")
    got = {r["ds"]: r["status"] for r in IO.retention_filter(parts, "2024-01-31", 7).collect()}
    # cutoff 2024-01-24: strictly older expires, the cutoff day itself is kept
    assert got == {"2024-01-01": "expired", "2024-01-24": "kept", "2024-01-23": "expired",
                   "latest": "skipped", "2024-13-40": "skipped"}


def test_recent_log_query_inclusive_and_bad_payload(spark):
    rows = [(1, "g1", '{"k": 1}', "2024-01-10T00:00:00"), (2, "g1", "not json", "2024-01-11T00:00:00"),
            (3, "g2", '{"k": 3}', "2024-01-12T00:00:00"), (4, "g1", '{"k": 4}', "2024-01-13T00:00:01")]
    log = spark.createDataFrame(rows, "id long, gid string, payload_json string, created_at string")
    out = IO.recent_log_query(log, "k int", limit=2, gid="g1", start="2024-01-10T00:00:00",
                              end="2024-01-13T00:00:00").collect()
    assert [r["id"] for r in out] == [2, 1]  # newest first, end inclusive, row 4 after the end
    assert out[0]["payload"] is None and out[1]["payload"]["k"] == 1
    assert len(IO.recent_log_query(log, "k int", limit=50, gid="", start=None, end="").collect()) == 4


def test_flatten_nested_payload(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x", "d": {"e": 2.5}}}'), (2, "{")], "id int, p string")
    out = IO.flatten_payload(df, "p", "a int, b struct<c: string, d: struct<e: double>>")
    assert out.columns == ["id", "a", "b.c", "b.d.e"]
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["b.d.e"] == 2.5 and rows[2]["a"] is None


def test_csv_round_trip_and_append_count(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.1), (2, None, None)], "k int, s string, v double")
    IO.write_csv(df, str(tmp_path / "c"))
    back = IO.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, "a,b", 0.1), (2, None, None)]
    n = IO.append_cases(df, str(tmp_path / "t"), ["s", "v"], gid=F.col("k").cast("string"), target="v",
                        created_at="2024-01-01T00:00:00")
    n2 = IO.append_cases(df, str(tmp_path / "t"), ["s", "v"], gid=F.col("k").cast("string"))
    rows = IO.read_cases(spark, str(tmp_path / "t")).collect()
    assert n == n2 == 2 and len(rows) == 4
    assert sum(r["target"] is None for r in rows) == 3


def test_recent_log_end_with_and_without_fractions(spark):
    rows = [(1, "2024-01-20T12:00:00.000000"), (2, "2024-01-20T12:00:00.000001"), (3, "2024-01-09T23:59:59.999999")]
    log = spark.createDataFrame([(i, "g", "{}", t, t[:10]) for i, t in rows],
                                "id long, gid string, payload_json string, created_at string, ds string")
    out = IO.recent_log_query(log, "k int", start="2024-01-10", end="2024-01-20T12:00:00").collect()
    assert [r["id"] for r in out] == [1]


def test_append_counts_while_writing_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(5, numPartitions=1).mapInArrow(touch, "id long")
    assert IO.append_cases(df, str(tmp_path / "t"), ["id"], gid="id") == 5 and seen.value == 5


def test_recent_log_day_pruning_follows_utc(spark):
    from scoreforge.sources import io as IO
    log = spark.createDataFrame([(1, "g", "{}", 0.5, "Low", None, "2024-01-11T02:00:00+00:00", "2024-01-11")],
                                "id long, gid string, payload_json string, prediction double, confidence string, "
                                "explanation_summary string, created_at string, ds string")
    for end, n in (("2024-01-10T23:00:00-05:00", 1), ("2024-01-10T20:00:00-05:00", 0), ("2024-01-11T03:00:00Z", 1)):
        assert IO.recent_log_query(log, "a int", end=end).count() == n
        assert IO.recent_log_query(log.drop("ds"), "a int", end=end).count() == n
    for start, n in (("2024-01-11T10:00:00+09:00", 1), ("2024-01-11T12:00:00+09:00", 0)):
        assert IO.recent_log_query(log, "a int", start=start).count() == n
