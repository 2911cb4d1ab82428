import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreforge.functions.cumulative import ordered_running_sum
from scoreforge.operators import drift as D


def _ks(a, b):
    xs = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return float(np.max(np.abs(fa - fb))), float(np.sum(np.diff(xs) * np.abs(fa - fb)[:-1]))


def test_numeric_drift_statistics(spark):
    rng = np.random.default_rng(3)
    a = np.round(rng.normal(0, 1, 300), 2)
    b = np.round(rng.normal(0.3, 1, 200), 2)
    ref = spark.createDataFrame([(float(x),) for x in a], "x double")
    cur = spark.createDataFrame([(float(x),) for x in b], "x double")
    r = D.numeric_drift(ref, cur, ["x"], decide="p_value").first()
    d, w = _ks(a, b)
    assert r["ks_statistic"] == pytest.approx(d)
    assert r["wasserstein_norm"] == pytest.approx(w / np.std(a))
    assert r["stattest"] == "ks" and r["drifted"] == r["drifted_p"] == (r["ks_p_value"] < 0.05)
    other = D.numeric_drift(ref, cur, ["x"]).first()
    assert other["stattest"] == "wasserstein" and other["drifted"] == r["drifted_distance"] == (w / np.std(a) >= 0.1)


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_drift_does_not_depend_on_exchange_reuse(spark, reuse):
    """On the largest table, against DuckDB, with and without reused shuffles."""
    from scoreforge.checks.compare import compare, duck
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.1"
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        res = compare(spark, sf, "d1_numeric_drift", entry.queries()["d1_numeric_drift"],
                      entry.oracle_sql()["d1_numeric_drift"], duck(sf))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert res["cols_match"] and res["values_match"], res


def test_chi2_survival_known_values():
    assert D._chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert D._chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert D._chi2_sf(0.0, 3) == 1.0


def test_categorical_drift(spark):
    ref = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "c string")
    cur = spark.createDataFrame([("a",)] * 80 + [("c",)] * 20, "c string")
    r = D.categorical_drift(ref, cur, ["c"]).first()
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.8, 0.0, 0.2])
    m = (p + q) / 2
    kl = lambda u: sum(x * math.log(x / y) for x, y in zip(u, m) if x > 0)
    assert r["js_distance"] == pytest.approx(math.sqrt(0.5 * kl(p) + 0.5 * kl(q)))
    assert r["dof"] == 2 and r["drifted"]


@pytest.mark.parametrize("rows_per_partition", [1, 7, 1000])
def test_ordered_running_sum_is_exact(spark, rows_per_partition):
    rows = [(g, float(x), 1.0 if g == "u" else 2.0) for g in ("u", "v", "w") for x in range(50) if g != "w" or x < 1]
    df = spark.createDataFrame(rows, "g string, x double, c double")
    out = ordered_running_sum(df, "g", "x", ["c"], rows_per_partition=rows_per_partition).collect()
    assert len(out) == len(rows)
    for r in out:
        step = 1.0 if r["g"] == "u" else 2.0
        assert r["cum_c"] == (int(r["x"]) + 1) * step
        last = 49.0 if r["g"] != "w" else 0.0
        assert r["next_x"] == (None if r["x"] == last else r["x"] + 1)


def test_drift_and_quantiles_do_not_depend_on_partitioning(spark):
    from scoreforge.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(11)
    rows = [(float(x), float(y)) for x, y in zip(np.round(rng.normal(size=500), 2), rng.exponential(size=500))]
    df = spark.createDataFrame(rows, "a double, b double")
    ref, cur = df.limit(0).unionByName(df.where(F.col("b") < 1.0)), df.where(F.col("b") >= 1.0)
    results = []
    for n in (1, 16):
        r, c = ref.repartition(n), cur.repartition(n)
        drift = sorted(tuple(x) for x in D.numeric_drift(r, c, ["a"]).collect())
        q = exact_quantiles(df.repartition(n), ["a", "b"], [0.1, 0.5, 0.9], sort_limit=50, buckets=4)
        results.append((drift, q))
    (d1, q1), (d2, q2) = results
    assert q1 == q2
    for x, y in zip(d1, d2):
        for u, v in zip(x, y):
            assert u == pytest.approx(v, rel=1e-12, abs=1e-12) if isinstance(u, float) else u == v


def test_running_sum_carries_across_arrow_batches(spark):
    prev = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(g, float(x), 1.0) for g in ("u", "v") for x in range(20)]
        df = spark.createDataFrame(rows, "g string, x double, c double")
        out = ordered_running_sum(df, "g", "x", ["c"], rows_per_partition=1000, min_partitions=1).collect()
        assert len(out) == 40
        for r in out:
            assert r["cum_c"] == r["x"] + 1
            assert r["next_x"] == (None if r["x"] == 19.0 else r["x"] + 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", prev)


def test_kept_day_counts_equal_a_full_comparison(spark, tmp_path):
    import random
    from pyspark.sql import functions as F
    from scoreforge.operators import drift as D
    random.seed(3)
    rows = [(f"2024-01-{1 + i % 20:02d}", random.choice([None, float("nan"), random.gauss(i % 20, 3)]), random.choice(["a", "b", None]))
            for i in range(600)]
    df = spark.createDataFrame(rows, "ds string, x double, c string")
    kept = D.DayCounts(spark, str(tmp_path / "counts"), ["x"], ["c"])
    kept.backfill(df.where("ds <= '2024-01-12'"), F.col("ds"))
    for day in range(10, 21):                        # days 10 to 12 come again: they count once
        ds = f"2024-01-{day:02d}"
        for _ in range(1 + day % 2):                 # a day that runs again replaces itself
            kept.put(df.where(F.col("ds") == ds).drop("ds"), ds)
    for since, until in (("2024-01-15", None), ("2024-01-11", "2024-01-16")):
        upto = df if until is None else df.where(F.col("ds") <= until)
        ref, cur = upto.where(F.col("ds") < since), upto.where(F.col("ds") >= since)
        number, category = kept.compared(since, until)
        assert D.numeric_drift_of(number).collect() == D.numeric_drift(ref, cur, ["x"]).collect()
        assert D.categorical_drift_of(category).collect() == D.categorical_drift(ref, cur, ["c"]).collect()


def test_daily_job_reads_the_reference_once(spark, tmp_path):
    from scoreforge.plans.daily import daily_job
    from scoreforge.sources.tables import Tables
    from conftest import SF001
    out = str(tmp_path / "daily")
    first = daily_job(spark, Tables(spark, SF001), out=out).first().asDict()
    made = spark.read.parquet(f"{out}/counts/history").inputFiles()
    again = daily_job(spark, Tables(spark, SF001), out=out).first().asDict()
    assert spark.read.parquet(f"{out}/counts/history").inputFiles() == made
    assert again == first


def test_sums_do_not_depend_on_the_order_of_rows_and_keep_odd_values(spark):
    import random
    from scoreforge.operators import drift as D
    random.seed(9)
    inf = float("inf")
    sets = [([random.gauss(1.7e9, 1.0) for _ in range(200)], [random.gauss(1.7e9, 1.5) for _ in range(200)]),
            ([random.random() for _ in range(200)], [random.random() for _ in range(199)] + [1e9]), ([5.0] * 20, [5.0] * 20), ([], [1.0, 2.0])]
    for k, (a, b) in enumerate(sets):
        found = set()
        for parts in (1, 7):
            ref, cur = (spark.createDataFrame([(v,) for v in random.sample(x, len(x))], "x double").repartition(parts) for x in (a, b))
            r = D.numeric_drift(ref, cur, ["x"]).first()
            found.add((r["wasserstein_norm"], r["ks_statistic"]))
        (w, _), = found
        if k < 2:                                            # equal to the plain formula
            n, mean = len(a), sum(a) / len(a)
            std = (sum((v - mean) ** 2 for v in a) / n) ** 0.5
            want = sum(abs(x - y) for x, y in zip(sorted(a), sorted(b))) / n / std
            assert abs(w - want) < 1e-6 * want
    odd = D.numeric_drift(spark.createDataFrame([(1.0,), (2.0,)], "x double"), spark.createDataFrame([(inf,), (2.0,)], "x double"), ["x"]).first()
    assert odd["n_ref"] == 2 and odd["ks_statistic"] == 0.5
