"""Steps that the larger jobs share: dealt tables, counted terms, aligned names."""

from pyspark.sql import functions as F

from scoreforge.operators import explain as E
from scoreforge.operators import features as FT
from scoreforge.operators import model as MD
from scoreforge.plans import models as J
from scoreforge.session import written


def test_dealt_tables_are_read_by_several_tasks(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2).coalesce(1)
    table = written(df, "dealt", "id")
    assert table.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert table.agg(F.count("*"), F.sum("x")).first()[:] == (1000, 999000)


def test_terms_reach_the_shuffle_once_per_batch(spark):
    docs = spark.createDataFrame([(["a", "b", "a"],), ([],), (["b"],)] * 3000, "terms array<string>").coalesce(1)
    got = {r["term"]: (r["tf"], r["df"]) for r in FT.term_stats(docs, count_docs=True).collect()}
    assert got == {"a": (6000, 3000), "b": (6000, 6000), None: (0, 9000)}
    lists = docs.limit(6).toArrow().column("terms").combine_chunks()
    assert FT._counted(lists, False).num_rows == 2


def test_names_align_beyond_the_numbered_literals(spark):
    for n in (0, 2, 64, 65):
        df = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(n)]).cast("array<double>").alias("s"))
        row = df.select(E.align_names(F.col("s"), F.slice("s", 1, 1), ["p", "q"]).alias("c")).first()["c"]
        names = ["p", "q"] if n == 2 else [f"feature_{i}" for i in range(n)]
        assert [c["feature"] for c in row] == names and [c["shap"] for c in row] == [float(i) for i in range(n)]
        assert [c["value"] for c in row] == [0.0] * n


def test_a_fit_has_no_more_tasks_than_cores_whatever_its_files(spark, tmp_path, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 400, numPartitions=5 * cores).select(
        F.col("id").alias("case_id"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7 / 7.0).alias(J.V.CASE_TARGET),
        F.when(F.col("id") % 5 == 0, "validation").otherwise("train").alias("split"))
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    seen, real = [], MD.gbt_fit
    monkeypatch.setattr(MD, "gbt_fit", lambda train, *a, **k: seen.append(train) or real(train, *a, **k))
    params = {"maxIter": 2, "maxDepth": 1, "maxBins": 8}
    J.fit_model(J.Prepared(data, None, ["a"]), params)
    MD.cross_validate(data, "case_id", "features", J.V.CASE_TARGET, params, k=2)
    assert [d.rdd.getNumPartitions() <= cores for d in seen] == [True] * 3 and seen[0].count() == 320
    monkeypatch.setattr(MD, "FIT_ROWS", 400 // (2 * cores))
    assert cores < MD.in_few_tasks(data).rdd.getNumPartitions() <= 2 * cores + 2
    assert sorted(r[0] for r in MD.in_few_tasks(data).select("case_id").collect()) == list(range(400))


def test_folds_are_hashed_once_and_fits_that_fill_the_memory_run_alone(spark, monkeypatch):
    import threading
    from pyspark.ml.feature import VectorAssembler
    rows = spark.range(0, 600, numPartitions=3).select(
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("k"), F.col("id"))).alias("key"), (F.col("id") % 11).cast("double").alias("a"),
        (F.col("id") % 4).cast("double").alias("b"), ((F.col("id") * 7 % 13) / 13.0).alias("y"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    seen, now, most, lock, real = [], [0], [0], threading.Lock(), MD.gbt_fit

    def fit(train, *a, **k):
        with lock:
            seen.append(train)
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            return real(train, *a, **k)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(MD, "gbt_fit", fit)
    monkeypatch.setattr(MD, "storage_memory", lambda spark: 1, raising=False)
    base = {"maxDepth": 1, "maxBins": 32, "seed": 42}
    found = MD.tune(data, "key", "features", "y", {"maxIter": [1, 2], "stepSize": [0.1, 0.5]}, k=3, base=base, refit=False,
                    write_folds=True)
    assert len(seen) == 6 and most[0] == 1
    assert not any("md5" in d._jdf.queryExecution().optimizedPlan().toString() for d in seen)
    assert sum(d.count() for d in seen) == 2 * 2 * 588                       # two families, two of three folds, no null keys
    got = {(r["candidate"], r["fold"]): (r["rmse"], r["mae"]) for r in found.folds.collect()}
    folded = MD.hash_folds(data, "key", 3)
    for f in range(3):
        fm = real(folded.where(F.col("fold") != f), "features", "y", {**base, "maxIter": 2, "stepSize": 0.5})
        e = F.col("prediction") - F.col("y")
        want = fm.predict(folded.where(F.col("fold") == f), clip=False).agg(F.sqrt(F.avg(e * e)), F.avg(F.abs(e))).first()
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[3, f], want))


def test_a_read_of_other_folds_opens_no_held_out_file(spark):
    from pyspark.ml.feature import VectorAssembler
    rows = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 3).cast("double").alias("a"), F.lit(0.5).alias("y"))
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    folds = MD.written_folds(data, "key", "features", "y", 4)
    assert sum(folds.sizes.values()) == 200 and folds.width == 1
    for f in range(4):
        files = {r[0] for r in folds.train(f).select(F.input_file_name()).distinct().collect()}
        assert files and not any(f"fold={f}/" in name for name in files)
        assert folds.train(f).count() == 200 - folds.sizes[f] and folds.held_out(f).count() == folds.sizes[f]
    per_fit = (200 - min(folds.sizes.values())) * (MD.FIT_ROW_BYTES + 4)
    from unittest import mock
    for memory, fits in ((0, 1), (2 * per_fit, 2), (100 * per_fit, 4)):
        with mock.patch.object(MD, "storage_memory", lambda spark: memory):
            assert folds.at_once(4) == fits
