"""The pipeline against its stages done plainly on a small table."""

import corpus_pipeline
from pyspark.sql import functions as F

from scoreforge.llm import decontaminate, quality, secrets, simhash
from scoreforge.llm.common import materialise

from .test_simhash import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, results = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        results[name] = materialise(stage(spark, before, SF), f"test-{name}")
        before = results[name]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontamination", "secrets", "packing"]
    assert all(results[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    kept = {n: {r["doc_id"]: r["text"] for r in results[n].collect()} for n, _ in corpus_pipeline.STAGES[:-1]}

    forest = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: (r["text"], forest.score(quality.statistics_matrix([r["text"]]))[0]) for r in docs.collect()}
    assert kept["quality"] == {i: t for i, (t, s) in scores.items() if s >= 0.7}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept["quality"] for i in good) >= 0.97 * len(good)

    prints = {i: simhash.simhash(t) for i, t in kept["quality"].items()}
    root = {}
    for group in brute_groups(set(prints.values()), 3):
        for fp in group:
            root[fp] = min(group)
    least = {}
    for i, fp in prints.items():
        least[root.get(fp, fp)] = min(i, least.get(root.get(fp, fp), i))
    assert set(kept["simhash"]) == set(least.values())

    items = [(r["item_id"], decontaminate.normal(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items, 0.1)
    leaks = {i for i, t in kept["simhash"].items() if matcher.find([t])[0]}
    assert {i for i, t in kept["simhash"].items() if any(b in decontaminate.normal(t) for _, b in items)} <= leaks
    assert set(kept["decontamination"]) == set(kept["simhash"]) - leaks

    assert kept["secrets"] == {i: secrets.redacted(t) for i, t in kept["decontamination"].items()}
    assert results["secrets"].where(F.col("n_chars") != F.char_length("text")).count() == 0
    pieces = results["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["secrets"]) and all(r["n"] == r["t"] for r in pieces)


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0


def test_stages_take_odd_rows_and_columns_with_clashing_names(spark, make_docs):
    from .conftest import ODD
    clash = make_docs(ODD)
    for name in ("_score", "score", "_leaks", "secrets", "fp", "component_id", "least", "th", "bucket", "kind", "ids", "_y"):
        clash = clash.withColumn(name, F.lit(None).cast("string"))
    empty = clash.limit(0)
    for docs in (clash, empty):
        before = docs
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, before, SF)
            if name != "packing":
                assert after.columns == docs.columns
                before = after
            else:
                kept = {r["doc_id"] for r in before.collect()}
                assert {r["doc_id"] for r in after.collect()} == kept
