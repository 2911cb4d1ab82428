import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreforge.llm import quality as Q

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    forest = Q.fit_forest(x, y, trees=15, depth=3)

    def walk(row, node):
        while forest.left[node] >= 0:
            node = forest.left[node] + int(row[forest.feature[node]] > forest.threshold[node])
        return forest.value[node]
    want = [forest.base + sum(walk(r, t) for t in forest.roots) for r in x]
    assert np.allclose(forest.raw(x), want)
    assert ((forest.score(x) >= 0.5) == (y == 1)).mean() > 0.97


def test_one_label_or_none_gives_the_prior():
    assert Q.fit_forest(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == pytest.approx([0.9, 0.9])
    assert Q.fit_forest(np.zeros((30, 3)), np.ones(30)).score(np.zeros((1, 3)))[0] > 0.95


def test_held_out_fold_is_never_learnt_and_well_predicted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = Q.fit_quality(docs, labels)
    # labels of the held-out fold turned round change nothing
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.fit_quality(docs, turned)
    assert np.array_equal(forest.value, again.value) and np.array_equal(forest.feature, again.feature)
    rows = (Q.score_quality(docs, forest).join(labels, "doc_id").where(Q.held_out(F.col("doc_id")))
            .select("doc_id", "score", "quality").collect())
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in rows]) > 0.95


def test_odd_rows(spark, make_docs):
    labels = spark.createDataFrame([(4, 1, None), (6, 0, 0), (None, 1, 1), (4, None, 0), (7, 5, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = make_docs(ODD)
    scored = Q.score_quality(docs, Q.fit_quality(docs, labels), to="score").collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert Q.score_quality(make_docs([]), Q.fit_quality(make_docs([]), labels.limit(0))).count() == 0
    assert spark.createDataFrame([(None,)], "d long").select(Q.held_out(F.col("d"))).first()[0] is False
