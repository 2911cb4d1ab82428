"""Kernel contributions: size of the background, scorers that state their own mean over it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreforge.operators import sampling_shap as K
from scoreforge.operators.ensemble import Ensemble

from test_treeshap import _random_tree


@pytest.mark.parametrize("d,rows", [(1, 7), (3, 1), (6, 40)])
def test_stated_means_equal_those_of_every_mixed_row(d, rows):
    rng = np.random.default_rng(d)
    z, w = K.coalitions(d, 100)
    x, background = rng.normal(size=(9, d)), rng.normal(size=(rows, d))
    x[0, 0] = np.nan
    trees = Ensemble({t: _random_tree(rng, 4, d) for t in range(3)}, [1.0, 0.5, 0.25])
    linear = K.LinearScore(0.5, rng.normal(size=d))
    plain = K.mean_scores(lambda r: trees.predict(r), background, z)(x)
    assert np.allclose(K.mean_scores(trees, background, z)(x), plain, atol=1e-12)
    plain = K.mean_scores(lambda r: linear(r), background, z)(x[1:])
    assert np.allclose(K.mean_scores(linear, background, z)(x[1:]), plain, atol=1e-12)
    design = K.solver(z, w)
    for score in (trees, linear):
        assert np.allclose(K.kernel_contributions(x[1:], background, z, design, score),
                           K.kernel_contributions(x[1:], background, z, design, lambda r: score(r)), atol=1e-9)


def test_cost_of_a_row_does_not_grow_with_the_background():
    class Counted(K.LinearScore):
        rows = 0

        def __call__(self, x):
            Counted.rows += len(x)
            return super().__call__(x)
    score, (z, w) = Counted(0.1, [1.0, -2.0, 3.0]), K.coalitions(3, 100)
    x, background = np.ones((50, 3)), np.arange(300.0).reshape(100, 3)
    K.kernel_contributions(x, background, z, K.solver(z, w), score)
    assert Counted.rows == 150                              # each row and each background row once


def test_line_contributions_use_a_hundred_background_rows(spark, tmp_path):
    import __spark_entry__ as entry
    from scoreforge.functions import exprs as X
    rows = [(i, 1, i % 7, i % 5, float(i * i % 50), float(i * 37 % 991), (i % 11) / 100, (i % 9) / 100, "ANR"[i % 3], "OF"[i % 2])
            for i in range(150)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                                "l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.queries()["e2_sampled_contributions"](spark, str(tmp_path)).withColumn("h", X.hash_int(F.col("id"))).collect()
    assert len(got) == 150 * 6
    first = sorted({(r["h"], r["id"]) for r in got})[:100]
    weights = {"l_quantity": 0.02, "l_extendedprice": 0.05, "l_discount": -0.04, "l_tax": 0.01}
    mean = sum(weights.get(r["feature"], 0.0) * r["value"] for r in got if (r["h"], r["id"]) in first) / 100
    assert all(abs(r["expected_value"] - 0.5 - mean) < 1e-5 for r in got)
