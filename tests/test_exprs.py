import hashlib
import math

from pyspark.sql import functions as F

from scoreforge import constants as K
from scoreforge.functions import exprs as X


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-5.0,), (5.0,), (50.0,), (10.0,)], "x double")
    got = [r[0] for r in df.select(X.clip("x", 0.0, 10.0)).collect()]
    assert got[0] is None
    assert math.isnan(got[1])
    assert got[2:] == [0.0, 5.0, 10.0, 10.0]


def test_tier_is_strict_on_unrounded_value(spark):
    df = spark.createDataFrame([(0.4,), (0.40000001,), (0.7,), (0.7000001,), (0.0,)], "x double")
    got = [r[0] for r in df.select(X.tier("x")).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "Low"]


def test_round_score_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.00005,), (0.12345,), (-0.00005,), (0.99999,)], "x double")
    got = [r[0] for r in df.select(X.round_score("x", 4)).collect()]
    assert got[0] == 0.0001 and got[3] == 1.0
    assert got[2] == -0.0001


def test_hash_matches_python_md5(spark):
    keys = [42, 0, 7, 123456789]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r[0] for r in df.select(X.hash_mod("k", 100)).collect()]
    want = [int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 100 for k in keys]
    assert got == want and got[0] == 84


def test_map_lookup_default(spark):
    df = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    got = [r[0] for r in df.select(X.map_lookup("c", {"a": 1.0}, 0.5)).collect()]
    assert got == [1.0, 0.5, 0.5]


def test_default_id(spark):
    df = spark.createDataFrame([(None, 0), ("", 1), ("x", 2)], "gid string, pos int")
    assert [r[0] for r in df.select(X.default_id("gid", "pos")).collect()] == ["batch_0", "batch_1", "x"]
    assert [r[0] for r in df.select(X.default_id("gid")).collect()] == ["api_request", "api_request", "x"]


def _py_score(row):
    fin = (row["credit_score"] / 850) * 0.3 + (1 - row["debt_to_equity_ratio"] / 3) * 0.25 + \
        (row["liquidity_ratio"] / 3) * 0.2 + (row["profitability_margin"] / 0.3) * 0.25
    op = (row["operational_efficiency"] / 100) * 0.4 + (row["customer_satisfaction"] / 100) * 0.3 + \
        (row["growth_rate"] / 0.5) * 0.3
    comp = K.COMPLIANCE_WEIGHT[row["compliance_level"]] * 0.4 + K.RISK_WEIGHT[row["risk_category"]] * 0.3 + \
        K.REGULATORY_WEIGHT[row["regulatory_status"]] * 0.2 + (1 - row["regulatory_violations"] / 10) * 0.1
    mk = (row["market_share"] / 0.5) * 0.4 + (row["years_in_business"] / 50) * 0.3 + (row["audit_score"] / 100) * 0.3
    s = 0.0 + fin * 0.4 + op * 0.25 + comp * 0.25 + mk * 0.1
    return max(0.0, min(1.0, s))


def test_weighted_score_matches_formula(spark):
    from scoreforge.sources import views as V
    from scoreforge.sources.tables import Tables
    cases = V.cases(Tables(spark, "/root/testdata/sf0.001"), with_description=False)
    rows = cases.select("*", X.weighted_score(digits=None).alias("s")).limit(50).collect()
    for r in rows:
        assert abs(r["s"] - _py_score(r.asDict())) < 1e-12
