"""Registered monitoring queries (T1-T4) over events (value / 100 read as
latency seconds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as T
from .queries_core import _round_doubles, _t
from .registry import query


def latency():
    return F.col("value") / 100.0


@query("t1_request_rate")
def t1(spark, sf_dir):
    ev = _t(spark, sf_dir).events
    return _round_doubles(T.request_rate(ev, "ts", "event_type", "1 hour", "15 minutes"))


@query("t2_latency_histogram")
def t2(spark, sf_dir):
    ev = _t(spark, sf_dir).events
    return T.latency_histogram(ev, latency(), ["event_type"])


@query("t3_latency_p95")
def t3(spark, sf_dir):
    ev = _t(spark, sf_dir).events
    return _round_doubles(T.latency_quantile(ev, "ts", latency(), "event_type", "1 day"))


@query("t3_latency_5min")
def t3_5min(spark, sf_dir):
    """The histogram p95 at the alert's own window of five minutes."""
    ev = _t(spark, sf_dir).events
    return _round_doubles(T.latency_quantile(ev, "ts", latency(), "event_type"))


@query("t3_latency_exact")
def t3_exact(spark, sf_dir):
    ev = _t(spark, sf_dir).events
    return _round_doubles(T.latency_percentile(ev, "ts", latency(), "event_type", "1 hour"))


@query("t4_sustained_alert")
def t4(spark, sf_dir):
    ev = _t(spark, sf_dir).events
    return T.sustained_alert(ev, "ts", latency(), "event_type", threshold=0.5)
