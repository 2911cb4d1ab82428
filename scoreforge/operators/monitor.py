"""Request monitoring (T1-T4) over an events table: rates per window,
cumulative latency histograms, histogram-interpolated p95 and the
sustained-breach alert.  The same functions run on a stream (T7)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import written

TS_TEXT = "yyyy-MM-dd HH:mm:ss"
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def interval_seconds(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s*", text)
    if not m:
        raise ValueError(f"unsupported interval {text!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def bound_label(b: float) -> str:
    return "+Inf" if b == float("inf") else repr(float(b))


def request_rate(events: DataFrame, ts: str, key: str, size: str = "5 minutes", slide: str | None = "1 minute") -> DataFrame:
    """Requests and requests per second per key and window (tumbling when
    ``slide`` is None).  Partial aggregation per (window, key) before the
    shuffle; the shuffle carries windows x keys, not events."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    secs = interval_seconds(size)
    return (events.groupBy(w.alias("window"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
            .select(F.date_format("window.start", TS_TEXT).alias("window_start"),
                    F.date_format("window.end", TS_TEXT).alias("window_end"), key, "n",
                    (F.col("n") / F.lit(float(secs))).alias("rate")))


def _bucket_aggs(value: Column, bounds: Sequence[float]) -> list[Column]:
    return [F.count_if(value <= F.lit(float(b))).alias(f"__le{i}") for i, b in enumerate(bounds)] + \
           [F.count(value).alias("__total")]


def _cum_array(bounds: Sequence[float]) -> Column:
    return F.array(*[F.col(f"__le{i}") for i in range(len(bounds))])


def latency_histogram(events: DataFrame, value: Column, keys: Sequence[Column | str],
                      bounds: Sequence[float] = K.LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts at fixed upper bounds (``le``), +Inf = total."""
    agg = events.groupBy(*keys).agg(*_bucket_aggs(value, bounds))
    items = [F.struct(F.lit(bound_label(b)).alias("le"), F.col(f"__le{i}").alias("count"))
             for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("__total").alias("count"))]
    return agg.select(*[c for c in agg.columns if not c.startswith("__")], F.inline(F.array(*items)))


def histogram_quantile(q: float, cum: Column, total: Column, bounds: Sequence[float]) -> Column:
    """Quantile from cumulative bucket counts, interpolated inside the bucket
    (lower edge 0 for the first bucket); past the last finite bound the last
    finite bound is returned; no observations give null."""
    b = F.array(*[F.lit(float(x)) for x in bounds])
    rank = F.lit(float(q)) * total
    idx = F.array_position(F.transform(cum, lambda c: c >= rank), True).cast("int")  # 1-based, 0 = none
    last = F.lit(float(bounds[-1]))
    start = F.when(idx == 1, F.lit(0.0)).otherwise(F.element_at(b, F.greatest(idx - 1, F.lit(1))))
    end = F.element_at(b, F.greatest(idx, F.lit(1)))
    before = F.when(idx == 1, F.lit(0)).otherwise(F.element_at(cum, F.greatest(idx - 1, F.lit(1))))
    cnt = F.element_at(cum, F.greatest(idx, F.lit(1))) - before
    inside = start + (end - start) * ((rank - before) / cnt)
    first_nonpos = (idx == 1) & (F.lit(float(bounds[0])) <= 0)
    return (F.when(total == 0, F.lit(None).cast("double"))
            .when(idx == 0, last)
            .when(first_nonpos, F.lit(float(bounds[0])))
            .otherwise(inside))


def latency_quantile(events: DataFrame, ts: str, value: Column, key: str, size: str = "5 minutes",
                     slide: str | None = None, q: float = 0.95,
                     bounds: Sequence[float] = K.LATENCY_BOUNDS) -> DataFrame:
    """Per key and window, the histogram-interpolated quantile."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    agg = events.groupBy(w.alias("window"), F.col(key)).agg(*_bucket_aggs(value, bounds))
    return agg.select(F.date_format("window.start", TS_TEXT).alias("window_start"), key,
                      F.col("__total").alias("total"),
                      histogram_quantile(q, _cum_array(bounds), F.col("__total"), bounds).alias(f"p{int(q * 100)}"))


def latency_percentile(events: DataFrame, ts: str, value: Column, key: str, size: str = "5 minutes", q: float = 0.95) -> DataFrame:
    """T3, exact form: the interpolated percentile of the raw values per key and
    window (``percentile`` merges value counts, so a task holds the distinct values of its windows)."""
    return events.groupBy(F.window(F.col(ts), size).alias("window"), F.col(key)).agg(
        F.count(value).alias("total"), F.percentile(value, F.lit(float(q))).alias(f"p{int(q * 100)}")).select(
        F.date_format("window.start", TS_TEXT).alias("window_start"), key, "total", f"p{int(q * 100)}")


def sustained_alert(events: DataFrame, ts: str, value: Column, key: str, threshold: float = 0.5,
                    lookback: str = "5 minutes", every: str = "1 minute", hold: str = "5 minutes",
                    q: float = 0.95, bounds: Sequence[float] = K.LATENCY_BOUNDS) -> DataFrame:
    """T4: every ``every`` the quantile over the last ``lookback`` is compared
    with ``threshold`` (strict); an alert fires once breaches have held for
    ``hold`` (first and last breaching evaluation that far apart).  A minute
    without data ends a run.  Runs are merged from summaries of time slices
    (``merged_runs``), so an endpoint holding all rows is many small groups."""
    step = interval_seconds(every)
    need = interval_seconds(hold) // step
    evals = (events.groupBy(F.window(F.col(ts), lookback, every).alias("window"), F.col(key))
             .agg(*_bucket_aggs(value, bounds))
             .select(F.unix_seconds(F.col("window.end").cast("timestamp")).alias("at"), key,
                     histogram_quantile(q, _cum_array(bounds), F.col("__total"), bounds).alias("qv")))
    breach = evals.where(F.col("qv") > F.lit(float(threshold))).select(key, F.floor(F.col("at") / step).alias("slot"))
    fired = merged_runs(breach, key, "slot").where(F.col("last") - F.col("first") >= F.lit(need))
    text = lambda slot, more=0: F.date_format(F.timestamp_seconds(slot * step + more), TS_TEXT)
    return fired.select(key, text(F.col("first")).alias("run_start"), text(F.col("last")).alias("run_end"),
                        (F.col("last") - F.col("first") + 1).alias("n_evaluations"),
                        text(F.col("first"), interval_seconds(hold)).alias("fired_at"))


def merged_runs(slots: DataFrame, key: str, slot: str, fan: int = 64) -> DataFrame:
    """(key, first, last): maximal runs of consecutive ``slot`` numbers per key, from mergeable summaries.

    A slice of ``fan`` slots is summed up by its runs: those that touch neither end are final, and at most two are
    open (a prefix and a suffix, or one run through the whole slice).  The open ones of ``fan`` slices are combined
    into a slice of the next width, and so on until one slice holds the whole time range.  The
    combination is associative; a group never holds more than 2 ``fan`` rows, whatever share of them a key has.
    A null key is a key like any other; null slots are left out and repeated ones count once."""
    rows = written(slots.where(F.col(slot).isNotNull()).select(F.col(key), F.col(slot).cast("long").alias("first"),
                                                               F.col(slot).cast("long").alias("last")).distinct(), "alert-slots")
    span = rows.agg(F.min("first").alias("a"), F.max("first").alias("b")).first()
    closed, width = rows.where("false"), 1
    while span["a"] is not None:
        width *= fan
        since, until = F.col("first") - span["a"], F.col("last") - span["a"]
        rows = rows.groupBy(key, F.floor(since / width).alias("slice")).agg(
            F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
        rows = rows.select(key, F.inline(_joined(F.col("runs"))))
        if span["b"] - span["a"] < width:
            break                                            # one slice holds everything: nothing is open
        rows = written(rows, "alert-runs")
        is_open = (since % width == 0) | ((until + 1) % width == 0)
        closed = closed.unionByName(rows.where(~is_open))
        rows = rows.where(is_open)
    return closed.unionByName(rows)


def _joined(runs: Column) -> Column:
    """Sorted (first, last) runs with adjoining ones made one."""
    def add(done, r):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["first"].alias("first"), r["last"].alias("last"))
        return F.when((F.size(done) > 0) & (last["last"] + 1 == r["first"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(
            F.concat(done, F.array(r)))
    return F.aggregate(runs, F.array().cast("array<struct<first: bigint, last: bigint>>"), add)
