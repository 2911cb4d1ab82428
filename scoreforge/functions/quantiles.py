"""Exact quantiles by sketched brackets and one counting pass, all columns at once.

One algorithm at every size.  Rows are (column, value); a grouped sketch (``percentile_approx``)
gives each column a few edges around its wanted ranks.  A grouped pass then counts, per column, the rows
on each edge and between neighbouring ones, and takes the values of the narrow gaps a rank should lie in.
The counts prove where each rank lies, so the result is exact whatever the sketch's
error.  A rank in a gap whose values were not taken goes on with the rows of that gap only:
every round keeps at most a share of the rows, and values only are compared, so infinities and heavy ties
(which sit on the edges) cost no extra round.  Work is one sketch and a handful of
comparisons per value, linear in the columns; what is gathered is at most ``sort_limit`` values per gap.

Values are interpolated linearly between neighbouring order statistics, as
``quantile_cont`` and pandas ``quantile`` do.  Nulls and NaN are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_ACCURACY = 16


def long_form(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(g, x) rows for the given numeric columns, nulls and NaN left out."""
    parts = [F.struct(F.lit(c).alias("g"), F.col(c).cast("double").alias("x")) for c in cols]
    long = df.select(F.explode(F.array(*parts)).alias("r")).select("r.g", "r.x")
    return long.where(F.col("x").isNotNull() & ~F.isnan("x"))


@dataclass
class _Gap:
    """Rows of a group strictly between two values (None: no bound), and the ranks that lie there."""

    group: object
    ranks: list[int]
    size: int
    offset: int = 0                # rows of the group at or below ``low``
    low: float | None = None
    high: float | None = None


#: Edges of a sketch whose ranks differ from group to group.
EVEN = [i / 32 for i in range(33)]


def _edges_asked(gaps: list[_Gap], accuracy: int) -> tuple[list[float], float | None]:
    """Shares to ask of the sketch: both sides of each wanted share, or even ones if there are many; the gap's width."""
    shares = sorted({round((r - g.offset + 0.5) / g.size, 4) for g in gaps for r in g.ranks})
    if len(shares) > 16:
        return EVEN, None
    width = 3 / accuracy
    return sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-width, width)}), 2 * width


def grouped_order_statistics(long: DataFrame, wanted: dict, counts: dict, *, buckets: int = 10_000,
                             sort_limit: int = 100_000) -> dict[tuple, float]:
    """Values of the given ranks per group ``g`` of a (g, x) frame; ``buckets`` is the sketch's accuracy."""
    return _narrowed(long, [_Gap(group, sorted(set(ranks)), counts[group]) for group, ranks in wanted.items()], buckets, sort_limit)


def _narrowed(long: DataFrame, gaps: list[_Gap], buckets: int, sort_limit: int) -> dict[tuple, float]:
    """Values of the ranks of the gaps, round by round."""
    accuracy = max(buckets, LEAST_ACCURACY)
    spark = long.sparkSession
    kind = long.schema["g"].dataType.simpleString()
    x = F.col("x")
    result: dict[tuple, float] = {}
    while gaps:
        ids = spark.createDataFrame([(i, t.group, t.low, t.high) for i, t in enumerate(gaps)],
                                    f"id int, g {kind}, low double, high double")
        rows = (long.join(F.broadcast(ids), "g")                          # one row per gap
                .where((F.col("low").isNull() | (x > F.col("low"))) & (F.col("high").isNull() | (x < F.col("high"))))
                .select("id", "x"))
        asked, width = _edges_asked(gaps, accuracy)
        found = {r["id"]: sorted(r["e"]) for r in
                 rows.groupBy("id").agg(F.percentile_approx("x", asked, F.lit(accuracy)).alias("e")).collect()}
        # all of a small gap is gathered, else what lies between the two edges around a wanted share
        every = {i: t.size <= sort_limit for i, t in enumerate(gaps)}
        narrow = {i: width is not None and t.size * width <= sort_limit for i, t in enumerate(gaps)}
        edged = spark.createDataFrame([(i, found[i], every[i], narrow[i]) for i in found],
                                      "id int, e array<double>, every boolean, narrow boolean")
        below = F.size(F.filter("e", lambda v: v < x))
        placed = rows.join(F.broadcast(edged), "id").select(
            "id", "x", below.alias("b"), F.array_contains("e", x).alias("on"), "every", "narrow")
        taken = ~F.col("on") & (F.col("every") | (F.col("narrow") & (F.col("b") % 2 == 1)))
        slots = placed.groupBy("id", "b", "on").agg(F.count(F.lit(1)).alias("n"),
                                                    F.sort_array(F.collect_list(F.when(taken, x))).alias("v")).collect()
        left = []
        for i, t in enumerate(gaps):
            own, at = found[i], t.offset
            # values between two edges come before those on the upper one
            for r in sorted((r for r in slots if r["id"] == i), key=lambda r: (r["b"], r["on"])):
                inside = [rank for rank in t.ranks if at <= rank < at + r["n"]]
                if r["on"]:
                    result.update({(t.group, rank): own[r["b"]] for rank in inside})
                elif len(r["v"]) == r["n"]:
                    result.update({(t.group, rank): r["v"][rank - at] for rank in inside})
                elif inside:
                    left.append(_Gap(t.group, inside, r["n"], at, own[r["b"] - 1] if r["b"] else t.low,
                                     own[r["b"]] if r["b"] < len(own) else t.high))
                at += r["n"]
        gaps = left
    return result


def grouped_quantiles(long: DataFrame, probs: Sequence[float], **kw) -> dict[tuple[str, float], float | None]:
    """{(g, p): value} for every group of a (g, x) frame; meant for few groups, such as columns."""
    counts = {r["g"]: r["n"] for r in long.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _interpolate(long, counts, list(counts), probs, **kw)


def _ranks(counts: dict, groups: Sequence, probs: Sequence[float]) -> tuple[dict, dict]:
    """Per group the ranks that the shares lie between, and per (group, share) its two ranks and the place between them."""
    wanted: dict[str, list[int]] = {}
    plan = {}
    for g in groups:
        n = counts.get(g, 0)
        for p in probs:
            if n == 0:
                plan[(g, p)] = None
                continue
            pos = p * (n - 1)
            r0 = int(math.floor(pos))
            r1 = min(r0 + 1, n - 1)
            plan[(g, p)] = (r0, r1, pos - r0)
            wanted.setdefault(g, []).extend([r0, r1])
    return wanted, plan


def _between(plan: dict, stats: dict) -> dict:
    out = {}
    for (g, p), pl in plan.items():
        if pl is None:
            out[(g, p)] = None
            continue
        r0, r1, frac = pl
        x0, x1 = stats[(g, r0)], stats[(g, r1)]
        out[(g, p)] = x0 if x0 == x1 else x0 + (x1 - x0) * frac
    return out


def _interpolate(long, counts, groups, probs, **kw):
    wanted, plan = _ranks(counts, groups, probs)
    return _between(plan, grouped_order_statistics(long, wanted, counts, **kw))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], *, buckets: int = 10_000,
                    sort_limit: int = 100_000) -> dict[tuple[str, float], float | None]:
    """{(column, p): value} with linear interpolation; None for an empty column.

    The first round reads the columns side by side, without a row per column: one pass counts and sketches,
    one counts around the edges and takes the values between them.  Ranks it leaves go on in ``_narrowed``."""
    accuracy = max(buckets, LEAST_ACCURACY)
    width = 3 / accuracy
    shares = sorted(set(probs))
    pairs = [(max(s - width, 0.0), min(s + width, 1.0)) for s in shares] if len(shares) <= 16 else []
    asked = sorted({e for pair in pairs for e in pair}) or EVEN
    x = [_value(c) for c in cols]
    sketched = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(x)],
                      *[F.percentile_approx(v, asked, F.lit(accuracy)).alias(f"e{i}") for i, v in enumerate(x)]).first()
    counts = {c: sketched[f"n{i}"] for i, c in enumerate(cols)}
    wanted, plan = _ranks(counts, list(cols), probs)
    aggs, edges, taken = [], {}, {}
    for i, (c, v) in enumerate(zip(cols, x)):
        if not counts[c]:
            continue
        at = dict(zip(asked, sketched[f"e{i}"]))
        own = edges[c] = sorted(set(at.values()))
        if counts[c] <= sort_limit:                    # gap g lies below edge g; the last one above all edges
            taken[c] = set(range(len(own) + 1))
        else:
            taken[c] = {g for g in range(1, len(own)) for a, b in pairs if at[a] <= own[g - 1] and own[g] <= at[b]} \
                if 2 * width * counts[c] <= sort_limit else set()
        aggs += [F.count_if(v < F.lit(e)).alias(f"lt{i}_{j}") for j, e in enumerate(own)]
        aggs += [F.count_if(v <= F.lit(e)).alias(f"le{i}_{j}") for j, e in enumerate(own)]
        inside = F.lit(False)
        for g in taken[c]:
            inside = inside | ((v > F.lit(own[g - 1]) if g else F.lit(True)) & (v < F.lit(own[g]) if g < len(own) else F.lit(True)))
        aggs.append(F.collect_list(F.when(inside, v)).alias(f"v{i}"))
    stats: dict[tuple, float] = {}
    left = []
    placed = df.agg(*aggs).first() if aggs else None
    for i, c in enumerate(cols):
        if c not in edges:
            continue
        own, n, values = edges[c], counts[c], sorted(placed[f"v{i}"])
        ranks, used = sorted(set(wanted[c])), 0
        for g in range(len(own) + 1):
            start = placed[f"le{i}_{g - 1}"] if g else 0
            stop = placed[f"lt{i}_{g}"] if g < len(own) else n
            inside = [r for r in ranks if start <= r < stop]
            if g in taken[c]:
                stats.update({(c, r): values[used + r - start] for r in inside})
                used += stop - start
            elif inside:
                left.append(_Gap(c, inside, stop - start, start, own[g - 1] if g else None, own[g] if g < len(own) else None))
            if g < len(own):
                stats.update({(c, r): own[g] for r in ranks if stop <= r < placed[f"le{i}_{g}"]})
    if left:
        stats.update(_narrowed(long_form(df, sorted({g.group for g in left})), left, buckets, sort_limit))
    return _between(plan, stats)


def _value(column: str):
    """The column as a double, null for NaN."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, [column], [0.5])[(column, 0.5)]
