"""Drift operators (D1-D3, D5): reference vs current distributions per column.

Numeric columns: two-sample Kolmogorov-Smirnov statistic and asymptotic
p-value, Wasserstein-1 distance divided by the reference population std, and
PSI over reference deciles.  Categorical columns: chi-square statistic,
Jensen-Shannon distance and PSI.  Both decisions are reported: the p-value (KS or
chi-square) below ``p_threshold``, and the distance (Wasserstein or
Jensen-Shannon) at or above ``distance_threshold``; ``decide`` says
which of them is the column's ``drifted``.  Dataset drift: share of drifted columns reaches
``drift_share``.

A numeric comparison reads its inputs once, into one written table of
(column, value, reference count, current count) in slices by value; row counts, spread,
deciles, PSI, KS and Wasserstein all come from that table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import ordered_slices, running_sums
from ..session import written

EPS = 1e-4


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample KS p-value: Q(sqrt(n1 n2 / (n1 + n2)) * D) with
    Q(l) = 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 l^2), clamped to [0, 1]."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.greatest(F.least(F.lit(2.0) * series, F.lit(1.0)), F.lit(0.0)))


def _long(df: DataFrame, cols: Sequence[str], flag: int, cast: str) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("x"))
                                         for c in cols])).alias("r")) \
        .select("r.column", "r.x", F.lit(flag).alias("cur")).where(F.col("x").isNotNull())


def numeric_drift(ref: DataFrame, cur: DataFrame, cols: Sequence[str], **settings) -> DataFrame:
    """One row per column with KS, Wasserstein, PSI and the drift flags."""
    long = _long(ref, cols, 0, "double").unionByName(_long(cur, cols, 1, "double")).where(~F.isnan("x"))
    return numeric_drift_of(long.groupBy("column", "x").agg(F.sum(1 - F.col("cur")).alias("c_ref"), F.sum("cur").alias("c_cur")),
                            **settings)


def numeric_drift_of(counts: DataFrame, *, p_threshold: float = 0.05, distance_threshold: float = 0.1,
                     decide: str = "distance", psi_bins: int = 10) -> DataFrame:
    """D1 from value counts (column, x, c_ref, c_cur), which add up over any parts of the rows."""
    _known(decide)
    counts = counts.select("column", "x", F.col("c_ref").cast("double"), F.col("c_cur").cast("double"))
    sliced = ordered_slices(counts, "column", "x")
    # one row per column from here on, so these are broadcast
    in_ref = F.when(F.col("c_ref") > 0, F.col("x"))
    finite = F.max(F.abs("x")) < 1e150
    units = sliced.groupBy("column").agg(                    # what sums of values, their gaps and their squares are counted in
        F.when(finite, F.max(F.abs(in_ref))).alias("_in"), F.when(finite, F.max("x") - F.min("x")).alias("_gaps"),
        F.when(finite, F.pow(F.max(in_ref) - F.min(in_ref), 2)).alias("_squares"))
    totals = sliced.join(F.broadcast(units), "column").groupBy("column", "_in", "_gaps", "_squares").agg(
        F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"), _sum(F.col("c_ref") * F.col("x"), "_in").alias("_sum"))
    run = running_sums(sliced, "column", "x", ["c_ref", "c_cur"]).join(F.broadcast(totals), "column")
    gap = F.abs(F.try_divide("cum_c_ref", "n_ref") - F.try_divide("cum_c_cur", "n_cur"))
    off = F.col("x") - F.try_divide("_sum", "n_ref")
    probs = [i / psi_bins for i in range(1, psi_bins)]
    ranks = [(p, F.floor(F.lit(p) * (F.col("n_ref") - 1)).cast("double")) for p in probs]
    stats = run.groupBy("column", "n_ref", "n_cur", "_gaps", "_squares").agg(
        F.max(gap).alias("ks_statistic"),
        _sum(F.when(F.col("next_x").isNotNull(), (F.col("next_x") - F.col("x")) * gap).otherwise(0.0), "_gaps")
        .alias("wasserstein"),
        # reference spread (population std) for the normalised distance
        F.sqrt(F.try_divide(_sum(F.col("c_ref") * off * off, "_squares"), F.first("n_ref"))).alias("ref_std"),
        # the two order statistics around each reference decile
        *[F.min(F.when(F.col("cum_c_ref") > r + k, F.col("x"))).alias(f"_q{i}_{k}")
          for i, (_, r) in enumerate(ranks) for k in (0, 1)])
    edges = [F.col(f"_q{i}_0") + (F.coalesce(F.col(f"_q{i}_1"), F.col(f"_q{i}_0")) - F.col(f"_q{i}_0"))
             * (F.lit(p) * (F.col("n_ref") - 1) - r) for i, (p, r) in enumerate(ranks)]
    stats = written(stats.select("column", "n_ref", "n_cur", "ks_statistic", "wasserstein", "ref_std",
                                 F.array(*edges).alias("edges")), "drift-columns")
    binned = sliced.join(F.broadcast(stats.select("column", "edges")), "column").select(
        "column", "c_ref", "c_cur", F.size(F.filter("edges", lambda e: F.col("x") > e)).alias("bin"))
    psi = _psi(binned, "column", "bin", "c_ref", "c_cur")
    out = (stats.join(F.broadcast(psi), "column")
           .withColumn("ks_p_value", ks_pvalue(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur")))
           .withColumn("wasserstein_norm",
                       F.when(F.col("ref_std") > 0, F.col("wasserstein") / F.col("ref_std"))
                       .otherwise(F.when(F.col("wasserstein") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))))
    return out.select(
        "column", F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"),
        "ks_statistic", "ks_p_value", "wasserstein_norm", "psi",
        *_decisions(decide, "ks", "ks_p_value", p_threshold, "wasserstein", "wasserstein_norm", distance_threshold))


def _sum(term: Column, unit: str) -> Column:
    """Sum of doubles that is the same in any order of the rows: exact, in parts of ``unit`` (a group's constant) to 24 places.

    Where the unit is null or next to zero the doubles themselves are added."""
    u = F.col(unit)
    usable = F.coalesce(u > 1e-290, F.lit(False))
    exact = F.sum(F.when(usable, term / u).cast("decimal(38,24)")).cast("double")
    return F.when(F.first(usable), exact * F.first(u)).otherwise(F.sum(F.when(~usable, term)))


def _known(decide: str) -> None:
    if decide not in ("distance", "p_value"):
        raise ValueError(f"unknown decision {decide!r}")


def _decisions(decide: str, p_test: str, p_value: str, p_threshold: float, test: str, distance: str,
               threshold: float) -> list[Column]:
    """Both flags, and the test, score and flag that ``decide`` names."""
    by_p, by_distance = F.col(p_value) < F.lit(p_threshold), F.col(distance) >= F.lit(threshold)
    use_p = decide == "p_value"
    return [by_p.alias("drifted_p"), by_distance.alias("drifted_distance"), F.lit(p_test if use_p else test).alias("stattest"),
            F.col(p_value if use_p else distance).alias("drift_score"), (by_p if use_p else by_distance).alias("drifted")]


def _psi(binned: DataFrame, group: str, key: str, ref: str, cur: str) -> DataFrame:
    """PSI = sum (p_cur - p_ref) * ln(p_cur / p_ref), shares floored at 1e-4."""
    c = binned.groupBy(group, key).agg(F.sum(ref).alias("a"), F.sum(cur).alias("b"))
    tot = c.groupBy(group).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p = c.join(F.broadcast(tot), group) \
        .withColumn("pa", F.greatest(F.try_divide("a", "na"), F.lit(EPS))) \
        .withColumn("pb", F.greatest(F.try_divide("b", "nb"), F.lit(EPS)))
    return p.groupBy(group).agg(F.sum((F.col("pb") - F.col("pa")) * F.log(F.col("pb") / F.col("pa"))).alias("psi"))


def _chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (regularised gamma Q)."""
    if x is None or dof is None or dof <= 0 or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    if z < a + 1:  # series for P
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    # continued fraction for Q (Lentz)
    tiny = 1e-300
    b = z + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    i = 1
    while True:
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        i += 1
        if abs(delta - 1) < 1e-15 or i > 10000:
            break
    return min(1.0, math.exp(-z + a * math.log(z) - math.lgamma(a)) * h)


def _chi2_batch(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_chi2_sf(float(s), int(d)) if pd.notna(s) and pd.notna(d) else float("nan")
                      for s, d in zip(stat, dof)])


def chi2_pvalue(stat: Column, dof: Column) -> Column:
    """Chi-square survival function as a pandas UDF over Arrow batches (the
    input is one row per drift column, so it never sees data rows)."""
    return F.pandas_udf(_chi2_batch, "double")(stat, dof)


def categorical_drift(ref: DataFrame, cur: DataFrame, cols: Sequence[str], **settings) -> DataFrame:
    """Chi-square on the dataset x value table, Jensen-Shannon distance
    (natural log) and PSI over the union of values."""
    long = _long(ref, cols, 0, "string").unionByName(_long(cur, cols, 1, "string"))
    return categorical_drift_of(long.groupBy("column", "x").agg(F.sum(1 - F.col("cur")).alias("c_ref"),
                                                                F.sum("cur").alias("c_cur")), **settings)


def categorical_drift_of(counts: DataFrame, *, p_threshold: float = 0.05, distance_threshold: float = 0.1,
                         decide: str = "distance") -> DataFrame:
    """D2 from value counts (column, x, c_ref, c_cur)."""
    _known(decide)
    c = counts.select("column", "x", F.col("c_ref").cast("double").alias("a"), F.col("c_cur").cast("double").alias("b"))
    tot = c.groupBy("column").agg(F.sum("a").alias("n_ref"), F.sum("b").alias("n_cur"), F.count(F.lit(1)).alias("k"))
    j = c.join(F.broadcast(tot), "column")
    n = F.col("n_ref") + F.col("n_cur")
    ea = (F.col("a") + F.col("b")) * F.col("n_ref") / n
    eb = (F.col("a") + F.col("b")) * F.col("n_cur") / n
    pa, pb = F.col("a") / F.col("n_ref"), F.col("b") / F.col("n_cur")
    m = (pa + pb) / 2
    kl = lambda p: F.when(p > 0, p * F.log(p / m)).otherwise(0.0)
    psa, psb = F.greatest(pa, F.lit(EPS)), F.greatest(pb, F.lit(EPS))
    agg = j.groupBy("column", "n_ref", "n_cur", "k").agg(
        F.sum((F.col("a") - ea) * (F.col("a") - ea) / ea + (F.col("b") - eb) * (F.col("b") - eb) / eb)
        .alias("chi2_statistic"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(F.lit(0.5) * kl(pa) + F.lit(0.5) * kl(pb)))).alias("js_distance"),
        F.sum((psb - psa) * F.log(psb / psa)).alias("psi"))
    agg = agg.withColumn("dof", (F.col("k") - 1).cast("int"))
    agg = agg.withColumn("chi2_p_value", chi2_pvalue(F.col("chi2_statistic"), F.col("dof")))
    return agg.select(
        "column", F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"),
        "chi2_statistic", "dof", "chi2_p_value", "js_distance", "psi",
        *_decisions(decide, "chisquare", "chi2_p_value", p_threshold, "jensenshannon", "js_distance", distance_threshold))


def dataset_drift(*column_results: DataFrame, drift_share: float = 0.5) -> DataFrame:
    """D3: one row: columns checked, drifted (by the decision and by p-value), share and the dataset flag."""
    allc = None
    for r in column_results:
        part = r.select("column", "drifted", "drifted_p")
        allc = part if allc is None else allc.unionByName(part)
    return allc.agg(F.count(F.lit(1)).alias("n_columns"),
                    F.count_if("drifted").alias("n_drifted"), F.count_if("drifted_p").alias("n_drifted_p"),
                    F.avg(F.col("drifted").cast("double")).alias("share_drifted")) \
        .withColumn("dataset_drift", F.col("share_drifted") >= F.lit(drift_share))


class DayCounts:
    """Value counts per day, kept as a table: (column, x, v, n) by ``ds``, ``x`` for numbers and ``v`` for categories.

    Counts add up, so any two spans of days are compared from the kept rows alone; no table row is read twice.
    History goes in once (``backfill``); after that a day's job reads its own rows and replaces its own partition
    (``put``), which is the same however often it runs.  A day put later takes the place of the one backfilled.
    """

    SCHEMA = "column string, x double, v string, n long, ds string"

    def __init__(self, spark, path: str, numeric: Sequence[str], categorical: Sequence[str] = ()):
        self.spark, self.path, self.numeric, self.categorical = spark, path, list(numeric), list(categorical)

    def counts(self, df: DataFrame, *by: str) -> DataFrame:
        """One pass: counts of every value of every column; nulls and NaN are left out."""
        entry = lambda c, x, v: F.struct(F.lit(c).alias("column"), x.alias("x"), v.alias("v"))
        none = F.lit(None)
        parts = [entry(c, F.col(c).cast("double"), none.cast("string")) for c in self.numeric]
        parts += [entry(c, none.cast("double"), F.col(c).cast("string")) for c in self.categorical]
        long = df.select(*by, F.inline(F.array(*parts))).where((F.col("x").isNotNull() & ~F.isnan("x")) | F.col("v").isNotNull())
        return long.groupBy(*by, "column", "x", "v").agg(F.count(F.lit(1)).alias("n"))

    def backfill(self, df: DataFrame, day: Column) -> None:
        """Counts of all days of ``df``, sorted by day within the files, so that a span of days reads its row groups."""
        rows = self.counts(df.withColumn("ds", day), "ds")
        rows.repartitionByRange("ds", "column", "x", "v").sortWithinPartitions("ds").write.mode("overwrite").parquet(
            f"{self.path}/history")

    def put(self, df: DataFrame, ds: str) -> None:
        """Counts of one day's rows, in place of what that day had."""
        self.counts(df).write.mode("overwrite").parquet(f"{self.path}/days/ds={ds}")

    def put_all(self, df: DataFrame, day: Column) -> None:
        """Several days at once; only the days present are replaced."""
        rows = self.counts(df.withColumn("ds", day), "ds").repartitionByRange("ds", "column", "x", "v")   # few files a day
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("ds").parquet(f"{self.path}/days"))

    def read(self) -> DataFrame:
        days = self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.path}/days").parquet(f"{self.path}/days")
        history = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/history")
        put = days.select("ds").distinct()                   # one row per partition
        return history.join(F.broadcast(put), "ds", "left_anti").unionByName(days)

    def compared(self, since: str, until: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(numeric, categorical) counts of the days before ``since`` and from it (to ``until``), ready for D1 and D2."""
        rows = self.read() if until is None else self.read().where(F.col("ds") <= until)
        current = F.col("ds") >= since
        sums = (F.sum(F.when(current, 0).otherwise(F.col("n"))).alias("c_ref"),
                F.sum(F.when(current, F.col("n")).otherwise(0)).alias("c_cur"))
        number = rows.where("v is null").groupBy("column", "x").agg(*sums)
        return number, rows.where("v is not null").groupBy("column", F.col("v").alias("x")).agg(*sums)
