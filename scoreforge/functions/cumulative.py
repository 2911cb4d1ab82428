"""Exact running sums over a sorted column without one task per group.

A window ``PARTITION BY g ORDER BY x`` moves every row of a group into one
task.  ``ordered_running_sum`` range-partitions the rows by (g, x) and writes
them once to the shared work folder with the number of their slice, so that
every later read sees the same slices: nothing depends on a shuffle being
reused or on sampled bounds coming out alike twice.  Running sums inside a slice
are a window over (g, slice), which holds a bounded number of rows; the
offset of a slice is the total of all earlier slices of its group, from
a (slice x group) aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ordered_slices(df: DataFrame, group: str, order: str, rows_per_partition: int = 2_000_000,
                   min_partitions: int | None = None) -> DataFrame:
    """``df`` (rows unique per group and order) written with ``__slice``, a number rising with (group, order)."""
    spark = df.sparkSession
    table = written(df, "slice-input")
    base = min_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, base, math.ceil(table.count() / rows_per_partition))
    return written(table.repartitionByRange(parts, group, order).withColumn("__slice", F.spark_partition_id()), "slices")


def running_sums(sliced: DataFrame, group: str, order: str, sums: Sequence[str]) -> DataFrame:
    """Adds ``cum_<s>`` and ``next_<order>`` to the rows of ``ordered_slices``."""
    inside = Window.partitionBy(group, "__slice").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.select("*", *[F.sum(s).over(upto).alias(f"__c_{s}") for s in sums],
                          F.lead(order).over(inside).alias("__next"))
    totals = sliced.groupBy("__slice", group).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums],
                                                  F.min(order).alias("__first"))
    slices = Window.partitionBy(group).orderBy("__slice")
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__slice", group,
                            *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums],
                            F.lead("__first").over(slices).alias("__next_first"))
    joined = local.join(offsets, ["__slice", group])
    return joined.select(group, order, *sums,
                         *[(F.col(f"__c_{s}") + F.col(f"__o_{s}")).alias(f"cum_{s}") for s in sums],
                         F.coalesce(F.col("__next"), F.col("__next_first")).alias(f"next_{order}"))


def ordered_running_sum(df: DataFrame, group: str, order: str, sums: Sequence[str],
                        rows_per_partition: int = 2_000_000, min_partitions: int | None = None) -> DataFrame:
    """Adds ``cum_<s>`` (inclusive running sum of each ``s`` ordered by
    ``order`` within ``group``) and ``next_<order>`` (next larger value in
    the group, null for the last) to rows unique per (group, order)."""
    sliced = ordered_slices(df.select(group, order, *sums), group, order, rows_per_partition, min_partitions)
    return running_sums(sliced, group, order, sums)
