"""Ordering operators: ranked importance (W2).  Per-row top-k (W1, W3) is in
``explain`` as array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_features(importance: DataFrame, score: str = "mean_abs_shap", name: str = "feature",
                  n: int | None = 10) -> DataFrame:
    """Features by importance, descending, ties by name, with a 1-based rank.

    With ``n`` the top n come from TakeOrderedAndProject (per-task top-n, no
    global sort); the rank window then runs over at most n rows.  Without
    ``n`` the ranking needs one global order, fine for a per-feature table.
    """
    order = [F.desc(score), F.asc(name)]
    top = importance.orderBy(*order)
    if n is not None:
        top = top.limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
