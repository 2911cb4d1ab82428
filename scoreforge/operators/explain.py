"""Explanation operators on per-row contribution arrays.

Contributions travel as one ``array<struct<feature, value, shap>>`` column per
scored row, so the per-row top-k lists, the record and the text (W1, W3,
E4, E5) are narrow array expressions: no shuffle, no window.  Only the global
importance (A7) explodes and aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X

#: Entries whose numbered names are one literal.
NUMBERED = 64
CONTRIB_TYPE = "array<struct<feature:string,value:double,shap:double>>"


def linear_contributions(df: DataFrame, id_col: str, weights: Mapping[str, float],
                         means: Mapping[str, float] | None = None, base: float = 0.5,
                         out: str = "contrib") -> DataFrame:
    """``w_i * (x_i - mean_i)`` per feature as an array column.

    The means are a fitted state of one aggregate pass (a handful of numbers);
    ``prediction`` is ``base + sum(contributions)`` so additivity holds exactly.
    """
    cols = list(weights)
    if means is None:
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
        means = {c: row[c] for c in cols}
    shaps = {c: F.lit(weights[c]) * (F.col(c).cast("double") - F.lit(means[c])) for c in cols}
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), shaps[c].alias("shap"))
             for c in cols]
    arr = F.array(*items)
    pred = F.lit(float(base))
    for c in cols:  # same left-to-right order as summing the array
        pred = pred + shaps[c]
    return df.select(F.col(id_col).alias("id"), arr.alias(out), F.lit(float(base)).alias("expected_value"),
                     pred.alias("prediction"))


def sort_by_abs(contrib: Column) -> Column:
    """Entries ordered by |shap| desc, then feature name: one lambda to add the
    key, then the native ``sort_array``; the result keeps the key field ``k``
    first and the entry fields after it."""
    keyed = F.transform(contrib, lambda c: F.struct((-F.abs(c["shap"])).alias("k"), c["feature"].alias("feature"),
                                                    c["value"].alias("value"), c["shap"].alias("shap")))
    return F.sort_array(keyed)


def _strip(sorted_arr: Column) -> Column:
    return F.transform(sorted_arr, lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value"),
                                                      c["shap"].alias("shap")))


def _sign(sorted_arr: Column, positive: bool, k: int | None) -> Column:
    keep = F.filter(sorted_arr, (lambda c: c["shap"] > 0) if positive else (lambda c: c["shap"] < 0))
    return F.slice(keep, 1, k) if k is not None else keep


def top_positive(contrib: Column, k: int = 3) -> Column:
    return _strip(_sign(sort_by_abs(contrib), True, k))


def top_negative(contrib: Column, k: int = 3) -> Column:
    return _strip(_sign(sort_by_abs(contrib), False, k))


def by_abs(contrib: Column) -> Column:
    return _strip(sort_by_abs(contrib))


def topk_signed(df: DataFrame, contrib: str = "contrib", k: int = 3) -> DataFrame:
    """W1 in long form: (id, sign, rank, feature, value, shap); zero is in neither."""
    srt = df.select("id", sort_by_abs(F.col(contrib)).alias("__s"))
    sides = F.array(
        F.struct(F.lit("positive").alias("sign"), _sign(F.col("__s"), True, k).alias("items")),
        F.struct(F.lit("negative").alias("sign"), _sign(F.col("__s"), False, k).alias("items")))
    return (srt.select("id", F.inline(sides))
            .select("id", "sign", F.posexplode("items").alias("pos", "item"))
            .select("id", "sign", (F.col("pos") + 1).alias("rank"), "item.feature", "item.value", "item.shap"))


def contribution_list(contrib: Column, k: int = 3) -> Column:
    """Both top-k sets together, ordered by |shap| desc (bounded at 2k)."""
    srt = sort_by_abs(contrib)
    return _strip(F.sort_array(F.concat(_sign(srt, True, k), _sign(srt, False, k))))


def contrib_text(arr: Column) -> Column:
    """Array of contributions as comparable text ``feature:value:shap|...``."""
    return F.array_join(F.transform(arr, lambda c: F.concat_ws(
        ":", c["feature"], _fmt(c["value"], 6), _fmt(c["shap"], 6))), "|")


def _fmt(x: Column, digits: int) -> Column:
    """Fixed-point text of the binary-rounded value (Java's formatter rounds the
    shortest decimal text, which can sit on a false tie)."""
    # the binary-rounded value is the double nearest a d-decimal number, so the DECIMAL cast is exact and
    # prints it in fixed point (cheaper than java.util.Formatter)
    return (X.round_binary(x, digits) + F.lit(0.0)).cast(f"decimal(38,{digits})").cast("string")


def _text_from(prediction: Column, pos: Column, neg: Column, label: str, thresholds, names_shown: int) -> Column:
    head = F.concat(F.lit(f"{label}: "), _fmt(prediction, 3), F.lit(" ("), X.tier(prediction, thresholds),
                    F.lit(" confidence)"))
    pos_names = F.slice(pos["feature"], 1, names_shown)
    neg_names = F.slice(neg["feature"], 1, names_shown)
    pos_txt = F.when(F.size(pos_names) > 0, F.concat(F.lit("Main positive factors: "), F.array_join(pos_names, ", ")))
    neg_txt = F.when(F.size(neg_names) > 0, F.concat(F.lit("Main risk factors: "), F.array_join(neg_names, ", ")))
    return F.concat_ws("; ", head, pos_txt, neg_txt)


def explanation_text(prediction: Column, contrib: Column, label: str = "Score",
                     thresholds=K.TIERS, names_shown: int = 2, k: int = 3) -> Column:
    """``<label>: 0.742 (High confidence); Main positive factors: a, b;
    Main risk factors: c, d``; a part is left out when its side is empty."""
    srt = sort_by_abs(contrib)
    return _text_from(prediction, _sign(srt, True, k), _sign(srt, False, k), label, thresholds, names_shown)


def explanation_record(df: DataFrame, contrib: str = "contrib", id_col: str = "id",
                       prediction: str = "prediction", expected: str = "expected_value",
                       label: str = "Score", k: int = 3) -> DataFrame:
    """E5: one explanation per row (arrays kept as arrays).  The sorted
    entries and both sign lists are computed once per row and reused."""
    srt = df.select(F.col(id_col), F.col(prediction), F.col(expected), sort_by_abs(F.col(contrib)).alias("__s"))
    sides = srt.select("*", _sign(F.col("__s"), True, k).alias("__pos"), _sign(F.col("__s"), False, k).alias("__neg"))
    return sides.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit(K.UNKNOWN_INSTANCE)).alias("instance_id"),
        F.col(prediction).alias("prediction"),
        F.col(expected).alias("expected_value"),
        _strip(F.sort_array(F.concat("__pos", "__neg"))).alias("feature_contributions"),
        _strip(F.col("__pos")).alias("top_positive_features"),
        _strip(F.col("__neg")).alias("top_negative_features"),
        _text_from(F.col(prediction), F.col("__pos"), F.col("__neg"), label, K.TIERS, 2).alias("explanation_summary"),
    )


def align_names(shap: Column, values: Column, names: Sequence[str]) -> Column:
    """Contributions array with names; when the name list and the shap
    array differ in length the names become ``feature_<i>``; the values are
    zero-padded / truncated to the shap length."""
    n = F.size(shap)
    name_arr = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    # whole arrays side by side: no function call per entry up to NUMBERED entries
    few = F.array(*[F.lit(f"feature_{i}") for i in range(NUMBERED)])
    numbered = F.when(n <= NUMBERED, F.slice(few, 1, n)).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("feature_"), i.cast("string"))))
    own = F.when(n == len(names), name_arr).otherwise(numbered)
    lacking = n - F.size(values)
    padded = F.when(lacking > 0, F.concat(values, F.array_repeat(F.lit(0.0), lacking))).otherwise(F.slice(values, 1, n))
    return F.when(n == 0, F.array().cast(CONTRIB_TYPE)).otherwise(
        F.arrays_zip(own.alias("feature"), padded.alias("value"), shap.alias("shap")).cast(CONTRIB_TYPE))
