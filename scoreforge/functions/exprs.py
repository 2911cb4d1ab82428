"""Column-expression builders (all JVM-side, no UDFs).

Each helper returns a ``Column`` so callers can fold several of them into one
projection that stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def round_binary(c: str | Column, digits: int) -> Column:
    """Round half away from zero on the binary value: ``round(x * 10^d) / 10^d``.

    Spark's ``round(x, d)`` rounds the shortest decimal text of ``x``, which
    can look like a tie when the binary value is not one; scaling first makes
    the result equal to DuckDB's and to correct rounding of the double.
    """
    scale = float(10 ** digits)
    return F.round(col(c) * F.lit(scale), 0) / F.lit(scale)


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round for comparisons across engines; ``+ 0.0`` turns -0.0 into 0.0."""
    return round_binary(c, digits) + F.lit(0.0)


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields null on a zero or null denominator (ANSI-safe)."""
    return F.when(den != 0, num / den)


def clip(c: str | Column, lo=None, hi=None) -> Column:
    """Clamp into [lo, hi]; null and NaN pass through unchanged.

    ``least``/``greatest`` skip nulls and treat NaN as the largest value, so a
    bare ``greatest(least(x, hi), lo)`` would turn a null or NaN into a bound.
    """
    x = col(c)
    out = x
    if hi is not None:
        out = F.least(out, lit_or_col(hi))
    if lo is not None:
        out = F.greatest(out, lit_or_col(lo))
    missing = x.isNull() | F.isnan(x.cast("double"))
    return F.when(missing, x).otherwise(out)


def tier(c: str | Column, thresholds: Sequence[tuple[float, str]] = K.TIERS,
         default: str = K.TIER_DEFAULT) -> Column:
    """Strict ``>`` ladder on the unrounded value; first matching step wins."""
    x = col(c)
    expr = None
    for bound, label in thresholds:
        expr = (F.when(x > F.lit(bound), label) if expr is None
                else expr.when(x > F.lit(bound), label))
    return F.lit(default) if expr is None else expr.otherwise(default)


def round_score(c: str | Column, digits: int = 4) -> Column:
    """P10: output rounding of a score (half away from zero, binary value)."""
    return round_binary(c, digits)


def hash_int(key: str | Column) -> Column:
    """First 8 hex digits of md5(key as text) read as an integer (0 .. 2^32-1).

    The same number comes out of DuckDB and Python, so splits and picks built
    on it can be checked outside Spark.
    """
    text = col(key).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_mod(key: str | Column, n: int) -> Column:
    return F.pmod(hash_int(key), F.lit(n))


def literal_map(mapping: Mapping) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def map_lookup(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Literal map lookup; a key outside the map gives ``default`` (null if None)."""
    v = F.try_element_at(literal_map(mapping), col(c))
    return v if default is None else F.coalesce(v, F.lit(default))


def map_join(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str, out: str, default=None) -> DataFrame:
    """The lookup for a map held as data: a left equi-join on unique keys (Spark broadcasts a small map)."""
    pairs = mapping.select(F.col(key).alias("__key"), F.col(value).alias("__value")).dropDuplicates(["__key"])
    found = F.col("__value") if default is None else F.coalesce("__value", F.lit(default))
    return df.join(pairs, df[column] == F.col("__key"), "left").withColumn(out, found).drop("__key", "__value")


def pick(options: Sequence[str], index: Column) -> Column:
    """``options[index]`` for a zero-based integer column."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def sum_columns(cols: Sequence[Column]) -> Column:
    """Left-to-right sum, the same association order as a Python loop."""
    return reduce(lambda a, b: a + b, cols)


def weighted_score(spec=K.SCORE_SPEC, maps=K.SCORE_MAPS, lo: float = 0.0, hi: float = 1.0,
                   digits: int | None = 4) -> Column:
    """Fold a (group, group weight, column, transform, scale, weight) spec into one
    expression: each group is a weighted sum of normalised terms, the score a
    weighted sum of groups, clamped to [lo, hi] and rounded."""
    groups: dict[str, tuple[float, list[Column]]] = {}
    for group, gw, name, transform, scale, w in spec:
        x = F.col(name)
        if transform == "ratio":
            term = (x / F.lit(scale)) * F.lit(w)
        elif transform == "inverse":
            term = (F.lit(1.0) - x / F.lit(scale)) * F.lit(w)
        elif transform.startswith("map:"):
            term = map_lookup(x, maps[transform[4:]]) * F.lit(w)
        else:
            raise ValueError(f"unknown transform {transform!r}")
        groups.setdefault(group, (gw, []))[1].append(term)
    parts = [sum_columns(terms) * F.lit(gw) for gw, terms in groups.values()]
    score = sum_columns(parts)
    score = clip(score, lo, hi)
    return round_binary(score, digits) if digits is not None else score


def render_description(key: str | Column, business: str = "business_type", region: str = "region",
                       margin: str = "profitability_margin", level: str = "compliance_level") -> Column:
    """Fill one of the description templates from the row.

    The template and the performance word are picked by the key's md5 number
    (template = h % 3, word = (h div 3) % 3) so that the text is reproducible.
    """
    h = hash_int(key)
    word_idx = F.pmod(F.floor(h / 3).cast("long"), F.lit(3))
    perf = None
    for bound, words in K.PERFORMANCE_WORDS:
        w = pick(words, word_idx)
        if bound is None:
            perf = w if perf is None else perf.otherwise(w)
        else:
            cond = F.col(margin) > F.lit(bound)
            perf = F.when(cond, w) if perf is None else perf.when(cond, w)
    comp = map_lookup(level, K.COMPLIANCE_WORDS, K.COMPLIANCE_WORD_DEFAULT)
    b = F.lower(F.col(business))
    r = F.lower(F.col(region))
    t = F.pmod(h, F.lit(3))
    out = None
    for i, (tmpl, order) in enumerate(zip(K.DESCRIPTION_TEMPLATES, K.DESCRIPTION_ARGS)):
        words = [comp if o == "compliance" else perf for o in order]
        text = F.format_string(tmpl, b, r, *words)
        out = F.when(t == i, text) if out is None else out.when(t == i, text)
    return out


def default_id(gid: str | Column, position: str | Column | None = None) -> Column:
    """Missing or empty id -> ``batch_<pos>`` inside a batch, else ``api_request``."""
    g = F.nullif(col(gid), F.lit(""))
    if position is None:
        return F.coalesce(g, F.lit(K.SINGLE_REQUEST_ID))
    return F.coalesce(g, F.concat(F.lit(K.BATCH_ID_PREFIX), col(position).cast("string")))
