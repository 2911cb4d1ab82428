"""Feature operators (F2-F12): fit = one aggregate pass into a small state,
transform = JVM-side expressions / Spark ML transformers (no shuffle).

What reaches the driver is the vocabulary (``max_features`` terms) and a few numbers
per column.  Label dictionaries are tables of any size, applied by size-checked joins.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..functions.cumulative import ordered_running_sum
from ..functions.text import tokenize
from ..session import written
from .profile import iqr_bounds, number


# ------------------------------------------------------------------ TF-IDF
#: Terms a vocabulary without ``max_features`` may have.
MOST_TERMS = 1_000_000
#: Documents whose terms are counted at a time.
COUNTED_ROWS = 2000


@dataclass
class Vocabulary:
    terms: list[str]          # alphabetical, index = position
    df: list[int]
    tf: list[int]
    n_docs: int

    @property
    def idf(self) -> list[float]:
        # smooth idf: ln((1 + n) / (1 + df)) + 1
        return [math.log((1.0 + self.n_docs) / (1.0 + d)) + 1.0 for d in self.df]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, d, f, w) for i, (t, d, f, w) in enumerate(zip(self.terms, self.df, self.tf, self.idf))]
        return spark.createDataFrame(rows, "term string, idx int, df long, tf long, idf double")


def term_stats(docs: DataFrame, terms: str = "terms", count_docs: bool = False) -> DataFrame:
    """(term, tf, df): corpus frequency and document frequency.  Each row is one document, so an Arrow batch gives
    the counts of its terms, one row per term; a grouped sum adds the batches up.  ``count_docs`` adds a row
    with a null term and the number of documents as df."""
    def run(batches):
        for batch in batches:
            lists = batch.column("terms")
            for at in range(0, len(lists), COUNTED_ROWS):
                yield _counted(lists.slice(at, COUNTED_ROWS), count_docs)

    counts = docs.select(F.col(terms).cast("array<string>").alias("terms")).mapInArrow(run, "term string, tf long, df long")
    return counts.groupBy("term").agg(F.sum("tf").cast("long").alias("tf"), F.sum("df").cast("long").alias("df"))


def _counted(lists: pa.ListArray, count_docs: bool) -> pa.RecordBatch:
    """(term, tf, df) of some documents' term lists; a null term holds the number of documents."""
    codes = lists.flatten().dictionary_encode()
    code, size = codes.indices.to_numpy(zero_copy_only=False), len(codes.dictionary)
    doc = np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
    tf = np.bincount(code, minlength=size)
    df = np.bincount(np.unique(doc * np.int64(max(size, 1)) + code) % max(size, 1), minlength=size)
    term, tf, df = codes.dictionary, tf[:size], df[:size]
    if count_docs:
        term = pa.concat_arrays([term, pa.array([None], pa.string())])
        tf, df = np.append(tf, 0), np.append(df, len(lists))
    return pa.RecordBatch.from_arrays([term, pa.array(tf.astype(np.int64)), pa.array(df.astype(np.int64))], ["term", "tf", "df"])


def tfidf_fit(docs: DataFrame, text_col: str | None = None, terms: str = "terms", max_features: int = 1000,
              min_df: float | int = 2, max_df: float | int = 0.95) -> Vocabulary:
    """keep min_df <= df <= max_df (fractions of the document count when
    float), then the ``max_features`` most frequent terms (ties by term),
    indexed alphabetically."""
    if text_col is not None:
        docs = tokenize(docs, text_col, terms)
    # one row per term and the document count under a null term: the corpus is tokenized once
    stats = written(term_stats(docs.select(terms), terms, count_docs=True), "term-stats")
    n = stats.where("term is null").agg(F.sum("df")).first()[0] or 0
    lo = min_df if isinstance(min_df, int) else min_df * n
    hi = max_df if isinstance(max_df, int) else max_df * n
    top = stats.where(F.col("term").isNotNull() & (F.col("df") >= F.lit(lo)) & (F.col("df") <= F.lit(hi)))
    # the driver gets the vocabulary: without a limit of the caller's, one more than MOST_TERMS is an error
    rows = top.orderBy(F.desc("tf"), F.asc("term")).limit(MOST_TERMS + 1 if max_features is None else max_features).collect()
    if max_features is None and len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms pass the thresholds: set max_features or raise min_df")
    rows = sorted(rows, key=lambda r: r["term"].encode("utf-8"))
    return Vocabulary([r["term"] for r in rows], [r["df"] for r in rows], [r["tf"] for r in rows], n)


def tfidf_transform(docs: DataFrame, vocab: Vocabulary, terms: str = "terms", out: str = "tfidf") -> DataFrame:
    """counts x idf, L2-normalised; out-of-vocabulary terms ignored, a
    document with no hit gets the zero vector.  Row-local: the vocabulary
    lives in a broadcast hash map inside ``CountVectorizerModel``."""
    if not vocab.terms:                        # nothing to hit: every document is the vector of no entries
        return docs.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    cv = CountVectorizerModel.from_vocabulary(vocab.terms, inputCol=terms, outputCol="__tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense(vocab.idf), inputCol="__tf", outputCol="__w")
    nz = Normalizer(p=2.0, inputCol="__w", outputCol=out)
    return nz.transform(ep.transform(cv.transform(docs))).drop("__tf", "__w")


def tfidf_long(df: DataFrame, key: str, vec: str = "tfidf", empty_idx: int = -1) -> DataFrame:
    """(key, idx, weight) for the non-zero entries of a TF-IDF vector; a
    document without any vocabulary term keeps one row (empty_idx, 0.0).

    The vector is referenced exactly once: Spark would otherwise inline the
    whole transformer chain (count, idf, normalise) into every reference."""
    rows = df.select(F.col(key), F.inline_outer(sparse_entries(vec)))
    return rows.select(key, F.coalesce(F.col("idx"), F.lit(empty_idx)).alias("idx"),
                       F.coalesce(F.col("value"), F.lit(0.0)).alias("weight"))


def sparse_entries(vec: str) -> Column:
    """Non-zero (idx, value) entries of a vector column as an array of structs, from its stored form: a
    sparse vector is never made dense."""
    entry = lambda i, w: F.struct(i.alias("idx"), w.alias("value"))
    # bound once, as the opened value is used several times
    entries = F.transform(F.array(F.unwrap_udt(vec)), lambda v: F.when(
        v["indices"].isNotNull(), F.zip_with(v["indices"], v["values"], entry)).otherwise(
        F.transform(v["values"], lambda w, i: entry(i, w))))[0]
    return F.filter(entries, lambda e: e["value"] != 0)


# --------------------------------------------------------------- categories
@dataclass
class Labels:
    """A label dictionary of any size: a written (column, value, code) table, and two numbers per column."""

    table: DataFrame | None
    sizes: dict[str, tuple[int, int]]   # column -> (labels, code of the unknown)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self.table if self.table is not None else spark.createDataFrame([], "column string, value string, code int")

    @classmethod
    def of_table(cls, table: DataFrame, cols: Sequence[str]) -> Labels:
        """The dictionary of a table; the unknown's code is its own if it is a label, else one past the last."""
        unknown = F.max(F.when(F.col("value") == K.UNKNOWN_CATEGORY, F.col("code")))
        rows = {r["column"]: r for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n"), unknown.alias("u")).collect()}
        sizes = {c: (rows[c]["n"], rows[c]["n"] if rows[c]["u"] is None else rows[c]["u"]) if c in rows else (0, 0) for c in cols}
        return cls(table, sizes)


def label_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code): codes are the ranks of the distinct values in byte order, null read as 'Unknown',
    from running sums over written slices; nothing is collected."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  F.coalesce(F.col(c).cast("string"), F.lit(K.UNKNOWN_CATEGORY))
                                                  .alias("value")) for c in cols])).alias("r"))
    distinct = long.groupBy("r.column", "r.value").agg(F.lit(1).cast("long").alias("one")).select("column", "value", "one")
    ranked = ordered_running_sum(distinct, "column", "value", ["one"])
    return ranked.select("column", "value", (F.col("cum_one") - 1).cast("int").alias("code"))


def label_fit(df: DataFrame, cols: Sequence[str]) -> Labels:
    """the dictionary of the columns' distinct values as a written table; the driver gets two numbers per column."""
    if not cols:
        return Labels(None, {})
    return Labels.of_table(written(label_table(df, cols), "labels"), cols)


def label_transform(df: DataFrame, labels: Labels, suffix: str = "") -> DataFrame:
    """known value -> code; null or unseen -> the code of the unknown.

    One equi-join per column against the dictionary table: Spark broadcasts it when its size allows and otherwise
    shuffles, splitting a value that holds a large share of the rows."""
    for i, (c, (_, unknown)) in enumerate(labels.sizes.items()):
        own = labels.table.where(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__code{i}"))
        value = F.coalesce(F.col(c).cast("string"), F.lit(K.UNKNOWN_CATEGORY))
        df = (df.withColumn(f"__value{i}", value).join(own, F.col(f"__value{i}") == F.col(f"__v{i}"), "left")
              .withColumn(c + suffix, F.coalesce(F.col(f"__code{i}"), F.lit(unknown)).cast("int"))
              .drop(f"__value{i}", f"__v{i}", f"__code{i}"))
    return df


# ------------------------------------------------------------------ numbers
@dataclass
class NumericState:
    bounds: dict[str, tuple]       # column -> (q1, q3, lo, hi)
    mean: dict[str, float]
    std: dict[str, float]          # population std, 0 replaced by 1


def iqr_cap(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """clip each column to its fences (null / NaN untouched)."""
    out = df
    for c, (_, _, lo, hi) in bounds.items():
        if lo is not None:
            out = out.withColumn(c, X.clip(F.col(c).cast("double"), lo, hi))
    return out


def numeric_fit(df: DataFrame, cols: Sequence[str], factor: float = 1.5, cap: bool = True) -> NumericState:
    """F6 + F7 fit: fences from exact quartiles, then mean and population std
    of the capped columns in one aggregate, NaN left out; a column without a
    number gets mean 0 and std 1."""
    if not cols:
        return NumericState({}, {}, {})
    bounds = iqr_bounds(df, cols, factor) if cap else {c: (None, None, None, None) for c in cols}
    capped = iqr_cap(df, bounds) if cap else df
    aggs = []
    for c in cols:
        x = number(c)
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = capped.agg(*aggs).first()
    mean = {c: row[f"m_{c}"] or 0.0 for c in cols}
    std = {c: (row[f"s_{c}"] if row[f"s_{c}"] not in (None, 0.0) else 1.0) for c in cols}
    return NumericState(bounds, mean, std)


def standardize(df: DataFrame, state: NumericState, suffix: str = "") -> DataFrame:
    """(x - mean) / std with the fitted numbers as literals."""
    out = df
    for c in state.mean:
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(state.mean[c])) / F.lit(state.std[c]))
    return out


# ----------------------------------------------------------------- pipeline
@dataclass
class FeaturePipeline:
    """text (TF-IDF), categorical (label codes) and numeric (IQR cap +
    standard scale) blocks assembled in that order."""
    text_col: str | None = None
    cat_cols: Sequence[str] = ()
    num_cols: Sequence[str] = ()
    max_features: int = 1000
    min_df: float | int = 2
    max_df: float | int = 0.95
    outlier_factor: float = 1.5
    handle_outliers: bool = True
    bounds: str = "fitted"          # or "batch": recompute fences on every transformed batch
    scaler: str = "standard"

    def fit(self, df: DataFrame) -> FittedFeatures:
        if self.scaler != "standard":
            raise ValueError(f"no scaler is called {self.scaler!r}; there is 'standard'")
        required = ([self.text_col] if self.text_col else []) + list(self.cat_cols) + list(self.num_cols)
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"the table lacks the columns {missing}")
        vocab = None
        if self.text_col:
            vocab = tfidf_fit(df.select(self.text_col), self.text_col, max_features=self.max_features,
                              min_df=self.min_df, max_df=self.max_df)
        labels = label_fit(df, list(self.cat_cols))
        num = numeric_fit(df, list(self.num_cols), self.outlier_factor, self.handle_outliers)
        return FittedFeatures(self, vocab, labels, num)

    def transform(self, df: DataFrame) -> DataFrame:
        raise ValueError("a pipeline transforms by what fit() returns")


@dataclass
class FittedFeatures:
    spec: FeaturePipeline
    vocab: Vocabulary | None
    labels: Labels
    num: NumericState
    meta: dict = field(default_factory=dict)

    # F9
    def feature_names(self) -> list[str]:
        text = [f"text_tfidf_{i}" for i in range(len(self.vocab.terms))] if self.vocab else []
        return text + list(self.spec.cat_cols) + list(self.spec.num_cols)

    def catalog(self, spark: SparkSession) -> DataFrame:
        n_text = len(self.vocab.terms) if self.vocab else 0
        rows = ([("text", i, f"text_tfidf_{i}") for i in range(n_text)]
                + [("categorical", n_text + i, c) for i, c in enumerate(self.spec.cat_cols)]
                + [("numerical", n_text + len(self.spec.cat_cols) + i, c) for i, c in enumerate(self.spec.num_cols)])
        return spark.createDataFrame(rows, "group string, idx int, name string")

    def transform_columns(self, df: DataFrame) -> DataFrame:
        """Blocks as separate columns: ``tfidf`` vector, ``<cat>`` codes, ``<num>`` scaled."""
        out = df
        if self.vocab is not None:
            out = tfidf_transform(tokenize(out, self.spec.text_col, "__terms"), self.vocab, "__terms").drop("__terms")
        out = label_transform(out, self.labels)
        if self.spec.handle_outliers:
            if self.spec.bounds == "batch" and self.spec.num_cols:
                bounds = iqr_bounds(out, list(self.spec.num_cols), self.spec.outlier_factor)
            else:
                bounds = self.num.bounds
            out = iqr_cap(out, bounds)
        return standardize(out, self.num)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """F8: one assembled vector in catalog order (text, categories, numbers)."""
        cols = self.transform_columns(df)
        text = ["tfidf"] if self.vocab is not None and self.vocab.terms else []      # an empty block adds no entries
        inputs = text + list(self.spec.cat_cols) + list(self.spec.num_cols)
        if not inputs:
            return cols.withColumn(out, array_to_vector(F.array().cast("array<double>")))
        return VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep").transform(cols)

    def long_form(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, idx, name, value): every categorical and numeric entry, the
        non-zero text entries; the comparable form of F8."""
        cols = self.transform_columns(df)
        n_text = len(self.vocab.terms) if self.vocab else 0
        parts = []
        if self.vocab is not None:
            parts.append(F.transform(sparse_entries("tfidf"), lambda s: F.struct(
                s["idx"].alias("idx"), F.concat(F.lit("text_tfidf_"), s["idx"].cast("string")).alias("name"),
                s["value"].alias("value"))))
        fixed = [F.struct(F.lit(n_text + i).alias("idx"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                 for i, c in enumerate(list(self.spec.cat_cols) + list(self.spec.num_cols))]
        if fixed:
            parts.append(F.array(*fixed))
        if not parts:
            return cols.select(F.col(id_col).alias("id"), F.lit(0).alias("idx"), F.lit("").alias("name"),
                               F.lit(0.0).alias("value")).where("false")
        return cols.select(F.col(id_col).alias("id"), F.inline(F.concat(*parts)))

    # F12
    def save(self, spark: SparkSession, path: str) -> None:
        if self.vocab is not None:
            self.vocab.to_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
        self.labels.to_df(spark).write.mode("overwrite").parquet(f"{path}/labels")
        num_rows = [(c, *self.num.bounds[c], self.num.mean[c], self.num.std[c]) for c in self.spec.num_cols]
        spark.createDataFrame(num_rows, "column string, q1 double, q3 double, lo double, hi double, "
                                        "mean double, std double").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/num_stats")
        spec = {k: (list(v) if isinstance(v, tuple) else v) for k, v in self.spec.__dict__.items()}
        spec["cat_cols"], spec["num_cols"] = list(self.spec.cat_cols), list(self.spec.num_cols)
        meta = {"spec": spec, "n_docs": self.vocab.n_docs if self.vocab else None,
                "feature_names": self.feature_names(), **self.meta}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedFeatures:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        spec = FeaturePipeline(**meta["spec"])
        vocab = None
        if spec.text_col:
            rows = sorted(spark.read.parquet(f"{path}/vocab").collect(), key=lambda r: r["idx"])
            vocab = Vocabulary([r["term"] for r in rows], [r["df"] for r in rows], [r["tf"] for r in rows],
                               meta["n_docs"])
        labels = Labels.of_table(spark.read.schema("column string, value string, code int").parquet(f"{path}/labels"),
                                 spec.cat_cols) if spec.cat_cols else Labels(None, {})
        nums = {r["column"]: r for r in spark.read.parquet(f"{path}/num_stats").collect()}
        num = NumericState({c: (nums[c]["q1"], nums[c]["q3"], nums[c]["lo"], nums[c]["hi"]) for c in spec.num_cols},
                           {c: nums[c]["mean"] for c in spec.num_cols}, {c: nums[c]["std"] for c in spec.num_cols})
        extra = {k: v for k, v in meta.items() if k not in ("spec", "n_docs", "feature_names")}
        return FittedFeatures(spec, vocab, labels, num, extra)


def target_column(df: DataFrame, target: str, key: str | None = None) -> DataFrame:
    """the target (with its key), an error when the column is absent."""
    if target not in df.columns:
        raise ValueError(f"the table has no target {target!r}")
    return df.select(*([key] if key else []), F.col(target).cast("double").alias(target))
