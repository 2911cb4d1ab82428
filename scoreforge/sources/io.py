"""Sources and sinks (S1-S12).  Writes are set-based DataFrame writes to the
shared folder; every writer returns what a reader sees afterwards so the
round trip can be checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

TRAIN_TABLE_SCHEMA = "gid string, payload_json string, target double, created_at string"
LOG_TABLE_SCHEMA = ("gid string, payload_json string, prediction double, confidence string, "
                    "explanation_summary string, created_at string")


# --------------------------------------------------------------- S1, S7
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row, no index; a directory of part files."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def export_table(df: DataFrame, out_dir: str, name: str, fmt: str = "csv") -> dict[str, str]:
    """The whole table as CSV, Parquet or both; returns the written paths."""
    if fmt not in ("csv", "parquet", "both"):
        raise ValueError(f"unknown format {fmt!r}")
    paths = {}
    if fmt in ("csv", "both"):
        paths["csv"] = f"{out_dir}/{name}.csv"
        write_csv(df, paths["csv"])
    if fmt in ("parquet", "both"):
        paths["parquet"] = f"{out_dir}/{name}.parquet"
        df.write.mode("overwrite").parquet(paths["parquet"])
    return paths


# ------------------------------------------------------------ S3 - S6
def payload(cols: Sequence[str | Column]) -> Column:
    return F.to_json(F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols]))


def append_cases(df: DataFrame, path: str, payload_cols: Sequence[str], gid: str | Column = "gid",
                 target: str | Column | None = None, created_at: str | None = None) -> int:
    """S3: append rows as (gid, payload_json, target, created_at).

    One batch timestamp for all rows (a literal, the same on every executor);
    the rows are counted by an observation while they are written.
    """
    stamp = F.lit(created_at) if created_at is not None else F.date_format(F.current_timestamp(), ISO_FORMAT)
    rows = df.select(
        (F.col(gid) if isinstance(gid, str) else gid).cast("string").alias("gid"),
        payload(payload_cols).alias("payload_json"),
        (F.lit(None).cast("double") if target is None else
         (F.col(target) if isinstance(target, str) else target).cast("double")).alias("target"),
        stamp.alias("created_at"))
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAIN_TABLE_SCHEMA).parquet(path)


def flatten(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Expand a struct column into top-level columns named ``a.b.c``."""
    def walk(dt: T.DataType, path: list[str]):
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                yield from walk(f.dataType, path + [f.name])
        else:
            yield path

    others = [F.col(f"`{c}`") for c in df.columns if c != col]
    dt = df.schema[col].dataType
    leaves = [F.col(col).getField(p[0]) if len(p) == 1 else
              _get(F.col(col), p) for p in walk(dt, [])]
    names = [prefix + ".".join(p) for p in walk(dt, [])]
    return df.select(*others, *[c.alias(n) for c, n in zip(leaves, names)])


def _get(c: Column, path: list[str]) -> Column:
    for p in path:
        c = c.getField(p)
    return c


def flatten_payload(df: DataFrame, col: str, schema: T.StructType | str) -> DataFrame:
    """Parse JSON payload text with an explicit schema (malformed -> null)
    and flatten nested keys to dotted column names."""
    parsed = df.withColumn(col, F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"}))
    return flatten(parsed, col)


def count_rows(df: DataFrame) -> DataFrame:
    """One-row count (partial counts per task, one final row)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def inference_log_rows(df: DataFrame, gid: str | Column, payload_col: str | Column, prediction: str | Column,
                       explanation: str | Column | None = None, created_at: str | Column | None = None,
                       keep: Sequence[str] = ()) -> DataFrame:
    """S6 rows: raw gid, payload, prediction, tier as confidence, explanation,
    ISO time text and the ``ds`` day partition."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    ts = c(created_at) if created_at is not None else F.current_timestamp()
    pred = c(prediction).cast("double")
    return df.select(
        *keep,
        c(gid).cast("string").alias("gid"), c(payload_col).alias("payload_json"), pred.alias("prediction"),
        X.tier(pred).alias("confidence"),
        (F.lit(None).cast("string") if explanation is None else c(explanation)).alias("explanation_summary"),
        F.date_format(ts, ISO_FORMAT).alias("created_at"),
        F.date_format(ts, "yyyy-MM-dd").alias("ds"))


def append_inference_log(rows: DataFrame, path: str) -> None:
    """Set-based append partitioned by day (the streaming form is T6)."""
    rows.write.mode("append").partitionBy("ds").parquet(path)


def read_inference_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_TABLE_SCHEMA + ", ds string").option("basePath", path).parquet(path)


# ------------------------------------------------------------------- S8
def recent_log_query(log: DataFrame, payload_schema: T.StructType | str, limit: int = 50, gid: str | None = None,
                     start: str | None = None, end: str | None = None, order_key: str = "id") -> DataFrame:
    """Optional gid / time filters (inclusive, compared as times, empty = no
    filter), newest first by the id, first ``limit`` rows; an unparsable payload
    becomes null.  On a log partitioned by day the times (as days of UTC, whatever
    offset they are given with) also prune ``ds``; the
    ordered limit is a TakeOrderedAndProject (per-task top-n, no global sort)."""
    out = log
    if gid:
        out = out.where(F.col("gid") == F.lit(gid))
    at = F.try_to_timestamp(F.col("created_at"))
    if start:
        out = out.where(at >= F.to_timestamp(F.lit(start)))
    if end:
        out = out.where(at <= F.to_timestamp(F.lit(end)))
    if "ds" in log.columns:
        if start:
            out = out.where(F.col("ds") >= F.date_format(F.to_timestamp(F.lit(start)), "yyyy-MM-dd"))
        if end:
            out = out.where(F.col("ds") <= F.date_format(F.to_timestamp(F.lit(end)), "yyyy-MM-dd"))
    out = out.orderBy(F.desc(order_key)).limit(int(limit))
    return out.withColumn("payload", parse_payload(F.col("payload_json"), payload_schema))


def parse_payload(text: Column, schema: T.StructType | str) -> Column:
    """JSON text -> struct; text that is not valid JSON gives null (PERMISSIVE
    ``from_json`` alone would give a struct of nulls)."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema, {"mode": "PERMISSIVE"}))


# ------------------------------------------------------------------- S9
def case_schema() -> T.StructType:
    return T.StructType([
        T.StructField("gid", T.StringType()), T.StructField("risk_category", T.StringType()),
        T.StructField("region", T.StringType()), T.StructField("business_type", T.StringType()),
        T.StructField("regulatory_status", T.StringType()), T.StructField("compliance_level", T.StringType()),
        T.StructField("revenue", T.DoubleType()), T.StructField("employee_count", T.IntegerType()),
        T.StructField("years_in_business", T.IntegerType()), T.StructField("credit_score", T.IntegerType()),
        T.StructField("debt_to_equity_ratio", T.DoubleType()), T.StructField("liquidity_ratio", T.DoubleType()),
        T.StructField("market_share", T.DoubleType()), T.StructField("growth_rate", T.DoubleType()),
        T.StructField("profitability_margin", T.DoubleType()),
        T.StructField("customer_satisfaction", T.DoubleType()),
        T.StructField("operational_efficiency", T.DoubleType()),
        T.StructField("regulatory_violations", T.IntegerType()), T.StructField("audit_score", T.DoubleType()),
        T.StructField("description", T.StringType()),
    ])


def batch_schema(case: T.StructType | None = None) -> T.StructType:
    return T.StructType([T.StructField("batch_id", T.StringType()),
                         T.StructField("cases", T.ArrayType(case or case_schema())),
                         T.StructField("include_explanations", T.BooleanType())])


def read_batch_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    multiline: bool = False) -> DataFrame:
    """Batch request documents -> one row per case with its zero-based
    position.  Each document is one row; ``posexplode`` is row-local."""
    docs = spark.read.schema(schema or batch_schema()).option("multiLine", multiline).json(path)
    return docs.select("batch_id", "include_explanations", F.posexplode("cases").alias("pos", "case")) \
        .select("batch_id", "include_explanations", "pos", "case.*")


# ------------------------------------------------------------ S10 - S12
def dated_partition_write(df: DataFrame, path: str, ts_col: str, ds: str = "ds") -> None:
    """Write under the day of ``ts_col``; only the days present are replaced."""
    (df.withColumn(ds, F.date_format(F.col(ts_col), "yyyy-MM-dd")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(ds).parquet(path))


def retention_filter(parts: DataFrame, asof: str, keep_days: int = 30, ds: str = "ds") -> DataFrame:
    """Mark day partitions strictly older than ``asof - keep_days`` as
    expired; names that are not dates are skipped.  Removing them is a
    separate, opt-in rewrite."""
    day = F.to_date(F.try_to_timestamp(F.col(ds), F.lit("yyyy-MM-dd")))
    cutoff = F.date_sub(F.to_date(F.lit(asof)), keep_days)
    return parts.withColumn("status", F.when(day.isNull(), "skipped")
                            .when(day < cutoff, "expired").otherwise("kept"))


def json_summary_sink(df: DataFrame, path: str) -> None:
    """Nested summary rows as JSON lines."""
    df.write.mode("overwrite").json(path)
