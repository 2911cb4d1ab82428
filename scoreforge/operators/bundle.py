"""M9 on saved bundles: a manifest of parts with row counts and checksums, compared with what is there.

A checksum is the sum of row hashes, so it does not depend on file layout or row order.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_exists

#: Parts a bundle can have, and how each is stored.
PARTS = {"model/metadata": "text", "model/data": "parquet", "model/treesMetadata": "parquet", "meta": "text",
         "features/vocab": "parquet", "features/labels": "parquet", "features/num_stats": "parquet", "features/meta": "text"}
_MANIFEST = "part string, rows long, checksum string"


def versions() -> dict[str, str]:
    return {"pyspark": pyspark.__version__, "numpy": numpy.__version__}


def _summed(spark: SparkSession, path: str, part: str) -> tuple[str, int, str]:
    df = spark.read.format(PARTS[part]).load(f"{path}/{part}")
    own = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(df.columns)])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(own.cast("decimal(38,0)")).cast("string").alias("s")).first()
    return part, row["n"], row["s"] or "0"


def _present(spark: SparkSession, path: str) -> list[str]:
    return [p for p in PARTS if work_exists(spark, f"{path}/{p}")]


def write_manifest(spark: SparkSession, path: str) -> None:
    """The parts now at ``path`` with their row counts and checksums, and the library versions; written last."""
    rows = [_summed(spark, path, p) for p in _present(spark, path)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/parts")
    spark.createDataFrame([(json.dumps(versions()),)], "versions string").coalesce(1).write.mode("overwrite").text(
        f"{path}/manifest/versions")


def check_parts(spark: SparkSession, path: str) -> DataFrame:
    """(severity, kind, item) rows, none for a sound bundle: a missing part, another number of rows, another
    checksum, an unlisted part, a feature count that differs between model and features; other library versions warn."""
    if not work_exists(spark, f"{path}/manifest/parts"):
        return spark.createDataFrame([("error", "missing_part", "manifest")], "severity string, kind string, item string")
    listed = {r["part"]: (r["rows"], r["checksum"]) for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/parts").collect()}
    there = _present(spark, path)
    rows = [("error", "missing_part", p) for p in sorted(set(listed) - set(there))]
    rows += [("error", "unlisted_part", p) for p in sorted(set(there) - set(listed))]
    for p in sorted(set(there) & set(listed)):
        _, n, checksum = _summed(spark, path, p)
        rows += [("error", "rows", p)] if n != listed[p][0] else []
        rows += [("error", "checksum", p)] if checksum != listed[p][1] else []
    if {"meta", "features/meta"} <= set(there):
        model, features = (json.loads(spark.read.text(f"{path}/{p}").first()[0])["feature_names"] for p in ("meta", "features/meta"))
        rows += [("error", "feature_count", f"model={len(model)} features={len(features)}")] if len(model) != len(features) else []
    kept = json.loads(spark.read.text(f"{path}/manifest/versions").first()[0])
    rows += [("warning", "version", lib) for lib, v in sorted(versions().items()) if kept.get(lib) != v]
    return spark.createDataFrame(rows, "severity string, kind string, item string")


def copy_bundle(spark: SparkSession, path: str, to: str, leave_out: Sequence[str] = (), cut: Sequence[str] = (),
                versions: dict | None = None) -> None:
    """Copy a bundle and its manifest, without some parts, without a row of others, or under other versions: for checks."""
    for p in _present(spark, path):
        if p not in leave_out:
            df = spark.read.format(PARTS[p]).load(f"{path}/{p}")
            df = df.limit(max(0, df.count() - 1)) if p in cut else df
            df.write.format(PARTS[p]).mode("overwrite").save(f"{to}/{p}")
    spark.read.parquet(f"{path}/manifest/parts").write.mode("overwrite").parquet(f"{to}/manifest/parts")
    kept = json.loads(spark.read.text(f"{path}/manifest/versions").first()[0])
    spark.createDataFrame([(json.dumps({**kept, **(versions or {})}),)], "versions string").coalesce(1).write.mode(
        "overwrite").text(f"{to}/manifest/versions")
