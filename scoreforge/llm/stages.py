"""Stages of the corpus pipeline; all but the last return the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import decontaminate, packing, quality, secrets, simhash
from .common import fresh_name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts (score of 0.7 or more)."""
    forest = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    score = fresh_name(docs, "_score")
    return quality.score_quality(docs, forest, to=score).where(F.col(score) >= 0.7).drop(score)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: 3-word shingles, at most 3 differing bits."""
    return simhash.keep_first(docs, length=3, budget=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their text; ``n_chars`` follows the text."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("decontamination", decontamination_stage),
          ("secrets", secrets_stage), ("packing", packing_stage)]
