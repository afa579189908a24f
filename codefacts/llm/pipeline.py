"""A pipeline over documents: quality rules, exact dedup, near-duplicate dedup, secrets redacted, packing.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, the last one the packed pieces. Rows with a
null id or text, repeated rows and empty tables pass through the operators as their docstrings say; columns that an
operator doesn't know are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_settings, materialize
from .common import named, only_rows, prepare
from .exact_dedup import equal_groups
from .jaccard_join import near_groups
from .packing import pack
from .quality_rules import judged, learn_from
from .secret_scan import redacted, scan

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or a rule of the list learned from ``labels`` go."""
    rules = learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, rules).filter("__verdict.kept").select(*(named(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return only_rows(docs, equal_groups(docs).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id stays."""
    return only_rows(docs, near_groups(docs).filter("kept"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, and ``n_chars`` follows the text."""
    out = scan(docs).withColumn("text", redacted(F.col("text"), F.col("__spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(named(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("secret_scan", secrets), ("packing", packing),
]

#: The learned list and the token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next one."""
    prepare(apply_settings(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
