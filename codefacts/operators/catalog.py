"""File catalog: which files exist, what they are, and what may be analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, paths
from ..functions.languages import LANGUAGE_SUFFIXES


def catalog_rows(files: DataFrame) -> DataFrame:
    """One row per (repo_id, path) with its deterministic id."""
    return files.select("repo_id", "path").distinct().select(
        keys.file_id(F.col("repo_id"), F.col("path")).alias("file_id"), "repo_id", "path"
    )


def new_rows(incoming: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, the smallest one per key. Broadcast or sort-merge is left to the size estimate."""
    rest = [c for c in incoming.columns if c not in on]
    least = incoming.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_r")).select(*on, "_r.*") if rest else incoming.distinct()
    return least.join(existing.select(*on), on, "left_anti").select(*incoming.columns)


def first_write_wins(incoming: DataFrame, existing: DataFrame, on: list[str], version: str) -> DataFrame:
    """Stored rows plus the earliest incoming row of every key that is not stored."""
    rest = [c for c in incoming.columns if c not in on]
    earliest = incoming.groupBy(*on).agg(F.min_by(F.struct(*rest), F.col(version)).alias("_r")).select(*on, "_r.*")
    return existing.unionByName(earliest.join(existing.select(*on), on, "left_anti"))


def last_write_wins(incoming: DataFrame, existing: DataFrame, on: list[str], version: str) -> DataFrame:
    """Latest version of every key over stored and incoming rows: partial maxima before the shuffle."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in on]
    return both.groupBy(*on).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(*on, "_r.*")


def insert_outcome(incoming: DataFrame, existing: DataFrame, on: list[str], error: Column) -> DataFrame:
    """Outcome of an idempotent bulk insert into ``existing``: a key that is stored already counts as success.

    One row: rows that succeeded and failed, keys that are new, rows that found their key stored or in an earlier row, and
    the distinct error codes of the failed rows in order.
    """
    stored = existing.select(*on).distinct().withColumn("_stored", F.lit(True))
    code = error.alias("_error")
    marked = incoming.select(*on, code).join(stored, on, "left")
    failed = F.col("_stored").isNull() & F.col("_error").isNotNull()
    # sums per key first: a key that very many rows bring is one row per task
    by_key = marked.groupBy(*on).agg(
        F.count_if(~failed).alias("good"), F.count_if(failed).alias("bad"), F.max("_stored").alias("stored"),
        F.collect_set(F.when(failed, F.col("_error"))).alias("codes"),
    )
    new = F.when((F.col("good") > 0) & F.col("stored").isNull(), 1).otherwise(0)
    codes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes"))))
    return by_key.agg(
        F.coalesce(F.sum("good"), F.lit(0)).alias("succeeded"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(new), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum(F.col("good") - new), F.lit(0)).alias("duplicates"),
        F.array_join(codes.cast("array<string>"), ",").alias("error_codes"),
    )


def split_targets(files: DataFrame, language: Column, wanted: list[str] | None = None) -> DataFrame:
    """Mark the files to analyse: language known, and wanted when a filter is given."""
    chosen = language.isNotNull()
    if wanted:
        chosen = chosen & language.isin(*wanted)
    return files.withColumn("language", language).withColumn("analysable", F.coalesce(chosen, F.lit(False)))


def with_language(files: DataFrame, registry: dict[str, tuple[str, ...]] = LANGUAGE_SUFFIXES) -> DataFrame:
    return files.withColumn("language", paths.detect_language(F.col("path"), registry))


def catalog_other(files: DataFrame, language: Column, wanted: list[str] | None = None) -> DataFrame:
    """Catalog rows of the files that are recorded but not analysed."""
    return catalog_rows(split_targets(files, language, wanted).filter(~F.col("analysable")))


def unsupported(requested: DataFrame, supported: DataFrame, on: str = "language") -> DataFrame:
    """Requested values that are not supported, each once, in order."""
    return requested.select(on).distinct().join(supported.select(on).distinct(), on, "left_anti").orderBy(on)
