"""Counts, shares and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.languages import EXTENSION_NAMES, OTHER_LANGUAGE


def files_by_extension(files: DataFrame) -> DataFrame:
    """Number of files per repository and extension."""
    return files.groupBy("repo_id", paths.extension(F.col("path")).alias("extension")).agg(
        F.count("*").alias("files")
    )


def extension_names(spark: SparkSession) -> DataFrame:
    """The display names as a table of fixed size."""
    return spark.createDataFrame(list(EXTENSION_NAMES.items()), "ext string, language string")


def language_breakdown(by_extension: DataFrame) -> DataFrame:
    """Share of each display language per repository, rounded half up, without the ones below half a percent."""
    names = F.broadcast(extension_names(by_extension.sparkSession))  # fixed values, a few dozen rows
    named = by_extension.filter("files > 0").withColumn("ext", F.regexp_replace("extension", r"^\.+", ""))
    counts = (
        named.join(names, "ext", "left")
        .groupBy("repo_id", F.coalesce("language", F.lit(OTHER_LANGUAGE)).alias("language"))
        .agg(F.sum("files").alias("files"))
    )
    # at most one row per display name and repository remains, so this window stays small
    share = 100.0 * F.col("files") / F.sum("files").over(Window.partitionBy("repo_id"))
    return counts.withColumn("percentage", F.floor(share + 0.5)).filter("percentage > 0")


def run_stats(files: DataFrame, results: DataFrame) -> DataFrame:
    """Statistics of a run per repository.

    ``files(repo_id, file_id)`` holds every detected file; ``results`` the analysed ones (or the ones only recorded,
    with ``analysed`` false). Graph successes count graphs, build failures count files, and chunk counts look only
    at files whose documentation exists.
    """
    analysed = F.col("analysed")

    def files_where(condition: Column) -> Column:
        return F.count_if(analysed & condition)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(analysed, F.col(name))), F.lit(0)).cast("long")

    doc = F.col("doc_persisted")
    outcome = results.groupBy("repo_id").agg(
        F.count_if(F.col("file_persisted")).alias("file_success"),
        F.count_if(~F.col("file_persisted")).alias("file_failed"),
        files_where(F.col("ast_persisted")).alias("ast_success"),
        files_where(~F.col("ast_persisted")).alias("ast_failed"),
        total("cfg_persisted").alias("cfg_success"),
        total("cfg_failed").alias("cfg_failed"),
        files_where(~F.col("cfg_built")).alias("cfg_build_failed"),
        total("dfg_persisted").alias("dfg_success"),
        total("dfg_failed").alias("dfg_failed"),
        files_where(~F.col("dfg_built")).alias("dfg_build_failed"),
        files_where(doc).alias("doc_success"),
        files_where(~doc).alias("doc_failed"),
        files_where(doc & F.col("rag_persisted")).alias("rag_success"),
        files_where(doc & ~F.col("rag_persisted")).alias("rag_failed"),
    )
    detected = files.groupBy("repo_id").agg(F.count("*").alias("files_detected"))
    counts = [c for c in outcome.columns if c != "repo_id"]
    return detected.join(outcome, "repo_id", "left").select(
        "repo_id", "files_detected", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    )


def failed_runs(stats: DataFrame) -> DataFrame:
    """Runs that detected files but stored none; a partial catalog passes."""
    return stats.filter((F.col("files_detected") > 0) & (F.col("file_success") == 0))


def gate(stats: DataFrame) -> DataFrame:
    """The statistics, after raising when a run stored nothing."""
    broken = failed_runs(stats).select("repo_id").limit(1).collect()
    if broken:
        raise RuntimeError(f"no file stored for repository {broken[0][0]}")
    return stats


def stats_markdown(stats: DataFrame) -> DataFrame:
    """Markdown table of each repository's statistics (headings are fixed values)."""
    def row(label: str, good: str, bad: Column) -> Column:
        return F.concat(F.lit(f"| {label} | "), F.col(good).cast("string"), F.lit(" | "), bad, F.lit(" |\n"))

    def failures(kind: str) -> Column:
        return F.format_string("%d (%d)", f"{kind}_failed", f"{kind}_build_failed")

    head = "# Résumé de l'analyse\n\n| Métrique | Succès | Échec |\n| ------ | ------: | -----: |\n"
    return stats.select(
        "repo_id",
        F.concat(
            F.lit(head),
            row("Fichier ", "files_detected", F.lit("—")),
            row("AST   ", "ast_success", F.col("ast_failed").cast("string")),
            row("CFG   ", "cfg_success", failures("cfg")),
            row("DFG   ", "dfg_success", failures("dfg")),
            row("Documentation   ", "doc_success", F.col("doc_failed").cast("string")),
        ).alias("content"),
    )


def progress(events: DataFrame, key: str, started: Column, total: int) -> DataFrame:
    """Started model calls per run against the expected number."""
    return events.groupBy(key).agg(F.count_if(started).alias("progress_current")).withColumn(
        "progress_total", F.lit(total).cast("long")
    )


def user_counts(links: DataFrame) -> DataFrame:
    """How many users are linked to each repository."""
    return links.groupBy("repo_id").agg(F.count("*").alias("user_count"))


def view_counts(rows: DataFrame, key: str) -> DataFrame:
    """Entries per owner for a view's heading."""
    return rows.groupBy(key).agg(F.count("*").alias("entries"))
