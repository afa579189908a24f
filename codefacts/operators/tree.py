"""File trees as tables: one row per shown node, with the id of its parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def common_depth(files: DataFrame) -> DataFrame:
    """Length of the longest directory prefix all files of a repository share; 0 for a single file.

    Two files agree on their first n segments for every n up to the answer, so it is the smallest agreement of any
    file with one fixed file of the repository. That file is a minimum, found with partial aggregates.
    """
    parts = F.split("path", "/")
    pivot = files.groupBy("repo_id").agg(F.min("path").alias("low"), F.max("path").alias("high"),
                                         F.min(F.size(parts)).alias("shortest"), F.count("*").alias("n"))
    low, high = F.split("low", "/"), F.split("high", "/")
    differs = F.array_position(F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    # in byte order every path lies between the smallest and the largest, so their common prefix is everyone's
    agree = F.when(differs == 0, F.least(F.size(low), F.size(high))).otherwise(differs - 1)
    depth = F.when(F.col("n") > 1, F.least(agree, F.col("shortest") - 1)).otherwise(0)
    return pivot.select("repo_id", depth.cast("int").alias("common_depth"))


def file_tree(files: DataFrame) -> DataFrame:
    """Nodes (repo_id, kind, full_path, parent_path, name, file_id) of the collapsed tree.

    The common prefix is dropped, and a folder whose only child is a folder is merged into that child.
    ``full_path`` of a folder is relative to the common prefix, that of a file is its whole path.
    """
    parts = F.split("path", "/")
    relative = (
        files.join(common_depth(files), "repo_id")
        .withColumn("rel", F.array_join(F.slice(parts, F.col("common_depth") + 1, F.size(parts)), "/"))
        .select("repo_id", "path", "file_id", "rel")
    )

    def parent_of(column: str) -> Column:
        return F.when(F.instr(column, "/") > 0, F.regexp_replace(column, r"/[^/]*$", "")).otherwise(F.lit(""))

    dirs = relative.select("repo_id", F.explode(paths.ancestors(F.col("rel"))).alias("dir")).distinct()
    children = dirs.select("repo_id", parent_of("dir").alias("dir"), F.lit(1).alias("d"), F.lit(0).alias("f")).unionByName(
        relative.select("repo_id", parent_of("rel").alias("dir"), F.lit(0).alias("d"), F.lit(1).alias("f"))
    )
    merged = (
        children.groupBy("repo_id", "dir").agg(F.sum("d").alias("d"), F.sum("f").alias("f"))
        .filter("d = 1 AND f = 0 AND dir <> ''").select("repo_id", "dir")
    )
    kept = dirs.join(merged, ["repo_id", "dir"], "left_anti")
    # deepest kept ancestor of every shown folder and of every directory that holds files: path depth bounds the explode
    homes = dirs.select("repo_id", F.col("dir").alias("child"))
    above = (
        homes.withColumn("dir", F.explode(paths.ancestors(F.col("child"))))
        .join(kept, ["repo_id", "dir"])
        .groupBy("repo_id", "child").agg(F.max_by("dir", F.length("dir")).alias("parent_path"))
    )
    folders = (
        kept.withColumnRenamed("dir", "child").join(above, ["repo_id", "child"], "left")
        .select("repo_id", F.lit("folder").alias("kind"), F.col("child").alias("full_path"),
                F.coalesce("parent_path", F.lit("")).alias("parent_path"), F.col("child").alias("rel"))
        .withColumn("file_id", F.lit(None).cast(files.schema["file_id"].dataType))
    )
    # a directory that holds a file is never merged, so it is the file's parent
    leaves = relative.select(
        "repo_id", F.lit("file").alias("kind"), F.col("path").alias("full_path"),
        parent_of("rel").alias("parent_path"), "rel", "file_id",
    )
    shown = F.when(F.col("parent_path") == "", F.col("rel")).otherwise(
        F.substr("rel", F.length("parent_path") + F.lit(2))
    )
    return folders.unionByName(leaves).withColumn("name", shown).drop("rel")


def tree_filter(nodes: DataFrame, query: str) -> DataFrame:
    """Files whose name contains the query, in any case, and the folders above them."""
    hits = nodes.filter((F.col("kind") == "file") & F.contains(F.lower("name"), F.lit(query.lower())))
    paths_up = F.when(
        F.col("parent_path") != "", F.concat(paths.ancestors(F.col("parent_path")), F.array("parent_path"))
    ).otherwise(F.array().cast("array<string>"))
    holders = hits.select("repo_id", F.explode(paths_up).alias("full_path")).distinct()
    folders = nodes.filter("kind = 'folder'").join(holders, ["repo_id", "full_path"], "left_semi")
    return folders.select(*nodes.columns).unionByName(hits)
