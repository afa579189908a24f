"""Listings, globs and pages over a file catalog (repo_id, path, file_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def below(files: DataFrame, directory: str) -> tuple[DataFrame, str]:
    """Files under a directory; the prefix test reaches the scan as StartsWith."""
    bare = directory.strip("/")
    prefix = f"{bare}/" if bare else ""
    return (files.filter(F.col("path").startswith(prefix)) if prefix else files), prefix


def list_dir(files: DataFrame, directory: str = "", pattern: str | None = None) -> DataFrame:
    """Immediate children per repository: directories with a trailing slash, files with their id."""
    inside, prefix = below(files, directory)
    relative = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    slash = F.instr(relative, "/")
    entry = F.when(slash > 0, F.substring_index(relative, "/", 1)).otherwise(relative)
    children = inside.select("repo_id", entry.alias("name"), (slash == 0).alias("is_file"), "file_id")
    if pattern is not None:
        if pattern.endswith("/"):
            children = children.filter(~F.col("is_file"))
        children = children.filter(F.col("name").rlike(paths.fnmatch_regex(pattern.rstrip("/"))))
    shown = F.when(F.col("is_file"), F.col("name")).otherwise(F.concat("name", F.lit("/")))
    return children.groupBy("repo_id", "is_file", shown.alias("entry")).agg(
        F.min(F.when(F.col("is_file"), F.col("file_id"))).alias("file_id")
    )


def glob_tree(files: DataFrame, pattern: str, directory: str = "") -> DataFrame:
    """Files that match a recursive glob, and every ancestor directory that matches it too."""
    dirs_only = pattern.endswith("/")
    bare = directory.strip("/")
    full = (f"{bare}/" if bare else "") + pattern.rstrip("/")
    regex = paths.glob_regex(full)
    candidates = files
    fixed = paths.literal_prefix(full)
    if fixed:
        candidates = files.filter(F.col("path").startswith(fixed))
    dirs = (
        candidates.select("repo_id", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
        .filter(F.col("dir").rlike(regex))
        .distinct()
        .select("repo_id", F.lit(False).alias("is_file"), F.concat("dir", F.lit("/")).alias("entry"))
        .withColumn("file_id", F.lit(None).cast(files.schema["file_id"].dataType))
    )
    if dirs_only:
        return dirs
    matched = candidates.filter(F.col("path").rlike(regex)).select(
        "repo_id", F.lit(True).alias("is_file"), F.col("path").alias("entry"), "file_id"
    )
    return dirs.unionByName(matched)


def listing_order() -> list[Column]:
    """Directories before files, each in byte order."""
    return [F.asc("is_file"), F.asc("entry")]


def page(df: DataFrame, order: list[Column | str], offset: int = 0, size: int = 100) -> DataFrame:
    """One page of an ordered listing, with the range shown and the total."""
    start = max(0, offset)
    total = df.agg(F.count("*").alias("total")).scalar()
    rows = df.orderBy(*order).offset(start).limit(size)
    return rows.withColumns({"total": total, "first": F.lit(start + 1).cast("long")})
