"""Stored layouts: bucketed tables that joins need not shuffle, and deletions that rewrite what they touch."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts
from ..operators.ordering import paged_lists
from ..session import delete_table, materialize, new_table_path


def write_bucketed(df: DataFrame, keys: list[str], buckets: int, name: str = "bucketed", path: str | None = None) -> DataFrame:
    """Store a table in ``buckets`` hash buckets of ``keys``, one file each, and return it as stored.

    Rows are dealt out by the same hash first, so each task writes the files of its own buckets. An equality on all keys
    reads one bucket; tables with the same keys and buckets are joined and grouped by them without an exchange.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option(
        "path", path or new_table_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


class GraphStore:
    """Files, their syntax trees and scoped graphs in buckets of the file, for point reads and lists."""

    KINDS = ("files", "ast", "cfg", "dfg")

    def __init__(self, tables: dict[str, DataFrame], buckets: int = 64):
        self.tables = {kind: write_bucketed(tables[kind], ["file_id"], buckets, kind) for kind in self.KINDS}

    def of_file(self, kind: str, file_id: object) -> DataFrame:
        """Rows of one file: one bucket's file is opened."""
        return self.tables[kind].filter(F.col("file_id") == F.lit(file_id))

    def with_graphs(self, page_size: int = 1000) -> DataFrame:
        """As :func:`artifacts.file_graphs`: each file with its tree and its graphs in pages, page 0 for every file.

        A file's graphs come from one source text, so one window bounds them. Left joins keep the buckets of the files
        all the way, so nothing is shuffled.
        """
        files, ast, cfg, dfg = (self.tables[kind] for kind in self.KINDS)
        last, listed = [], []
        for out, child in (("cfg", cfg), ("dfg", dfg)):
            pages = paged_lists(child, ["file_id"], ["seq"], F.struct("scope", "content"), out, page_size, bounded=True)
            listed.append(pages)
            last.append(child.groupBy("file_id").agg(F.floor((F.count("*") - 1) / page_size).alias(f"_{out}")))
        base = files
        for counts in last:
            base = base.join(counts, "file_id", "left")
        pages = F.sequence(F.lit(0).cast("long"), F.coalesce(F.greatest("_cfg", "_dfg"), F.lit(0)).cast("long"))
        base = base.select(*files.columns, F.explode(pages).alias("page"))
        for pages in listed:
            base = base.join(pages, ["file_id", "page"], "left")
        empty = F.array().cast(artifacts.empty_type())
        return base.join(ast.select("file_id", F.col("content").alias("ast")), "file_id", "left").select(
            *files.columns, "page", "ast", *(F.coalesce(F.col(k).cast(artifacts.empty_type()), empty).alias(k) for k in ("cfg", "dfg")))


def rewrite(spark: SparkSession, path: str, by: list[str], gone: Column | DataFrame, on: list[str] | None = None) -> int:
    """Delete rows of a table that is partitioned by the columns ``by``: those that fulfil a condition, or that have a
    partner in a DataFrame by the columns ``on``. Returns how many partitions were touched.

    Only partitions that hold such rows are written again; the others keep their files. What stays is staged in the shared
    folder first, since a table can't be overwritten while it is read, so a run that fails leaves the table as it was or
    with some partitions done, and doing it again ends the work.
    """
    table = spark.read.parquet(path)
    condition = isinstance(gone, Column)
    hit = table.filter(gone) if condition else table.join(gone.select(*on).distinct(), on, "left_semi")
    touched = hit.select(*by).distinct().collect()  # one row per partition
    if not touched:
        return 0
    places = spark.createDataFrame(touched, table.select(*by).schema)
    same = [table[c].eqNullSafe(places[c]) for c in by]
    there = table.join(F.broadcast(places), same, "left_semi")
    left = there.filter(~F.coalesce(gone, F.lit(False))) if condition else there.join(gone.select(*on).distinct(), on, "left_anti")
    staged = materialize(left.select(*table.columns), "rewritten")
    still = {tuple(r) for r in staged.select(*by).distinct().collect()}
    staged.repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)
    for row in touched:
        if tuple(row) not in still:  # nothing is left of it, so the write didn't name it
            delete_table(spark, path + "".join(f"/{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in zip(by, row)))
    return len(touched)
