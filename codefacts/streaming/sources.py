"""Arriving files and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import catalog_rows
from ..sources.files import unpack
from .sinks import insert_batch, read_batches, run_batches

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a stream of its files, with the table's own schema.

    The last letter goes into a glob class, because the file source takes a plain path for a folder only.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    bare = path.rstrip("/")
    return reader.parquet(f"{bare[:-1]}[{bare[-1]}]")


def stream_archives(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Archives as they arrive in a folder."""
    return (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.zip")
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )


def run_archive_catalog(archives: DataFrame, repo_id) -> DataFrame:
    """Catalog (file_id, repo_id, path) of all files in arriving archives; ``repo_id`` maps a path to its owner."""
    spark = archives.sparkSession
    insert = insert_batch(["repo_id", "path"])

    def body(batch: DataFrame, number: int, path: str) -> None:
        files = unpack(batch).select("path").withColumn("repo_id", repo_id(F.col("path")))
        insert(catalog_rows(files), number, path)

    path = run_batches(archives, "archives", body)
    return read_batches(spark, path, "file_id string, repo_id string, path string")


def run_catalog(files: DataFrame) -> DataFrame:
    """Catalog of a stream of (repo_id, path) rows, each file once."""
    insert = insert_batch(["repo_id", "path"])
    path = run_batches(files, "catalog", lambda batch, number, at: insert(catalog_rows(batch), number, at))
    return read_batches(files.sparkSession, path, "file_id string, repo_id string, path string")
