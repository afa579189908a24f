"""Source trees and archives as tables, and the writers of the fact tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_BYTES_PER_BATCH = 32 << 20


def text_of(content: Column) -> Column:
    """Bytes as text; bad sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def read_sources(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Every file below a folder: ``(path, content, length)``, with paths relative to the folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = folder.rstrip("/") + "/"
    # the scheme Spark puts before a path varies, so cut after the folder's own text
    path = F.substring_index(F.col("path"), base, -1)
    return reader.load(folder).select(path.alias("path"), text_of(F.col("content")).alias("content"), "length")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of each archive, a few at a time, so that one large archive never sits unpacked in memory."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names, data, size = [], [], 0
                for info in archive.infolist():
                    if info.filename.endswith("/") or info.filename.startswith("__MACOSX"):
                        continue
                    names.append(f"{path.removesuffix('.zip')}/{info.filename}")
                    data.append(archive.read(info))
                    size += info.file_size
                    if size >= MEMBER_BYTES_PER_BATCH:
                        yield pd.DataFrame({"path": names, "content": data})
                        names, data, size = [], [], 0
                if names:
                    yield pd.DataFrame({"path": names, "content": data})


def unpack(archives: DataFrame, partitions: int | None = None) -> DataFrame:
    """Files inside zip archives ``(path, content)``; one task per archive, then spread over the cluster."""
    files = archives.select("path", "content").mapInPandas(_members, "path string, content binary")
    spread = files.repartition(partitions, "path") if partitions else files.repartition("path")
    return spread.select("path", text_of(F.col("content")).alias("content"))


def read_archives(spark: SparkSession, glob: str) -> DataFrame:
    """Files inside all archives that match a path pattern."""
    return unpack(spark.read.format("binaryFile").load(glob))


def write_graphs(df: DataFrame, path: str, keys: list[str], mode: str = "append") -> None:
    """Graph tables: one row per key, laid out by repository so that a read of one touches its folders only.

    A file that is written again adds nothing: keys that are stored are left out, and of rows with one key the smallest
    is taken. Rows are dealt out by repository and a bucket of the file before the write, so a repository gets at most
    as many files as it has buckets, and a large one is written by several tasks.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else df.distinct()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if mode == "append" and where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    bucketed(rows.select(*df.columns)).repartition("repo_id", "bucket").drop("bucket").write.mode(mode).partitionBy("repo_id").parquet(path)


def graph_outcome(df: DataFrame) -> DataFrame:
    """Counts per file as (persisted, failed): a failed build is (0, -1), no graph at all (0, 0).

    ``df(file_id, built boolean, scope)``, scope null when the file gave no graph.
    """
    return df.groupBy("file_id").agg(
        F.count("scope").alias("persisted"),
        F.when(F.bool_and("built"), F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("failed"),
    ).withColumn("persisted", F.when(F.col("failed") < 0, F.lit(0)).otherwise(F.col("persisted")))


def bucketed(df: DataFrame, buckets: int = 64) -> DataFrame:
    """Add a bucket of the file id: a layout column that no hot repository can fill by itself."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))


def get_rows(table: DataFrame, repo_id: object, file_id: object | None = None) -> DataFrame:
    """Rows of one repository or file: equality filters that prune folders and reach the scan."""
    kept = table.filter(F.col("repo_id") == F.lit(repo_id))
    return kept if file_id is None else kept.filter(F.col("file_id") == F.lit(file_id))


def write_text(df: DataFrame, folder: str, column: str | None = None) -> None:
    """Prompt sets and reports: one column as text, or whole rows as JSON lines."""
    if column is None:
        df.write.mode("errorifexists").json(folder)
    else:
        line = F.replace(F.replace(F.replace(F.col(column), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        df.select(line.alias("value")).write.mode("errorifexists").text(folder)


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that :func:`write_text` wrote as lines, as they were."""
    # backslashes were doubled, so a mark can stand for them while the others are put back
    value = F.replace(F.col("value"), F.lit("\\\\"), F.lit("\u0000"))
    value = F.replace(F.replace(value, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return spark.read.text(folder).select(F.replace(value, F.lit("\u0000"), F.lit("\\")).alias("value"))
