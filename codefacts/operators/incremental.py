"""Facts that are kept up to date: only files whose content changed are read again.

Every table of facts is stored in hash buckets of the file id. An update reads the hashes of the files it brings, computes
facts of the new and changed ones, and rewrites the buckets these files and the deleted ones lie in; the others keep their
files. The table of hashes is written last, so an update that fails half way is done again as a whole, and one that is
repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_table, exists, materialize, new_table_path
from .facts import CodeFacts
from .flow import Flow

#: Name of each stored table, and how it is made from the facts of some files.
TABLES: dict[str, Callable[[CodeFacts], DataFrame]] = {
    "failed": lambda code: code.failed,
    "imports": lambda code: code.imports,
    "types": lambda code: code.types,
    "fields": lambda code: code.fields,
    "methods": lambda code: code.methods,
    "statements": lambda code: code.statements,
    "symbols": lambda code: code.symbols,
    "cfg_edges": lambda code: Flow(code).cfg_edges,
}
HASHES = "repo_id, path, file_hash"


class FactStore:
    """Stored facts below ``path``; ``buckets`` must stay the same for one store."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Callable[[CodeFacts], DataFrame]] | None = None, buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path, TABLES if tables is None else tables, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("file_id"), F.lit(self.buckets)).cast("int")

    def read(self, name: str) -> DataFrame | None:
        """A table of facts, or None before the first update."""
        where, shape = f"{self.path}/{name}", f"{self.path}/schema/{name}"
        # the schema is a table without rows, since all files of a store may be deleted
        return self.spark.read.schema(self.spark.read.parquet(shape).schema).parquet(where).drop("bucket") if exists(self.spark, where) else None

    def _replace(self, name: str, gone: DataFrame, rows: DataFrame, buckets: list[int]) -> None:
        """Put ``rows`` in the place of all rows of the files ``gone``, in their buckets only."""
        where = f"{self.path}/{name}"
        rows = rows.withColumn("bucket", self._bucket())
        if exists(self.spark, where):
            held = self.spark.read.schema(rows.schema).parquet(where).filter(F.col("bucket").isin(buckets))
            rows = held.join(gone, "file_id", "left_anti").unionByName(rows)
        staged = new_table_path(self.spark, "facts")  # a table can't be read while it is overwritten
        rows.write.parquet(staged)
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema/{name}")
        new = self.spark.read.schema(rows.schema).parquet(staged)
        left = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        new.repartition(max(1, len(buckets)), "bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(where)
        for b in set(buckets) - left:  # a bucket whose last file went is no part of the output
            delete_table(self.spark, f"{where}/bucket={b}")
        delete_table(self.spark, staged)

    def update(self, arrivals: DataFrame) -> int:
        """Take ``arrivals(repo_id, file_id, path, content, deleted)``, one row per file; returns how many files were read.

        A file whose path and content are as stored is not read; a deleted file loses its facts. A null content is an
        empty file.
        """
        content = F.coalesce(F.col("content").cast("string"), F.lit(""))
        came = arrivals.withColumns({"content": content, "deleted": F.coalesce("deleted", F.lit(False)), "file_hash": F.sha2(content, 256)})
        known = self.read("hashes")
        if known is None:
            came = came.withColumn("_same", F.lit(False)).withColumn("_known", F.lit(False))
        else:
            old = known.select("file_id", F.struct(*HASHES.split(", ")).alias("_old"))
            came = came.join(old, "file_id", "left").withColumn("_known", F.col("_old").isNotNull()).withColumn(
                "_same", F.coalesce(F.col("_old") == F.struct(*HASHES.split(", ")), F.lit(False))).drop("_old")
        moved = materialize(came.filter(F.when(F.col("deleted"), F.col("_known")).otherwise(~F.col("_same"))), "arrivals")
        gone = moved.select("file_id").distinct()
        buckets = sorted(r["b"] for r in moved.select(self._bucket().alias("b")).distinct().collect())
        if not buckets:
            return 0
        fresh = moved.filter(~F.col("deleted"))
        code = CodeFacts(fresh.select("repo_id", "file_id", "path", "content"))
        for name, table in self.tables.items():
            self._replace(name, gone, table(code), buckets)
        self._replace("hashes", gone, fresh.select("file_id", *HASHES.split(", ")), buckets)
        return fresh.count()


def latest_arrivals(batch: DataFrame, order: str) -> DataFrame:
    """One row per file of a batch that may bring a file more than once: the last by ``order``."""
    rest = [c for c in batch.columns if c not in ("file_id", order)]
    return batch.groupBy("file_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("file_id", "_r.*")


def run_facts(arrivals: DataFrame, store: FactStore, order: str) -> list[int]:
    """Follow a stream ``(repo_id, file_id, path, content, deleted, <order>)`` until everything available is in the store;
    returns how many files each batch read."""
    read: list[int] = []
    query = (
        arrivals.writeStream.foreachBatch(lambda batch, _: read.append(store.update(latest_arrivals(batch, order))))
        .option("checkpointLocation", f"{store.path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read
