"""Sinks and runners for streams that end when everything available has been read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import new_table_path


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over all available input into a table in the shared folder (or ``path``), and read that table."""
    spark = stream.sparkSession
    path = path or new_table_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, name: str, body: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run a stream through ``body(batch, batch_id, data_path)`` and return the data path."""
    path = new_table_path(stream.sparkSession, name)
    data = f"{path}/data"
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: body(batch, number, data)).outputMode(mode)
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return data


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    """Each batch has a folder of its own, so a replay replaces its rows instead of adding them again."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")


def insert_batch(keys: list[str], buckets: int = 64, most: int = 8) -> Callable[[DataFrame, int, str], None]:
    """A body that stores each key once: replays and repeats across batches add nothing.

    The store is :class:`KeyedStore`. Of rows with one key in a batch, the one with the smallest hash stays.
    """

    def body(batch: DataFrame, number: int, path: str) -> None:
        KeyedStore(batch.sparkSession, path, keys, buckets, most).insert(batch, number)

    return body


class KeyedStore:
    """Stored rows in hash buckets of their keys, for batches that must know which keys are stored.

    Each batch writes one folder, ``data/<number>/bucket=<b>``, and then a manifest that lists the folders of every bucket. A
    batch reads the buckets its own keys fall into and no others. A bucket that already has ``most`` folders is written anew
    with the batch's rows, so a bucket never has more files than that, however many batches came before. A replayed batch
    starts from the manifest before its own and writes the same folder again; what no manifest of the last two lists is
    deleted. The driver holds the manifest: at most ``buckets * most`` names.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, most: int = 8):
        self.spark, self.path, self.keys, self.buckets, self.most = spark, path, keys, buckets, most
        self.files_read = 0

    def _folder(self, name: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder, files = self._folder("manifest")
        if not files.exists(folder):
            return []
        names = [s.getPath() for s in files.listStatus(folder)]
        done = [n for n in names if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
        return sorted(int(n.getName()) for n in done)

    def listed(self, before: int | None = None) -> dict[int, list[str]]:
        """The folders of each bucket by the latest manifest (of a batch before ``before``)."""
        numbers = [n for n in self._manifests() if before is None or n < before]
        out: dict[int, list[str]] = {}
        if numbers:
            for r in self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/manifest/{numbers[-1]}").collect():
                out.setdefault(r["bucket"], []).append(r["folder"])
        return out

    def read(self, schema: StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def insert(self, batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rest = [c for c in batch.columns if c not in self.keys]
        first = F.min_by(F.struct(*rest), F.xxhash64(*rest)) if rest else F.first(F.lit(True))
        own = batch.groupBy(*self.keys).agg(first.alias("_rest")).select(
            *self.keys, *[F.col("_rest")[c].alias(c) for c in rest]).select(*batch.columns)
        live = self.listed(before=number)
        # a batch may be read twice: for its buckets, and to store it
        touched = sorted(r["b"] for r in batch.select(bucket.alias("b")).distinct().collect())
        folders = [f for b in touched for f in live.get(b, [])]
        stored = self.read(batch.schema, folders)
        self.files_read = len(stored.inputFiles()) if folders else 0
        same = [own[k].eqNullSafe(stored[k]) for k in self.keys]
        fresh = own.join(stored, same, "left_anti") if folders else own
        full = [b for b in touched if len(live.get(b, [])) >= self.most]
        if full:
            fresh = fresh.unionByName(self.read(batch.schema, [f for b in full for f in live[b]]))
        data = f"data/{number}"
        fresh.withColumn("bucket", bucket).repartition(min(self.buckets, max(1, len(touched))), "bucket").write.mode(
            "overwrite").partitionBy("bucket").parquet(f"{self.path}/{data}")
        folder, files = self._folder(data)
        written = [s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().startswith("bucket=")]
        for b in full:
            live[b] = []
        for name in written:
            live.setdefault(int(name.split("=")[1]), []).append(f"{data}/{name}")
        names = [(b, f) for b, fs in live.items() for f in fs]
        self.spark.createDataFrame(names, "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        self._sweep(number)

    def _sweep(self, number: int) -> None:
        """Delete folders that neither this batch's manifest nor the one before lists, and older manifests."""
        numbers = [n for n in self._manifests() if n <= number]
        if len(numbers) < 3:
            return
        kept = {f for n in numbers[-2:] for fs in self.listed(before=n + 1).values() for f in fs}
        for f in {f for fs in self.listed(before=numbers[-2]).values() for f in fs} - kept:
            folder, files = self._folder(f)
            files.delete(folder, True)
        for n in numbers[:-2]:
            folder, files = self._folder(f"manifest/{n}")
            files.delete(folder, True)


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of a keyed store."""
    store = KeyedStore(spark, path, [])
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return store.read(shape, [f for fs in store.listed().values() for f in fs])
