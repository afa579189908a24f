"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # tables of one file share the hash partitioning on its id, so joins between them need no second shuffle
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows may be whole files: Python's memory follows a batch of them
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # a run with very many heartbeats is merged on the map side
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the library's SQL settings on a given session; all of them can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "codefacts", shared: str | None = None) -> SparkSession:
    """A session on this machine, for tests and the bench; ``shared`` is its folder for work tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it, or where that is unset a
    folder of the warehouse, which Spark's own tables need to be shared as well. Never a machine-local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/codefacts_work").rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more; works on any file system Spark can write to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on any file system Spark can read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

