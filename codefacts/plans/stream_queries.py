"""Streaming queries, sources and sinks: each runs over everything available and is read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from ..session import new_table_path
from ..sources import files as sources
from ..streaming import runs, sinks
from ..streaming import sources as arriving
from . import bindings as b
from .access_queries import FOLD_SQL
from .registry import query
from .search_queries import PROMPTS, prompt_sets


def events(spark: SparkSession, folder: str) -> DataFrame:
    return arriving.stream_table(spark, f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def plain_times(df: DataFrame) -> DataFrame:
    """Event times without zone again, as in the given table."""
    times = [c for c, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query("stream_stale_runs", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
 SELECT user_id AS run_id, min(ts) AS first_heartbeat_at, max(ts) AS finished_at, count(*) AS heartbeats FROM n
 GROUP BY user_id, sid""")
def stream_stale_runs(spark: SparkSession, folder: str) -> DataFrame:
    beats = events(spark, folder).select(F.col("user_id").alias("run_id"), "ts")
    return plain_times(runs.run_stale_sessions(beats, seconds=3 * 3600))


@query("stream_run_state", FOLD_SQL)
def stream_run_state(spark: SparkSession, folder: str) -> DataFrame:
    return plain_times(runs.run_fold(b.run_events(events(spark, folder))))


@query("stream_throttled_progress", """SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n, max(ts) AS flushed_at
 FROM events GROUP BY 1, 2""")
def stream_throttled_progress(spark: SparkSession, folder: str) -> DataFrame:
    return plain_times(runs.run_throttled(events(spark, folder), "user_id", "1 hour", "1 hour"))


@query("stream_insert_once", "SELECT event_id, user_id, event_type FROM events")
def stream_insert_once(spark: SparkSession, folder: str) -> DataFrame:
    once = events(spark, folder).select("event_id", "user_id", "event_type")
    return runs.run_insert(once.unionByName(once), ["event_id"])


@query("stream_first_per_key", "SELECT event_id, ts FROM events")
def stream_first_per_key(spark: SparkSession, folder: str) -> DataFrame:
    twice = events(spark, folder).select("event_id", "ts")
    kept = runs.first_per_key(twice.unionByName(twice), ["event_id"], "ts", "1 hour")
    return plain_times(sinks.run_to_table(kept, "first"))


@query("stream_catalog", f"""WITH {b.FILES} SELECT DISTINCT sha256(repo_id || ':' || path) AS file_id, repo_id, path FROM files""")
def stream_catalog(spark: SparkSession, folder: str) -> DataFrame:
    pages = arriving.stream_table(spark, f"{folder}/pages.parquet")
    rows = pages.select(
        F.regexp_extract("url", b.HOST, 1).alias("repo_id"),
        F.rtrim(F.regexp_extract("url", b.URL_PATH, 1), F.lit("/")).alias("path"))
    return arriving.run_catalog(rows)


@query("stream_facts", """WITH p AS (SELECT p_partkey AS file_id, p_size + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END AS n FROM part
  WHERE p_partkey % 7 <> 0)
 SELECT file_id, 'method:v' || n || '.V' || file_id || '#m(int):int' AS method_key, 'return a + ' || n AS text FROM p""")
def stream_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Files arrive three times: all of them, a third of them changed beside unchanged ones, and a seventh of them deleted."""
    root = new_table_path(spark, "arriving")
    part = b.table(spark, folder, "part")
    for version, rows in enumerate((part, part.filter("p_partkey % 3 < 2"), part.filter("p_partkey % 7 = 0"))):
        n = F.col("p_size") + F.when((F.col("p_partkey") % 3 == 0) & F.lit(version == 1), 100).otherwise(0)
        rows.select(
            F.col("p_brand").alias("repo_id"), F.col("p_partkey").alias("file_id"), F.format_string("v/%d.java", "p_partkey").alias("path"),
            F.format_string("package v%d; class V%d { int m(int a) { return a + %d; } }", n, "p_partkey", n).alias("content"),
            F.lit(version == 2).alias("deleted"), F.lit(version).alias("version"),
        ).coalesce(1).write.mode("append").parquet(root)
    store = incremental.FactStore(spark, new_table_path(spark, "fact_store"), {"statements": lambda code: code.statements}, buckets=16)
    incremental.run_facts(arriving.stream_table(spark, root, files_per_trigger=1), store, "version")
    return store.read("statements").select("file_id", "method_key", "text")


def _zip(batches):
    """One archive per row: its text as a file, next to entries that ingest must skip."""
    for batch in batches:
        packed = []
        for path, content in zip(batch["path"], batch["content"]):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("src/", b"")
                archive.writestr("src/text.txt", content.encode())
                archive.writestr("__MACOSX/src/text.txt", b"-")
            packed.append(data.getvalue())
        yield pd.DataFrame({"path": batch["path"] + ".zip", "content": packed})


@query("archive_files", f"""WITH {b.DOCS} SELECT path || '/src/text.txt' AS path, content FROM docs""")
def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    packed = b.documents(spark, folder).select("path", "content").mapInPandas(_zip, "path string, content binary")
    return sources.unpack(packed)


SEPARATOR = "\u0000"


@query("source_tree_scan", f"""WITH {b.DOCS} SELECT repo_id, CAST(sum(length(content)) AS BIGINT) AS characters, count(*) AS texts
 FROM docs GROUP BY repo_id""")
def source_tree_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written into files below a folder per repository, and read back as a source tree."""
    root = new_table_path(spark, "tree")
    docs = b.documents(spark, folder)
    # a scanned file becomes one row, so no file may grow without end
    docs.select("repo_id", F.col("content").alias("value")).write.partitionBy("repo_id").option(
        "maxRecordsPerFile", 200).option("lineSep", SEPARATOR).text(root)
    read = sources.read_sources(spark, root, "*.txt")
    bare = F.length(F.replace("content", F.lit(SEPARATOR), F.lit("")))
    repo = F.regexp_extract("path", r"^repo_id=([^/]+)/", 1)
    return read.groupBy(repo.alias("repo_id")).agg(
        F.sum(bare).alias("characters"), F.sum(F.length("content") - bare).alias("texts"))


@query("graph_tables", f"""WITH {b.DOCS} SELECT repo_id, file_id, lang AS scope FROM docs""")
def graph_tables(spark: SparkSession, folder: str) -> DataFrame:
    root = new_table_path(spark, "graphs")
    graphs = b.documents(spark, folder).select("repo_id", "file_id", F.col("lang").alias("scope"))
    sources.write_graphs(graphs.unionByName(graphs), root, ["repo_id", "file_id", "scope"])
    return spark.read.parquet(root).select("repo_id", "file_id", "scope")


@query("graph_table_rows", f"""WITH {b.DOCS} SELECT repo_id, file_id, lang AS scope FROM docs""")
def graph_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a graph table whose files were written twice, those of the hot language too."""
    root = new_table_path(spark, "graphs")
    graphs = b.documents(spark, folder).select("repo_id", "file_id", F.col("lang").alias("scope"))
    sources.write_graphs(graphs.unionByName(graphs), root, ["repo_id", "file_id", "scope"])
    return spark.read.parquet(root).select("repo_id", "file_id", "scope")


@query("written_prompts", PROMPTS)
def written_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole prompts written as JSON lines and read back."""
    root = new_table_path(spark, "prompts")
    sources.write_text(prompt_sets(spark, folder), root)
    return spark.read.schema("file_id long, prompt string").json(root)


@query("written_texts", PROMPTS.replace("SELECT file_id, ", "SELECT ").replace("AS prompt", "AS prompt"))
def written_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts written as lines of text, in which line breaks are escaped, and read back."""
    root = new_table_path(spark, "texts")
    sources.write_text(prompt_sets(spark, folder), root, "prompt")
    return sources.read_text(spark, root).withColumnRenamed("value", "prompt")
