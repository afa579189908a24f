"""The given tables in the shape the operators expect, each with its SQL as a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOST = r"^[a-z]+://([^/?#]+)"
URL_PATH = r"^[a-z]+://[^/?#]+/?([^?#]*)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as files: host as repository, URL path as path."""
    pages = table(spark, folder, "pages")
    path = F.rtrim(F.regexp_extract("url", URL_PATH, 1), F.lit("/"))
    return pages.select(
        F.col("page_id").alias("file_id"), F.regexp_extract("url", HOST, 1).alias("repo_id"), path.alias("path")
    )


FILES = f"""files AS (SELECT page_id AS file_id, regexp_extract(url, '{HOST}', 1) AS repo_id,
 rtrim(regexp_extract(url, '{URL_PATH}', 1), '/') AS path FROM pages)"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of their source."""
    return table(spark, folder, "documents").select(
        F.col("source").alias("repo_id"), F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"),
        "lang", F.col("text").alias("content"),
    )


DOCS = """docs AS (SELECT source AS repo_id, doc_id AS file_id,
 source || '/' || lang || '/' || doc_id AS path, lang, text AS content FROM documents)"""


def accesses(spark: SparkSession, folder: str) -> DataFrame:
    """Events as variable accesses of a scope per user."""
    key = F.regexp_extract("props", r"(\d+)", 1)
    op = (
        F.when(F.col("event_type").isin("purchase", "signup"), "def").when(F.col("event_type") == "error", "write")
        .otherwise("use")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), F.concat(F.lit("k"), key).alias("var_key"),
        F.concat(F.lit("v"), F.substring(key, 1, 1)).alias("variable"), op.alias("op"),
    )


ACCESSES = r"""acc AS (SELECT user_id AS scope, event_id AS seq, 'k' || regexp_extract(props, '(\d+)', 1) AS var_key,
 'v' || substr(regexp_extract(props, '(\d+)', 1), 1, 1) AS variable,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 'def' WHEN event_type = 'error' THEN 'write' ELSE 'use' END AS op
 FROM events)"""


def type_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Per user the event types as nodes, and a numbered edge for each pair of types that follow each other."""
    from ..operators.graph import one_edge_per_pair
    from ..operators.ordering import neighbour

    events = table(spark, folder, "events").select(F.col("user_id").alias("scope"), "event_id", "event_type")
    nodes = events.select("scope", F.col("event_type").alias("node")).distinct()
    steps = neighbour(events, ["scope"], ["event_id"], {"dst": F.col("event_type")}, following=True)
    steps = steps.filter("dst IS NOT NULL").select(
        "scope", F.col("event_type").alias("src"), "dst", F.col("event_id").alias("seq")
    )
    return nodes, one_edge_per_pair(steps, ["scope"], ["seq"])


TYPE_GRAPH = """nodes AS (SELECT DISTINCT user_id AS scope, event_type AS node FROM events),
 steps AS (SELECT user_id AS scope, event_type AS src, event_id AS seq,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events),
 edges AS (SELECT scope, src, dst, min(seq) AS seq FROM steps WHERE dst IS NOT NULL GROUP BY ALL)"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("thread"), "turn", "role", F.col("text").alias("content")
    )


MESSAGES = "msgs AS (SELECT conv_id AS thread, turn, role, text AS content FROM conversations)"


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as links between a user (the order's clerk status) and a repository (the customer)."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("user_id"), F.col("o_custkey").alias("repo_id"),
        F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("linked_at"),
    )


LINKS = """links AS (SELECT o_orderkey AS user_id, o_custkey AS repo_id, o_orderpriority AS name,
 o_orderdate AS linked_at FROM orders)"""


def run_events(events: DataFrame) -> DataFrame:
    """Events as state changes of a run per user; views carry a message only."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "pending").when(kind == "click", "running").when(kind == "purchase", "completed")
        .when(kind == "error", "failed")
    )
    return events.select(
        F.col("user_id").alias("run_id"), "ts", "event_id", status.alias("status"),
        F.when(kind.isin("view", "error"), F.col("props")).alias("message"),
    )


RUN_EVENTS = """ev AS (SELECT user_id AS run_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'pending'
 WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
 CASE WHEN event_type IN ('view', 'error') THEN props END AS message FROM events)"""
