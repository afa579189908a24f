"""Queries over stored records: owners, point reads, stored documents, old formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import access, artifacts, retrieval
from ..session import new_table_path
from ..sources.files import get_rows
from ..sources.json_facts import explode_ast, parse_open, read_fields
from ..sources.layout import GraphStore, rewrite, write_bucketed
from . import bindings as b
from .registry import query


@query("owner_scope", """SELECT c_custkey AS thread, c_mktsegment AS user_id, c_nationkey AS repo_id FROM customer
 WHERE c_mktsegment = 'BUILDING' AND c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_1')""")
def owner_scope(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of one owner in one repository, the feature of which is to leave out all others."""
    rows = b.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("thread"), F.col("c_mktsegment").alias("user_id"), F.col("c_nationkey").alias("repo_id"))
    nation = b.table(spark, folder, "nation").filter("n_name = 'NATION_1'").select(F.col("n_nationkey").alias("repo_id"))
    return access.scoped(rows.join(nation, "repo_id", "left_semi"), "BUILDING", F.col("repo_id"))


@query("point_reads", """SELECT o_orderkey AS file_id, o_orderpriority AS repo_id, o_totalprice FROM orders
 WHERE o_orderpriority = '1-URGENT'""")
def point_reads(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of one repository."""
    rows = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("repo_id"), "o_totalprice")
    return get_rows(rows, "1-URGENT")


PART = "(SELECT *, split_part(p_brand, '#', 1) AS maker FROM part)"


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Each part as a stored document: its brand is a class with a method and two fields, its type an interface."""
    part = b.table(spark, folder, "part").withColumn("maker", F.substring_index("p_brand", "#", 1))
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("int")
    method = F.struct(
        F.concat(F.lit("m"), key).alias("name"), F.concat(F.lit("k"), key).alias("key"), (size + 1).alias("line_start"),
        F.col("p_type").alias("return_type_fqn"), F.concat(F.col("p_brand"), F.lit("()")).alias("signature_simple"))

    def field(n: int):
        return F.struct(F.concat(F.lit(f"f{n}_"), key).alias("name"), F.lit(f"k{n}").alias("key"), (size + n).alias("line_start"),
                        F.lit("int").alias("type_simple"), F.lit("int").alias("type_fqn"))

    cls = F.struct(F.col("p_brand").alias("name"), F.concat_ws(".", "maker", "p_brand").alias("fqn"), key.alias("key"),
                   size.alias("line_start"), F.array(method).alias("methods"), F.array(field(1), field(2)).alias("fields"))
    face = F.struct(F.col("p_type").alias("name"), F.concat_ws(".", "maker", "p_type").alias("fqn"), key.alias("key"),
                    size.alias("line_start"), F.array(method).alias("methods"))
    doc = F.struct(F.col("p_name").alias("file"), key.alias("key"), F.col("maker").alias("package"),
                   F.array(cls).alias("classes"), F.array(face).alias("interfaces"), F.lit("ignored").alias("unknown"))
    return part.select(F.col("maker").alias("repo_id"), F.col("p_partkey").alias("file_id"), F.to_json(doc).alias("content"))


@query("stored_methods", f"""SELECT maker AS repo_id, p_partkey AS file_id, maker || '.' || owner AS owner_fqn, 0::INTEGER AS pos,
 'm' || p_partkey AS name, 'k' || p_partkey AS key, CAST(p_size + 1 AS INTEGER) AS line_start, p_type AS return_type_fqn,
 p_brand || '()' AS signature_simple FROM (SELECT *, unnest([p_brand, p_type]) AS owner FROM {PART})""")
def stored_methods(spark: SparkSession, folder: str) -> DataFrame:
    return explode_ast(_stored(spark, folder))["methods"]


@query("stored_fields", f"""SELECT maker AS repo_id, p_partkey AS file_id, maker || '.' || p_brand AS owner_fqn,
 CAST(n - 1 AS INTEGER) AS pos, 'f' || n || '_' || p_partkey AS name, 'k' || n AS key, CAST(p_size + n AS INTEGER) AS line_start,
 'int' AS type_simple, 'int' AS type_fqn FROM {PART}, (SELECT unnest([1, 2]) AS n)""")
def stored_fields(spark: SparkSession, folder: str) -> DataFrame:
    return explode_ast(_stored(spark, folder))["fields"]


@query("stored_types", f"""SELECT maker AS repo_id, p_partkey AS file_id, kind, 0::INTEGER AS pos,
 CASE kind WHEN 'class' THEN p_brand ELSE p_type END AS name,
 maker || '.' || CASE kind WHEN 'class' THEN p_brand ELSE p_type END AS fqn, p_partkey::VARCHAR AS key,
 CAST(p_size AS INTEGER) AS line_start FROM {PART}, (SELECT unnest(['class', 'interface']) AS kind)""")
def stored_types(spark: SparkSession, folder: str) -> DataFrame:
    return explode_ast(_stored(spark, folder))["types"]


@query("old_format_methods", """SELECT event_id, event_type IN ('view', 'click') AND event_type <> 'click' AS is_legacy FROM events""")
def old_format_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Events as stored methods: a view has a plain return type only, a click a resolved one, others none."""
    event = F.col("event_type")
    plain, full = F.create_map(F.lit("return_type"), event), F.create_map(F.lit("return_type"), event, F.lit("return_type_fqn"), event)
    method = F.when(event == "view", plain).when(event == "click", full).otherwise(F.create_map(F.lit("name"), event))
    return b.table(spark, folder, "events").select("event_id", labels.is_legacy_method(method).alias("is_legacy"))


@query("summary_view", """SELECT p_partkey AS repo_id, coalesce(s_name, 'No metadata found for this repository.') AS view
 FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def summary_view(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as repositories; the supplier of the same number, where there is one, is the summary."""
    meta = b.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("repo_id"), F.col("s_name").alias("content"))
    return artifacts.view_summary(b.table(spark, folder, "part").select(F.col("p_partkey").alias("repo_id")), meta)


@query("chunks_by_separator")
def chunks_by_separator(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in chunks that end at paragraphs, lines or words; a test holds them against a plain version."""
    return retrieval.chunk_by_separator(b.documents(spark, folder))


@query("open_facts", r"""SELECT event_id, CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) END AS k,
 CASE event_id % 4 WHEN 1 THEN user_id END AS first_tag, CASE event_id % 4 WHEN 1 THEN '{"by":"' || event_type || '","tags":[' || user_id || ',"x"]}' END AS meta,
 CASE event_id % 4 WHEN 2 THEN left(props, length(props) - 1) END AS bad_record, CASE event_id % 4 WHEN 3 THEN '"many"' END AS k_text FROM events""")
def open_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Props as they are, with a field that no schema names, cut off, and with a field of another type."""
    turn = F.col("event_id") % 4
    more = F.concat(F.lit(', "meta": {"by": "'), "event_type", F.lit('", "tags": ['), F.col("user_id").cast("string"), F.lit(', "x"]}}'))
    bare = F.substring(F.col("props"), F.lit(1), F.length("props") - 1)
    content = F.when(turn == 1, F.concat(bare, more)).when(turn == 2, bare).when(turn == 3, F.lit('{"k": "many"}')).otherwise(F.col("props"))
    parsed = parse_open(b.table(spark, folder, "events").select("event_id", content.alias("content")))
    known = read_fields(parsed, {"k": ("$.k", "bigint"), "first_tag": ("$.meta.tags[0]", "bigint")})
    kept = read_fields(parsed, {"k": ("$.k", "bigint")}).select("event_id", F.col("rest")["meta"].alias("meta"))
    text = F.when(F.col("k").isNull(), F.to_json(F.try_variant_get("doc", "$.k", "variant")))
    return known.withColumn("k_text", text).join(kept, "event_id").select("event_id", "k", "first_tag", "meta", "bad_record", "k_text")


@query("bucketed_reads", """SELECT o_orderkey AS file_id, o_orderpriority AS repo_id, o_totalprice FROM orders
 WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)""")
def bucketed_reads(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of one file, from the one bucket that can hold it."""
    rows = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("repo_id"), "o_totalprice")
    stored = write_bucketed(rows, ["file_id"], 16, "orders")
    return stored.filter(F.col("file_id") == stored.agg(F.max("file_id")).first()[0])


@query("bucketed_graphs", """WITH c AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS cfg,
  string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS dfg FROM orders GROUP BY ALL)
 SELECT c_custkey AS file_id, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS ast, coalesce(cfg, '') AS cfg, coalesce(dfg, '') AS dfg
 FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def bucketed_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Files with their graphs, from tables that lie in the same buckets."""
    owners = b.table(spark, folder, "customer")
    graphs = b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").cast("string").alias("scope"), F.col("o_orderpriority").alias("content"), "o_orderstatus")
    store = GraphStore({
        "files": owners.select(F.col("c_custkey").alias("file_id")),
        "ast": owners.filter("c_acctbal > 0").select(F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("content")),
        "cfg": graphs.drop("o_orderstatus"), "dfg": graphs.filter("o_orderstatus = 'F'").drop("o_orderstatus")}, buckets=16)
    names = {kind: F.array_join(F.transform(kind, lambda g: g["scope"]), ",") for kind in ("cfg", "dfg")}
    return store.with_graphs(page_size=1_000_000).withColumns(names).select("file_id", "ast", "cfg", "dfg")


@query("purged_table", """SELECT o_orderkey AS run_id, year(o_orderdate)::INTEGER AS started FROM orders
 WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-07-01') AND NOT (o_orderkey % 10 = 0 AND year(o_orderdate) = 2000)""")
def purged_table(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table of runs by year: old finished runs go by a condition, and some runs of one year by a list."""
    path = new_table_path(spark, "run_table")
    runs = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").alias("started"))
    runs.repartition("started").write.partitionBy("started").parquet(path)
    rewrite(spark, path, ["started"], (F.col("status") == "F") & (F.col("created_at") < F.lit("1997-07-01").cast("timestamp")))
    rewrite(spark, path, ["started"], runs.filter("run_id % 10 = 0 AND started = 2000").select("run_id"), on=["run_id"])
    return spark.read.parquet(path).select("run_id", "started")
