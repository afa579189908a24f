"""Queries over texts, keys and labels: one pass over the rows, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, labels, text
from . import bindings as b
from .registry import query

NOW = "2024-02-01 00:00:00"


@query("truncate_marked", """SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || chr(10) || chr(10)
 || '[...truncated, ' || length(text) || ' chars total]' ELSE text END AS shown FROM documents""")
def truncate_marked(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "documents").select("doc_id", text.truncate_marked(F.col("text"), 300).alias("shown"))


@query("truncate_omitted", """SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || chr(10)
 || '... [TRUNCATED — ' || (length(text) - 300) || ' chars omitted]' ELSE text END AS shown FROM documents""")
def truncate_omitted(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "documents").select("doc_id", text.truncate_omitted(F.col("text"), 300).alias("shown"))


@query("truncate_json", """WITH j AS (SELECT doc_id, '{' || chr(10) || '  "doc_id" : ' || doc_id || ',' || chr(10) || '  "lang" : ' || to_json(lang) || ',' || chr(10)
  || '  "source" : ' || to_json(source) || ',' || chr(10) || '  "text" : ' || to_json(text) || chr(10) || '}' AS v FROM documents)
 SELECT doc_id, CASE WHEN length(v) > 500 THEN substr(v, 1, 500) || chr(10) || '... [TRUNCATED — ' || (length(v) - 500) || ' chars omitted]' ELSE v END AS shown FROM j""")
def truncate_json(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.table(spark, folder, "documents")
    value = F.struct("doc_id", "lang", "source", "text")
    return docs.select("doc_id", text.truncate_json(value, 500).alias("shown"))


@query("conversation_titles", """SELECT conv_id, turn, CASE WHEN length(text) <= 50 THEN text
 ELSE regexp_replace(substr(text, 1, 47), ' [^ ]*$', '') || '...' END AS title FROM conversations""")
def conversation_titles(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "conversations").select("conv_id", "turn", text.title(F.col("text")).alias("title"))


@query("query_preview", """SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END
 AS preview FROM documents""")
def query_preview(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("literal_search", """SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the ')""")
def literal_search(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "conversations").filter(text.icontains(F.col("text"), "THE ")).select("conv_id", "turn")


@query("statement_keys", """SELECT doc_id, 'stmt:' || source || ':' || CASE WHEN lang = 'en' THEN n_chars ELSE 0 END || ':'
 || lang || ':' || substr(sha1(text), 1, 8) AS key, CASE WHEN lang = 'en' THEN 'stmt:' || source || ':' || n_chars || ':'
 || lang || ':' || substr(sha1(text), 1, 8) END AS graph_key FROM documents""")
def statement_keys(spark: SparkSession, folder: str) -> DataFrame:
    line = F.when(F.col("lang") == "en", F.col("n_chars"))
    args = F.col("source"), line, F.upper("lang"), F.col("text")
    return b.table(spark, folder, "documents").select(
        "doc_id", keys.stmt_key(*args).alias("key"), keys.stmt_key(*args, null_without_line=True).alias("graph_key"))


@query("chunk_ids", "SELECT doc_id, sha256(source || ':' || lang || ':' || n_chars) AS id FROM documents")
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "documents").select(
        "doc_id", keys.chunk_id(F.col("source"), F.col("lang"), F.col("n_chars")).alias("id"))


@query("user_keys", """SELECT c_custkey, sha256(CASE WHEN c_acctbal > 0 THEN 'azure:' || c_mktsegment || ':' || c_name
 ELSE 'oidc:' || c_nationkey || ':' || c_name END) AS user_key FROM customer""")
def user_keys(spark: SparkSession, folder: str) -> DataFrame:
    tenant = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    issuer = F.col("c_nationkey").cast("string")
    return b.table(spark, folder, "customer").select(
        "c_custkey", keys.user_key(tenant, F.col("c_name"), issuer, F.col("c_name")).alias("user_key"))


METHOD_SQL = "'method:' || p_brand || '#f' || p_partkey || '(' || replace(p_type, ' ', ',') || '):' || p_size"


@query("canonical_keys", f"""SELECT p_partkey, 'type:' || p_brand || '.' || p_name AS type_key, {METHOD_SQL} AS method_key,
 'field:' || p_brand || '#' || p_name || ':' || p_type AS field_key, 'param:' || {METHOD_SQL} || ':' || p_name AS param_key,
 'local:' || {METHOD_SQL} || ':0:' || p_name AS local_key, 'file:' || p_brand AS file_key,
 'f' || p_partkey || '(' || replace(p_type, ' ', ',') || ')' AS signature,
 CASE WHEN p_type <> p_name THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, p_size AS line_start FROM part""")
def canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    brand, name, kind = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    method_name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    types = F.split(kind, " ")
    method = keys.method_key(brand, method_name, types, F.col("p_size").cast("string"))
    return b.table(spark, folder, "part").select(
        "p_partkey", keys.type_key(keys.fqn(brand, name)).alias("type_key"), method.alias("method_key"),
        keys.field_key(brand, name, kind).alias("field_key"), keys.param_key(method, name).alias("param_key"),
        keys.local_key(method, name).alias("local_key"), keys.file_key(brand).alias("file_key"),
        keys.signature(method_name, types).alias("signature"), keys.confidence(kind, name).alias("confidence"),
        keys.source_ref(brand, F.col("p_size"), F.col("p_size")).line_start.alias("line_start"),
    )


@query("scope_labels", f"""WITH {b.FILES}, s AS (SELECT file_id, 'method:' || repo_id || '#' || path AS scope, repo_id, path
 FROM files) SELECT file_id, regexp_extract(repo_id, '[^.]*$', 0) || '#' || path AS label, repo_id AS bare,
 '(global)' AS missing FROM s""")
def scope_labels(spark: SparkSession, folder: str) -> DataFrame:
    repo, path = F.col("repo_id"), F.col("path")
    return b.files(spark, folder).select(
        "file_id", labels.scope_label(F.concat(F.lit("method:"), repo, F.lit("#"), path)).alias("label"),
        labels.scope_label(F.concat(F.lit("type:"), repo)).alias("bare"),
        labels.scope_label(F.nullif(repo, repo)).alias("missing"))


@query("node_labels", """SELECT event_id, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN 'click k' || user_id
 WHEN 'error' THEN 'k' || user_id WHEN 'signup' THEN event_type ELSE CAST(event_id AS VARCHAR) END AS label FROM events""")
def node_labels(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    variable = F.when(kind.isin("click", "error"), F.concat(F.lit("k"), F.col("user_id").cast("string")))
    return b.table(spark, folder, "events").select("event_id", labels.node_label(
        F.when(kind == "view", F.col("props")), F.when(kind == "click", kind), variable,
        F.when(kind == "signup", kind), F.col("event_id")).alias("label"))


@query("member_labels", """SELECT p_partkey, p_name || '(): ' || regexp_extract(p_type, '[^ ]*$', 0) AS method_label,
 p_name || ': ' || regexp_extract(p_type, '[^ ]*$', 0) AS field_label FROM part""")
def member_labels(spark: SparkSession, folder: str) -> DataFrame:
    dotted = F.replace(F.col("p_type"), F.lit(" "), F.lit("."))
    none = F.lit(None).cast("string")
    return b.table(spark, folder, "part").select(
        "p_partkey", labels.method_label(none, F.col("p_name"), dotted).alias("method_label"),
        labels.field_label(F.col("p_name"), none, dotted).alias("field_label"))


@query("old_format_graphs", """SELECT user_id, bool_or(event_type = 'error') AS legacy FROM events GROUP BY user_id""")
def old_format_graphs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "condition").otherwise(F.col("event_type"))
    return b.table(spark, folder, "events").groupBy("user_id").agg(F.bool_or(labels.is_legacy_node(kind)).alias("legacy"))


@query("message_context", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND role <> 'user'
 THEN '[Context: ' || lang_file || ' > node ' || turn || '] ' || text ELSE text END AS content,
 CASE WHEN turn % 2 = 0 AND role = 'user' THEN lang_file END AS file_name,
 CASE WHEN turn % 2 = 0 AND role = 'user' THEN 'node ' || turn END AS node_label
 FROM (SELECT *, 'conv' || conv_id || '.txt' AS lang_file FROM conversations)""")
def message_context(spark: SparkSession, folder: str) -> DataFrame:
    tag = F.format_string("[Context: conv%d.txt > node %d] ", "conv_id", "turn")
    tagged = F.when(F.col("turn") % 2 == 0, F.concat(tag, "text")).otherwise(F.col("text"))
    return b.table(spark, folder, "conversations").select(
        "conv_id", "turn", text.parse_context(tagged, F.col("role")).alias("c")).select("conv_id", "turn", "c.*")


@query("strip_title", r"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN text || ' {"title": "t"} '
 ELSE regexp_replace(text, '\s+$', '') END AS content FROM conversations""")
def strip_title(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "conversations").select("conv_id", "turn", text.strip_title(
        F.concat("text", F.lit(' {"title": "t"} ')), F.col("role")).alias("content"))


@query("normal_roles", """SELECT CASE WHEN role IN ('human', 'ai', 'user') THEN role ELSE 'assistant' END AS role,
 count(*) AS n FROM conversations GROUP BY 1""")
def normal_roles(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "conversations").groupBy(text.norm_role(F.col("role")).alias("role")).agg(
        F.count("*").alias("n"))


def age_sql(ts: str, key: str, source: str) -> str:
    s = f"floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us({ts})) / 1000000.0)"
    steps, amount = [], "s"
    for name, size in text.AGE_UNITS:
        steps.append((f"{amount} < {size}", f"floor({amount})", name))
        amount = f"({amount} / {size}::DOUBLE)"
    value = " ".join(f"WHEN {c} THEN {v}" for c, v, _ in steps)
    unit = " ".join(f"WHEN {c} THEN '{u}'" for c, _, u in steps)
    return f"""SELECT {key}, CAST(CASE WHEN s < 5 THEN 0 {value} ELSE floor({amount}) END AS BIGINT) AS value,
 CASE WHEN s < 5 THEN 'now' {unit} ELSE 'year' END AS unit FROM (SELECT *, {s}::DOUBLE AS s FROM {source})"""


@query("order_age", age_sql("o_orderdate", "o_orderkey", "orders"))
def order_age(spark: SparkSession, folder: str) -> DataFrame:
    age = text.age_bucket(F.col("o_orderdate"), F.lit(NOW).cast("timestamp"))
    return b.table(spark, folder, "orders").select("o_orderkey", age.alias("a")).select("o_orderkey", "a.*")


@query("event_age", age_sql("ts", "event_id", "events"))
def event_age(spark: SparkSession, folder: str) -> DataFrame:
    age = text.age_bucket(F.col("ts"), F.lit(NOW).cast("timestamp"))
    return b.table(spark, folder, "events").select("event_id", age.alias("a")).select("event_id", "a.*")
