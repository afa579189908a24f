"""Queries over links, messages and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, artifacts, messages, runs, stats
from . import bindings as b
from .registry import query


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("repo_name"), F.col("c_nationkey").alias("user_count"))


@query("repos_of_users", f"""WITH {b.LINKS} SELECT repo_id, user_id, name, linked_at, c_name AS repo_name,
 c_nationkey AS user_count FROM links JOIN customer ON c_custkey = repo_id WHERE contains(lower(name), 'urgent')""")
def repos_of_users(spark: SparkSession, folder: str) -> DataFrame:
    found = access.list_repos(b.links(spark, folder), customers(spark, folder), query="URGENT")
    return messages.ordered(found, F.desc("linked_at"), F.asc("user_id"))


@query("repo_detail", """SELECT c_custkey AS repo_id, c_name AS repo_name, c_nationkey AS user_count, last_order
 FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def repo_detail(spark: SparkSession, folder: str) -> DataFrame:
    meta = b.links(spark, folder).groupBy("repo_id").agg(F.max("linked_at").alias("last_order"))
    return access.repo_detail(customers(spark, folder), meta)


@query("owned_rows", f"""WITH {b.LINKS} SELECT repo_id, user_id FROM links WHERE repo_id IN
 (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def owned_rows(spark: SparkSession, folder: str) -> DataFrame:
    owners = b.table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("repo_id"))
    return access.owned(b.links(spark, folder), owners, ["repo_id"]).select("repo_id", "user_id")


@query("join_decisions", f"""WITH {b.LINKS}, req AS (SELECT o_orderkey + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS user_id,
  o_custkey + CASE WHEN o_orderstatus = 'O' THEN 900 ELSE 0 END AS repo_id FROM orders),
 mine AS (SELECT DISTINCT user_id, repo_id FROM links),
 first AS (SELECT repo_id, min_by(name, (linked_at, name)) AS name FROM links GROUP BY repo_id),
 d AS (SELECT req.user_id, req.repo_id, CASE WHEN mine.user_id IS NOT NULL THEN 'conflict'
  WHEN first.name IS NULL OR coalesce(c_nationkey, 0) <= 0 THEN 'not_found' ELSE 'joined' END AS decision,
  first.name, c_nationkey AS user_count FROM req LEFT JOIN mine USING (user_id, repo_id) LEFT JOIN first ON first.repo_id = req.repo_id
  LEFT JOIN customer ON c_custkey = req.repo_id)
 SELECT user_id, repo_id, decision, CASE WHEN decision = 'joined' THEN name END AS name,
 CASE WHEN decision = 'joined' THEN user_count + 1 ELSE user_count END AS user_count FROM d""")
def join_decisions(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    requests = b.table(spark, folder, "orders").select(
        (F.col("o_orderkey") + F.when(status == "P", 0).otherwise(1)).alias("user_id"),
        (F.col("o_custkey") + F.when(status == "O", 900).otherwise(0)).alias("repo_id"))
    return access.plan_joins(requests, b.links(spark, folder), customers(spark, folder))


@query("users_per_repo", f"WITH {b.LINKS} SELECT repo_id, count(*) AS user_count FROM links GROUP BY repo_id")
def users_per_repo(spark: SparkSession, folder: str) -> DataFrame:
    return stats.user_counts(b.links(spark, folder))


def unlinked(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    links = b.links(spark, folder)
    requests = b.table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("user_id"), F.col("o_custkey").alias("repo_id"))
    threads = b.table(spark, folder, "lineitem").join(
        links.select(F.col("user_id").alias("l_orderkey"), "repo_id"), "l_orderkey"
    ).select(F.col("l_orderkey").alias("user_id"), "repo_id", "l_linenumber")
    repos = stats.user_counts(links)
    return access.unlink(requests, links, {"threads": threads}, repos)


@query("unlink_repos", """SELECT o_custkey AS repo_id, count(*) FILTER (WHERE o_orderstatus <> 'F') AS user_count
 FROM orders GROUP BY o_custkey""")
def unlink_repos(spark: SparkSession, folder: str) -> DataFrame:
    return unlinked(spark, folder)["repos"]


@query("unlink_threads", """SELECT o_orderkey AS user_id, o_custkey AS repo_id, l_linenumber FROM lineitem
 JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'""")
def unlink_threads(spark: SparkSession, folder: str) -> DataFrame:
    return unlinked(spark, folder)["threads"]


@query("orphan_rows", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN
 (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    kept = b.table(spark, folder, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = b.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return access.orphans(lines, kept, ["l_orderkey"])


@query("unused_repos", "SELECT c_custkey AS repo_id FROM customer WHERE c_nationkey <= 0")
def unused_repos(spark: SparkSession, folder: str) -> DataFrame:
    return access.unused_repos(customers(spark, folder)).select("repo_id")


@query("partial_updates", """SELECT c_custkey AS id,
 CASE WHEN s_suppkey IS NULL OR s_nationkey % 3 = 0 THEN c_mktsegment ELSE CASE WHEN s_acctbal > 0 THEN s_name END END AS color,
 CASE WHEN s_suppkey IS NOT NULL AND s_nationkey % 3 <> 1 AND s_acctbal > 1000 THEN s_name ELSE c_name END AS name
 FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def partial_updates(spark: SparkSession, folder: str) -> DataFrame:
    rows = b.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("color"), F.col("c_name").alias("name"))
    third = F.col("s_nationkey") % 3
    supplied = F.array_compact(F.array(F.when(third != 0, F.lit("color")), F.when(third != 1, F.lit("name"))))
    patches = b.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), supplied.alias("supplied"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("color"),
        F.when(F.col("s_acctbal") > 1000, F.col("s_name")).alias("name"))
    return access.patch(rows, patches, "id", ["color"], ["name"])


CUT = """CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || chr(10) || chr(10) || '[...truncated, '
 || length(content) || ' chars total]' ELSE content END AS content"""


@query("first_user_messages", f"""WITH {b.MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY turn)
 AS position, count(*) OVER (PARTITION BY thread) AS total FROM msgs WHERE role = 'user')
 SELECT thread, position, total, role, {CUT} FROM r WHERE position <= 2""")
def first_user_messages(spark: SparkSession, folder: str) -> DataFrame:
    return messages.slice_messages(b.messages(spark, folder), role="user", limit=2)


@query("last_messages_about", f"""WITH {b.MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY turn)
 AS position, count(*) OVER (PARTITION BY thread) AS total FROM msgs WHERE contains(lower(content), 'the'))
 SELECT thread, position, total, role, content FROM r
 WHERE position > greatest(total - 3, 0) AND position <= greatest(total - 3, 0) + 2""")
def last_messages_about(spark: SparkSession, folder: str) -> DataFrame:
    return messages.slice_messages(b.messages(spark, folder), query="The", start=-3, limit=2, full_content=True)


@query("first_source_per_path", """SELECT source, lang, min(doc_id) AS doc_id, min_by(n_chars, doc_id) AS n_chars
 FROM documents GROUP BY source, lang""")
def first_source_per_path(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.table(spark, folder, "documents").select("source", "lang", "doc_id", "n_chars")
    return messages.dedupe_first(docs, ["source", "lang"], ["doc_id"])


@query("reasoning_and_answer", """WITH s AS (SELECT conv_id AS message, turn AS seq, CASE WHEN role = 'user' THEN 'tool'
 ELSE 'text' END AS type, text AS content FROM conversations),
 l AS (SELECT message, coalesce(max(CASE WHEN type = 'tool' THEN seq END), -1) AS last FROM s GROUP BY message)
 SELECT message, 0::BIGINT AS page, count(*) FILTER (WHERE seq <= last) AS reasoning_segments,
 coalesce(string_agg(content, '' ORDER BY seq) FILTER (WHERE seq > last AND type = 'text'), '') AS content
 FROM s JOIN l USING (message) GROUP BY message""")
def reasoning_and_answer(spark: SparkSession, folder: str) -> DataFrame:
    segments = b.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("message"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "tool").otherwise("text").alias("type"), F.col("text").alias("content"))
    return messages.split_reasoning(segments)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("thread"), "turn", F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("checkpoint_id"))


@query("turn_lineage", """SELECT conv_id AS thread, turn, 'c-' || conv_id || '-' || turn AS checkpoint_id,
 lag('c-' || conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_checkpoint_id FROM conversations""")
def turn_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return messages.turn_lineage(turns(spark, folder))


@query("branch_points", """SELECT o_custkey AS thread, o_orderstatus AS parent_checkpoint_id,
 count(DISTINCT o_orderkey) AS branches FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderkey) > 1""")
def branch_points(spark: SparkSession, folder: str) -> DataFrame:
    return messages.branch_points(b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("thread"), F.col("o_orderstatus").alias("parent_checkpoint_id"),
        F.col("o_orderkey").alias("checkpoint_id")))


@query("assembled_messages", """SELECT doc_id, regexp_replace(text, '[ \\n]+', ' ', 'g') AS content,
 CAST(len(regexp_split_to_array(text, '[ \\n]+')) AS BIGINT) AS pieces FROM documents""")
def assembled_messages(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("text", "[ \n]+")
    token = F.when(F.col("n") == 0, F.col("w")).otherwise(F.concat(F.lit(" "), "w"))
    stream = b.table(spark, folder, "documents").select("doc_id", F.posexplode(words).alias("n", "w")).withColumn("token", token)
    return messages.assemble_messages(stream, ["doc_id"], "n", "token")


@query("tool_calls", """SELECT user_id AS thread, CAST(day(ts) AS INTEGER) AS turn, event_type AS call_id, min(event_id) AS started_seq,
 arg_min('t' || floor(value), event_id) AS tool, arg_max(props, event_id) FILTER (WHERE value > 5) AS status FROM events GROUP BY 1, 2, 3""".replace(
    "'t' || floor(value)", "'t' || CAST(floor(value) AS BIGINT)"))
def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    return messages.tool_calls(b.table(spark, folder, "events").select(
        F.col("user_id").alias("thread"), F.day("ts").alias("turn"), F.col("event_type").alias("call_id"),
        F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.floor("value").cast("string")).alias("tool"),
        F.when(F.col("value") > 5, F.col("props")).alias("status")))


@query("latest_run", """SELECT o_custkey AS repo_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS run_id,
 max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS started_at FROM orders GROUP BY o_custkey""")
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    return runs.latest_runs(b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("run_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at")))


STALE_NOW = "2024-01-30 22:00:00"


@query("stale_runs", f"""WITH h AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id),
 r AS (SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN 'running' ELSE 'completed' END AS status FROM customer),
 j AS (SELECT c_custkey, status, last, status = 'running' AND coalesce(last < TIMESTAMP '{STALE_NOW}' - INTERVAL 450 SECOND, false) AS stale
  FROM r LEFT JOIN h ON user_id = c_custkey)
 SELECT c_custkey AS run_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN last END AS finished_at,
 CASE WHEN stale THEN '{runs.STALE_ERROR}' END AS error, CASE WHEN NOT stale THEN last END AS last_heartbeat_at FROM j""")
def stale_runs(spark: SparkSession, folder: str) -> DataFrame:
    beats = b.table(spark, folder, "events").select(F.col("user_id").alias("run_id"), "ts")
    status = F.when(F.col("c_nationkey") < 20, "running").otherwise("completed")
    state = b.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("run_id"), status.alias("status"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("error"))
    return runs.detect_stale(beats, state, F.lit(STALE_NOW).cast("timestamp"))


FOLD = f"""{b.RUN_EVENTS}, f AS (SELECT run_id, min(ts) AS started_at,
 arg_min(status, (ts, event_id)) FILTER (WHERE status IN ('completed', 'failed')) AS ended,
 min(ts) FILTER (WHERE status IN ('completed', 'failed')) AS finished_at,
 arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS latest,
 arg_max(message, (ts, event_id)) FILTER (WHERE message IS NOT NULL) AS msg FROM ev GROUP BY run_id),
 s AS (SELECT *, coalesce(ended, latest, 'pending') AS status FROM f)"""
FOLD_SQL = f"""WITH {FOLD} SELECT run_id, status, started_at, finished_at,
 CASE WHEN status <> 'completed' THEN msg END AS message FROM s"""


@query("run_state", FOLD_SQL)
def run_state(spark: SparkSession, folder: str) -> DataFrame:
    return runs.fold_runs(b.run_events(b.table(spark, folder, "events")))


THROTTLE_SQL = """SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n, max(ts) AS flushed_at
 FROM events GROUP BY 1, 2"""


@query("throttled_progress", THROTTLE_SQL)
def throttled_progress(spark: SparkSession, folder: str) -> DataFrame:
    return runs.throttle(b.table(spark, folder, "events"), "user_id", "1 hour")


@query("analysis_progress", """SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS progress_current,
 300::BIGINT AS progress_total FROM events GROUP BY user_id""")
def analysis_progress(spark: SparkSession, folder: str) -> DataFrame:
    return stats.progress(b.table(spark, folder, "events"), "user_id", F.col("event_type") == "view", 300)


@query("retained_runs", """SELECT o_orderkey AS run_id FROM orders WHERE NOT (o_orderstatus = 'F'
 AND o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 30 DAY)""")
def retained_runs(spark: SparkSession, folder: str) -> DataFrame:
    state = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    return runs.purge(state, F.lit("2001-08-01").cast("timestamp")).select("run_id")


@query("resolved_references", f"""WITH {b.DOCS} SELECT repo_id, path, quality, file_id FROM docs JOIN labels ON doc_id = file_id
 AND lang = 'en'""")
def resolved_references(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.documents(spark, folder)
    hits = b.table(spark, folder, "labels").join(docs, F.col("doc_id") == F.col("file_id")).select(
        "repo_id", F.concat_ws("/", "repo_id", F.lit("en"), F.col("doc_id").cast("string")).alias("path"), "quality")
    return artifacts.resolve_refs(hits, docs)


REQUESTS = f"""{b.DOCS}, req AS (SELECT o_orderkey, 'src' || (o_orderkey % 20) AS repo_id FROM orders),
 found AS (SELECT o_orderkey, f.file_id, l.quality FROM req LEFT JOIN docs f ON f.file_id = o_orderkey
  LEFT JOIN labels l ON l.doc_id = f.file_id),
 st AS (SELECT o_orderkey AS path, CASE WHEN file_id IS NULL THEN 'no_file' WHEN quality IS NULL THEN 'no_doc' ELSE 'ok' END
  AS status, CASE WHEN quality IS NOT NULL THEN 'quality ' || quality END AS content FROM found)"""


def requested_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documentation asked for by order number: some have no such file, some no documentation."""
    one = F.lit("all").alias("repo_id")
    requests = b.table(spark, folder, "orders").select(one, F.col("o_orderkey").alias("path"))
    found = b.table(spark, folder, "documents").select(one, F.col("doc_id").alias("path"), F.col("doc_id").alias("file_id"))
    docs = b.table(spark, folder, "labels").select(
        F.col("doc_id").alias("file_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"))
    return artifacts.file_docs(requests, found, docs)


@query("documentation_status", f"WITH {REQUESTS} SELECT * FROM st")
def documentation_status(spark: SparkSession, folder: str) -> DataFrame:
    return requested_docs(spark, folder).select("path", "status", "content")


@query("documentation_view", f"""WITH {REQUESTS} SELECT path, CASE status WHEN 'no_file' THEN 'File not found: ' || path
 WHEN 'no_doc' THEN 'No documentation found for ' || path || '.' ELSE '### ' || path || chr(10) || content END AS view FROM st""")
def documentation_view(spark: SparkSession, folder: str) -> DataFrame:
    asked = requested_docs(spark, folder).withColumn("path", F.col("path").cast("string"))
    return artifacts.view_doc(asked).select(F.col("path").cast("long").alias("path"), "view")


@query("documentation_pending", """SELECT doc_id AS file_id, 'new' AS work, NULL::VARCHAR AS content FROM documents
 WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'index', 'quality ' || quality FROM labels
 JOIN documents USING (doc_id)""")
def documentation_pending(spark: SparkSession, folder: str) -> DataFrame:
    all_files = b.table(spark, folder, "documents").select(F.col("doc_id").alias("file_id"))
    docs = b.table(spark, folder, "labels").select(
        F.col("doc_id").alias("file_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"))
    new, stored = artifacts.pending_docs(all_files, docs)
    return new.select("file_id", F.lit("new").alias("work"), F.lit(None).cast("string").alias("content")).unionByName(
        stored.select("file_id", F.lit("index").alias("work"), "content"))


@query("file_with_graphs", """WITH c AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i,
  o_orderkey FROM orders), d AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i,
  o_orderkey FROM orders WHERE o_orderstatus = 'F'),
 cp AS (SELECT o_custkey, i // 4 AS page, string_agg(o_orderkey::VARCHAR, ',' ORDER BY i) AS cfg FROM c GROUP BY ALL),
 dp AS (SELECT o_custkey, i // 4 AS page, string_agg(o_orderkey::VARCHAR, ',' ORDER BY i) AS dfg FROM d GROUP BY ALL),
 p AS (SELECT c_custkey AS id, 0::BIGINT AS page FROM customer UNION SELECT o_custkey, page FROM cp UNION SELECT o_custkey, page FROM dp)
 SELECT id AS file_id, p.page, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS ast, coalesce(cfg, '') AS cfg, coalesce(dfg, '') AS dfg
 FROM p JOIN customer ON c_custkey = id LEFT JOIN cp ON cp.o_custkey = id AND cp.page = p.page
 LEFT JOIN dp ON dp.o_custkey = id AND dp.page = p.page""")
def file_with_graphs(spark: SparkSession, folder: str) -> DataFrame:
    owners = b.table(spark, folder, "customer")
    graphs = b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").cast("string").alias("scope"), F.col("o_orderpriority").alias("content"), "o_orderstatus")
    ast = owners.filter("c_acctbal > 0").select(F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("content"))
    found = artifacts.file_graphs(
        owners.select(F.col("c_custkey").alias("file_id")), ast, graphs, graphs.filter("o_orderstatus = 'F'"), page_size=4)
    return found.withColumns({
        kind: F.array_join(F.transform(kind, lambda g: g["scope"]), ",") for kind in ("cfg", "dfg")})


@query("end_lines", """SELECT l_orderkey, l_linenumber, l_partkey AS line_start,
 coalesce(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1, 999999) AS line_end FROM lineitem""")
def end_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = b.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("line_start"))
    from ..operators.facts import line_ends

    declared = lines.select(F.col("l_orderkey").alias("file_id"), F.struct("l_linenumber", "line_start").alias("ord"), "line_start")
    ended = line_ends(declared, [], F.lit(999999).cast("long"))
    return ended.select(F.col("file_id").alias("l_orderkey"), F.col("ord.l_linenumber").alias("l_linenumber"), "line_start",
                        F.col("line_end").cast("long").alias("line_end"))
