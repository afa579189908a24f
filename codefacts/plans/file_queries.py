"""Queries over file catalogs and paths."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.languages import EXTENSION_NAMES
from ..operators import browse, catalog, stats, tree
from . import bindings as b
from .registry import query

BASE = "regexp_extract(path, '[^/]*$', 0)"
EXT = rf"lower(regexp_extract({BASE}, '^\.*[^.].*?(\.[^.]*)$', 1))"
EXTENSION = f"CASE WHEN {EXT} = '' THEN '(none)' ELSE {EXT} END"
NAMES = "names(ext, language) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in EXTENSION_NAMES.items()) + ")"
BY_EXT = f"by_ext AS (SELECT repo_id, {EXTENSION} AS extension, count(*) AS files FROM files GROUP BY ALL)"


@query("files_by_extension", f"WITH {b.FILES}, {BY_EXT} SELECT * FROM by_ext")
def files_by_extension(spark: SparkSession, folder: str) -> DataFrame:
    return stats.files_by_extension(b.files(spark, folder))


@query("language_breakdown", f"""WITH {b.FILES}, {NAMES}, {BY_EXT},
 c AS (SELECT repo_id, coalesce(language, 'Other') AS language, CAST(sum(files) AS BIGINT) AS files
  FROM by_ext LEFT JOIN names ON ext = regexp_replace(extension, '^\\.+', '') GROUP BY ALL),
 p AS (SELECT *, CAST(floor(100.0 * files / sum(files) OVER (PARTITION BY repo_id) + 0.5) AS BIGINT) AS percentage FROM c)
 SELECT * FROM p WHERE percentage > 0""")
def language_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return stats.language_breakdown(stats.files_by_extension(b.files(spark, folder)))


@query("relative_path", """SELECT page_id, array_to_string(list_slice(string_split(url, '/'), 4, 1000), '/') AS path
 FROM pages""")
def relative_path(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "pages").select("page_id", paths.relative_path(F.col("url"), 3).alias("path"))


REGISTRY = {"java": (".java",), "html": (".html", ".htm")}


@query("language_of_path", f"""WITH {b.FILES} SELECT file_id, CASE WHEN suffix(path, '.java') THEN 'java'
 WHEN suffix(path, '.html') OR suffix(path, '.htm') THEN 'html' END AS language FROM files""")
def language_of_path(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.with_language(b.files(spark, folder), REGISTRY).select("file_id", "language")


@query("analysable_split", f"""WITH {b.DOCS} SELECT file_id, lang IN ('en', 'de') AS analysable FROM docs""")
def analysable_split(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.split_targets(b.documents(spark, folder), F.col("lang"), ["en", "de"]).select("file_id", "analysable")


@query("unsupported_languages", """SELECT DISTINCT lang AS language FROM documents
 WHERE lang NOT IN (SELECT 'en' UNION ALL SELECT 'java')""")
def unsupported_languages(spark: SparkSession, folder: str) -> DataFrame:
    wanted = b.table(spark, folder, "documents").select(F.col("lang").alias("language"))
    known = spark.createDataFrame([("en",), ("java",)], "language string")
    return catalog.unsupported(wanted, known)


@query("extension_of_path", f"WITH {b.FILES} SELECT file_id, {EXTENSION} AS extension FROM files")
def extension_of_path(spark: SparkSession, folder: str) -> DataFrame:
    return b.files(spark, folder).select("file_id", paths.extension(F.col("path")).alias("extension"))


GLOBS = {"**/*.html": "^.*[^/]*[.]html$", "en/*": "^en/[^/]*$", "?r/**": "^[^/]r/.*$", "*/4*.html": "^[^/]*/4[^/]*[.]html$"}


@query("glob_match", f"WITH {b.FILES} " + " UNION ALL ".join(
    f"SELECT file_id, '{p}' AS pattern FROM files WHERE regexp_matches(path, '{r}')" for p, r in GLOBS.items()))
def glob_match(spark: SparkSession, folder: str) -> DataFrame:
    all_files = b.files(spark, folder)
    hits = F.array_compact(F.array(*[
        F.when(F.col("path").rlike(paths.glob_regex(p)), F.lit(p)) for p in GLOBS]))
    return all_files.select("file_id", F.explode(hits).alias("pattern"))


@query("shell_match", f"""WITH {b.FILES} SELECT file_id, {BASE} AS name FROM files
 WHERE regexp_matches({BASE}, '^[1-5].*[^0].$')""")
def shell_match(spark: SparkSession, folder: str) -> DataFrame:
    name = paths.base_name(F.col("path"))
    return b.files(spark, folder).filter(name.rlike(paths.fnmatch_regex("[1-5]*[!0]?"))).select("file_id", name.alias("name"))


@query("directory_listing", f"""WITH {b.FILES},
 c AS (SELECT repo_id, strpos(path, '/') = 0 AS is_file, CASE WHEN strpos(path, '/') > 0
  THEN split_part(path, '/', 1) || '/' ELSE path END AS entry, file_id FROM files)
 SELECT repo_id, is_file, entry, min(CASE WHEN is_file THEN file_id END) AS file_id FROM c GROUP BY ALL""".replace(
    "GROUP BY ALL", "GROUP BY repo_id, is_file, entry"))
def directory_listing(spark: SparkSession, folder: str) -> DataFrame:
    return browse.list_dir(b.files(spark, folder)).orderBy("repo_id", *browse.listing_order())


@query("directory_listing_below", f"""WITH {b.FILES},
 c AS (SELECT repo_id, substr(path, 4) AS name, file_id FROM files
  WHERE starts_with(path, 'en/') AND regexp_matches(substr(path, 4), '^[^/]*[.]html$'))
 SELECT repo_id, true AS is_file, name AS entry, min(file_id) AS file_id FROM c GROUP BY repo_id, name""")
def directory_listing_below(spark: SparkSession, folder: str) -> DataFrame:
    return browse.list_dir(b.files(spark, folder), "en", "*.html")


@query("recursive_glob", f"""WITH {b.FILES},
 d AS (SELECT DISTINCT repo_id, split_part(path, '/', 1) AS dir FROM files WHERE strpos(path, '/') > 0)
 SELECT repo_id, false AS is_file, dir || '/' AS entry, NULL::BIGINT AS file_id FROM d
  WHERE regexp_matches(dir, '^.*[^/]*e[^/]*$')
 UNION ALL SELECT repo_id, true, path, file_id FROM files WHERE regexp_matches(path, '^.*[^/]*e[^/]*$')""")
def recursive_glob(spark: SparkSession, folder: str) -> DataFrame:
    return browse.glob_tree(b.files(spark, folder), "**/*e*")


@query("recursive_glob_dirs", f"""WITH {b.FILES}
 SELECT DISTINCT repo_id, false AS is_file, split_part(path, '/', 1) || '/' AS entry, NULL::BIGINT AS file_id
 FROM files WHERE strpos(path, '/') > 0""")
def recursive_glob_dirs(spark: SparkSession, folder: str) -> DataFrame:
    return browse.glob_tree(b.files(spark, folder), "**/")


TREE = f"""{b.FILES},
 parts AS (SELECT *, string_split(path, '/') AS p FROM files),
 short AS (SELECT repo_id, min(len(p)) AS shortest, count(*) AS n FROM parts GROUP BY repo_id),
 pre AS (SELECT parts.repo_id, i, array_to_string(p[1:i], '/') AS prefix FROM parts JOIN short USING (repo_id),
  LATERAL unnest(range(1, shortest)) AS u(i)),
 common AS (SELECT repo_id, max(i) AS depth FROM (SELECT repo_id, i FROM pre GROUP BY repo_id, i
  HAVING count(DISTINCT prefix) = 1) GROUP BY repo_id),
 rel AS (SELECT parts.repo_id, file_id, path, p[CASE WHEN n > 1 THEN coalesce(depth, 0) ELSE 0 END + 1:] AS r
  FROM parts JOIN short USING (repo_id) LEFT JOIN common USING (repo_id)),
 alldirs AS (SELECT DISTINCT repo_id, array_to_string(r[1:i], '/') AS dir FROM rel, LATERAL unnest(range(1, len(r))) AS u(i)),
 kids AS (SELECT repo_id, regexp_replace(dir, '/?[^/]*$', '') AS parent, 1 AS d, 0 AS f FROM alldirs
  UNION ALL SELECT repo_id, array_to_string(r[1:-2], '/'), 0, 1 FROM rel),
 merged AS (SELECT repo_id, parent AS dir FROM kids GROUP BY repo_id, parent HAVING sum(d) = 1 AND sum(f) = 0 AND parent <> ''),
 kept AS (SELECT * FROM alldirs ANTI JOIN merged USING (repo_id, dir)),
 up AS (SELECT k.repo_id, k.dir, max(a.dir) AS parent FROM kept k JOIN kept a
  ON a.repo_id = k.repo_id AND starts_with(k.dir, a.dir || '/') GROUP BY k.repo_id, k.dir),
 tree AS (SELECT k.repo_id, 'folder' AS kind, k.dir AS full_path, coalesce(up.parent, '') AS parent_path,
   CASE WHEN up.parent IS NULL THEN k.dir ELSE substr(k.dir, length(up.parent) + 2) END AS name, NULL::BIGINT AS file_id
   FROM kept k LEFT JOIN up ON up.repo_id = k.repo_id AND up.dir = k.dir
  UNION ALL SELECT repo_id, 'file', path, array_to_string(r[1:-2], '/'), r[-1], file_id FROM rel)"""


@query("file_tree", f"WITH {TREE} SELECT * FROM tree")
def file_tree(spark: SparkSession, folder: str) -> DataFrame:
    return tree.file_tree(b.files(spark, folder))


@query("tree_search", f"""WITH {TREE}, hit AS (SELECT * FROM tree WHERE kind = 'file' AND contains(lower(name), '4'))
 SELECT * FROM hit UNION ALL SELECT * FROM tree t WHERE kind = 'folder' AND EXISTS (SELECT 1 FROM hit h
  WHERE h.repo_id = t.repo_id AND (h.parent_path = t.full_path OR starts_with(h.parent_path, t.full_path || '/')))""")
def tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return tree.tree_filter(tree.file_tree(b.files(spark, folder)), "4")


@query("catalog_upsert", f"""WITH {b.FILES} SELECT DISTINCT sha256(repo_id || ':' || path) AS file_id, repo_id, path
 FROM files""")
def catalog_upsert(spark: SparkSession, folder: str) -> DataFrame:
    found = catalog.catalog_rows(b.files(spark, folder))
    stored = catalog.catalog_rows(b.files(spark, folder).filter(F.col("path").endswith(".html")))
    return stored.unionByName(catalog.new_rows(found, stored, ["repo_id", "path"]))


@query("catalog_not_analysed", f"""WITH {b.DOCS} SELECT DISTINCT sha256(repo_id || ':' || path) AS file_id, repo_id, path
 FROM docs WHERE lang NOT IN ('en', 'de')""")
def catalog_not_analysed(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.catalog_other(b.documents(spark, folder), F.col("lang"), ["en", "de"])


@query("insert_outcome", """WITH r AS (SELECT o_custkey, CASE WHEN o_totalprice > 200000 THEN
  CASE o_orderstatus WHEN 'F' THEN '16' ELSE '50' END END AS code,
  o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS stored FROM orders),
 k AS (SELECT o_custkey, stored, count(*) FILTER (WHERE stored OR code IS NULL) AS good,
  count(*) FILTER (WHERE NOT stored AND code IS NOT NULL) AS bad FROM r GROUP BY ALL)
 SELECT CAST(sum(good) AS BIGINT) AS succeeded, CAST(sum(bad) AS BIGINT) AS failed,
 count(*) FILTER (WHERE NOT stored AND good > 0) AS inserted,
 CAST(sum(good) AS BIGINT) - count(*) FILTER (WHERE NOT stored AND good > 0) AS duplicates,
 (SELECT string_agg(code, ',' ORDER BY code) FROM (SELECT DISTINCT code FROM r WHERE NOT stored AND code IS NOT NULL))
 AS error_codes FROM k""")
def insert_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Orders inserted by customer into the customers of one segment; large orders are refused."""
    orders = b.table(spark, folder, "orders")
    stored = b.table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    error = F.when(F.col("o_totalprice") > 200000, F.when(F.col("o_orderstatus") == "F", 16).otherwise(50))
    return catalog.insert_outcome(orders, stored, ["o_custkey"], error)


@query("first_write_wins", """SELECT source AS repo_id, lang, min_by(doc_id, doc_id) AS doc_id,
 min_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang""")
def first_write_wins(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.table(spark, folder, "documents").select(F.col("source").alias("repo_id"), "lang", "doc_id", "n_chars")
    stored = docs.groupBy("repo_id", "lang").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))
    stored = stored.filter(F.col("lang") == "en")
    return catalog.first_write_wins(docs, stored, ["repo_id", "lang"], "doc_id")


@query("last_write_wins", """SELECT source AS repo_id, lang, max(doc_id) AS doc_id,
 max_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang""")
def last_write_wins(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.table(spark, folder, "documents").select(F.col("source").alias("repo_id"), "lang", "doc_id", "n_chars")
    return catalog.last_write_wins(docs.filter("lang <> 'fr'"), docs, ["repo_id", "lang"], "doc_id")


@query("listing_page", """SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total, 101::BIGINT AS first
 FROM part ORDER BY p_name, p_partkey LIMIT 100 OFFSET 100""")
def listing_page(spark: SparkSession, folder: str) -> DataFrame:
    parts = b.table(spark, folder, "part").select("p_partkey", "p_name")
    return browse.page(parts, ["p_name", "p_partkey"], 100, 100)


@query("files_per_repo", f"WITH {b.DOCS} SELECT repo_id, count(*) AS entries FROM docs GROUP BY repo_id")
def files_per_repo(spark: SparkSession, folder: str) -> DataFrame:
    return stats.view_counts(b.documents(spark, folder), "repo_id")


RESULTS = f"""{b.DOCS}, res AS (SELECT repo_id, file_id, lang IN ('en', 'de') AS analysed,
 l.doc_id IS NOT NULL AS file_persisted, coalesce(quality, 0) = 1 AS ast_persisted, coalesce(quality, 0) * 2 AS cfg_persisted,
 coalesce(toxic, 0) AS cfg_failed, coalesce(toxic, 0) = 0 AS cfg_built, coalesce(quality, 0) * 3 AS dfg_persisted,
 coalesce(toxic, 0) * 2 AS dfg_failed, l.doc_id IS NOT NULL AS dfg_built, coalesce(toxic, 1) = 0 AS doc_persisted,
 coalesce(quality, 0) = 1 AS rag_persisted FROM docs LEFT JOIN labels l ON l.doc_id = file_id)"""
COUNTS = {
    "file_success": "file_persisted", "file_failed": "NOT file_persisted",
    "ast_success": "analysed AND ast_persisted", "ast_failed": "analysed AND NOT ast_persisted",
    "cfg_build_failed": "analysed AND NOT cfg_built", "dfg_build_failed": "analysed AND NOT dfg_built",
    "doc_success": "analysed AND doc_persisted", "doc_failed": "analysed AND NOT doc_persisted",
    "rag_success": "analysed AND doc_persisted AND rag_persisted",
    "rag_failed": "analysed AND doc_persisted AND NOT rag_persisted",
}
SUMS = {"cfg_success": "cfg_persisted", "cfg_failed": "cfg_failed", "dfg_success": "dfg_persisted", "dfg_failed": "dfg_failed"}
STATS = f"""{RESULTS}, st AS (SELECT repo_id, count(*) AS files_detected, """ + ", ".join(
    [f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in COUNTS.items()]
    + [f"CAST(coalesce(sum({c}) FILTER (WHERE analysed), 0) AS BIGINT) AS {n}" for n, c in SUMS.items()]
) + " FROM res GROUP BY repo_id)"


def file_results(spark: SparkSession, folder: str) -> DataFrame:
    """Per-file outcomes: labels tell what worked for a document."""
    docs = b.documents(spark, folder)
    labels = b.table(spark, folder, "labels").select(F.col("doc_id").alias("file_id"), "quality", "toxic").withColumn(
        "labelled", F.lit(True)
    )
    quality, toxic = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    known = F.coalesce("labelled", F.lit(False))
    return docs.join(labels, "file_id", "left").select(
        "repo_id", "file_id", F.col("lang").isin("en", "de").alias("analysed"),
        known.alias("file_persisted"), (quality == 1).alias("ast_persisted"),
        (quality * 2).alias("cfg_persisted"), toxic.alias("cfg_failed"), (toxic == 0).alias("cfg_built"),
        (quality * 3).alias("dfg_persisted"), (toxic * 2).alias("dfg_failed"), known.alias("dfg_built"),
        (F.coalesce("toxic", F.lit(1)) == 0).alias("doc_persisted"), (quality == 1).alias("rag_persisted"),
    )


def all_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.run_stats(b.documents(spark, folder), file_results(spark, folder))


@query("run_statistics", f"WITH {STATS} SELECT * FROM st")
def run_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return all_stats(spark, folder)


@query("runs_without_files", f"""WITH {b.FILES}, s AS (SELECT repo_id, count(*) AS files_detected,
 count(*) FILTER (WHERE suffix(path, '.html')) AS file_success FROM files GROUP BY repo_id)
 SELECT * FROM s WHERE file_success = 0""")
def runs_without_files(spark: SparkSession, folder: str) -> DataFrame:
    counted = b.files(spark, folder).groupBy("repo_id").agg(
        F.count("*").alias("files_detected"), F.count_if(F.col("path").endswith(".html")).alias("file_success"))
    return stats.failed_runs(counted)


@query("run_summary_markdown", f"""WITH {STATS} SELECT repo_id, '# Résumé de l''analyse' || chr(10) || chr(10)
 || '| Métrique | Succès | Échec |' || chr(10) || '| ------ | ------: | -----: |' || chr(10)
 || '| Fichier  | ' || files_detected || ' | — |' || chr(10)
 || '| AST    | ' || ast_success || ' | ' || ast_failed || ' |' || chr(10)
 || '| CFG    | ' || cfg_success || ' | ' || cfg_failed || ' (' || cfg_build_failed || ') |' || chr(10)
 || '| DFG    | ' || dfg_success || ' | ' || dfg_failed || ' (' || dfg_build_failed || ') |' || chr(10)
 || '| Documentation    | ' || doc_success || ' | ' || doc_failed || ' |' || chr(10) AS content FROM st""")
def run_summary_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return stats.stats_markdown(all_stats(spark, folder))


@query("graph_write_outcome", f"""WITH {RESULTS}, g AS (SELECT file_id, cfg_built, cfg_persisted FROM res)
 SELECT file_id, CASE WHEN cfg_built THEN CAST(cfg_persisted AS BIGINT) ELSE 0 END AS persisted,
 CASE WHEN cfg_built THEN 0::BIGINT ELSE -1::BIGINT END AS failed FROM g""")
def graph_write_outcome(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.files import graph_outcome

    scopes = F.when(F.col("cfg_persisted") > 0, F.sequence(F.lit(1), "cfg_persisted"))
    graphs = file_results(spark, folder).select(
        "file_id", F.col("cfg_built").alias("built"), F.explode_outer(scopes).alias("scope"))
    return graph_outcome(graphs)


@query("json_facts", r"""SELECT event_id, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events""")
def json_facts(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.json_facts import parse_open, read_fields

    parsed = parse_open(b.table(spark, folder, "events").select("event_id", F.col("props").alias("content")))
    return read_fields(parsed, {"k": ("$.k", "bigint")}).select("event_id", "k")


@query("symbols_of_all_kinds", """SELECT 'customer' AS kind, c_name AS name, c_mktsegment AS segment, c_nationkey AS scope
 FROM customer UNION ALL SELECT 'supplier', s_name, NULL, s_nationkey FROM supplier""")
def symbols_of_all_kinds(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.facts import union_kinds

    customers = b.table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("scope"))
    suppliers = b.table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("scope"))
    return union_kinds({"customer": customers, "supplier": suppliers})
