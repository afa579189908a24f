"""Queries over chunks, keywords and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, keyword_index, retrieval, vector_index
from ..session import new_table_path
from . import bindings as b
from .registry import query

WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
CHUNKS = f"""{b.DOCS}, w AS (SELECT *, {WORDS.format('content')} AS ws FROM docs),
 ch AS (SELECT repo_id, file_id, path, CAST(i // 450 AS INTEGER) AS chunk_index, array_to_string(ws[i + 1:i + 500], ' ') AS text
  FROM w, LATERAL unnest(range(0, greatest(len(ws) - 50, 1), 450)) AS u(i) WHERE len(ws) > 0)"""


@query("chunks", f"WITH {CHUNKS} SELECT * FROM ch")
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.chunk(b.documents(spark, folder))


@query("chunk_rows", f"""WITH {CHUNKS} SELECT sha256(repo_id || ':' || path || ':' || chunk_index) AS id, repo_id, file_id,
 path AS file_path, chunk_index, 'Documentation of the file: ' || path || chr(10) || chr(10) || text AS content FROM ch""")
def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.with_header(retrieval.chunk(b.documents(spark, folder)))


def vectors(spark: SparkSession, folder: str, group: Column) -> DataFrame:
    return b.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), group.alias("repo_id"), F.col("embedding").alias("vector"))


COSINE = "round(list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[]), 6)"
KNN = f"""q AS (SELECT label, vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id AS id, {COSINE.format('q.v', 'e.embedding')} AS score FROM q JOIN embeddings e USING (label)),
 knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5)"""


@query("similar_vectors", f"WITH {KNN} SELECT * FROM knn")
def similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The same questions as ``vector_neighbours``, each within its own label."""
    labelled = vectors(spark, folder, F.col("label"))
    return retrieval.knn(labelled.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), labelled)


HUNDREDTHS = f"""s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE.format('q.embedding', 'e.embedding')} AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)"""


@query("vector_neighbours", f"""WITH {HUNDREDTHS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
 FROM s QUALIFY rank <= 5""")
def vector_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks all vectors, so the questions grow with the table."""
    everything = vectors(spark, folder, F.lit("all"))
    asked = everything.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return retrieval.knn(asked, everything)


@query("approximate_neighbours")
def approximate_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of ``vector_neighbours``, asked of a stored index over all vectors."""
    path = new_table_path(spark, "vector_index")
    everything = vectors(spark, folder, F.lit("all"))
    vector_index.build_index(everything, path)
    return vector_index.ask_index(spark, path, everything.filter("id % 100 = 0").withColumnRenamed("id", "query_id"))


LANGS = ("de", "en", "es", "fr")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as questions; they ask the languages in turn, so every document is searched."""
    lang = F.get(F.array(*map(F.lit, LANGS)), F.pmod(F.col("item_id"), F.lit(len(LANGS))).cast("int"))
    return b.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), lang.alias("repo_id"), F.col("text").alias("query"))


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("repo_id"), "text")


TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def bm25(k: int) -> str:
    return f"""qt AS (SELECT DISTINCT item_id AS query_id, {list(LANGS)}[item_id % {len(LANGS)} + 1] AS lang,
  unnest({TOKENS.format('text')}) AS term FROM benchmark),
 dt AS (SELECT doc_id AS id, lang, {TOKENS.format('text')} AS ts FROM documents),
 corpus AS (SELECT lang, count(*) AS n, avg(len(ts)) AS avg_len FROM dt WHERE len(ts) > 0 GROUP BY lang),
 post AS (SELECT id, lang, len, term, count(*) AS tf FROM (SELECT id, lang, len(ts) AS len, unnest(ts) AS term FROM dt)
  SEMI JOIN qt USING (lang, term) GROUP BY ALL),
 df AS (SELECT lang, term, count(*) AS df FROM post GROUP BY ALL),
 bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE
   / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
  FROM qt JOIN post USING (lang, term) JOIN df USING (lang, term) JOIN corpus USING (lang) GROUP BY ALL),
 kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= {k})"""


@query("keyword_search", f"WITH {bm25(5)} SELECT * FROM kw")
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_index.keyword_search(questions(spark, folder), indexed(spark, folder))


def hybrid_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items ask by their text and, among all vectors, by the vector of the same number."""
    everything = vectors(spark, folder, F.lit("all"))
    items = b.table(spark, folder, "benchmark").select(F.col("item_id").alias("id"))
    asked = everything.join(items, "id", "left_semi").withColumnRenamed("id", "query_id")
    return retrieval.hybrid(
        retrieval.knn(asked, everything, k=20),
        keyword_index.keyword_search(questions(spark, folder), indexed(spark, folder), k=20))


HYBRID = f"""{bm25(20)},
 v AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE.format('q.embedding', 'e.embedding')} AS score
  FROM embeddings q JOIN benchmark ON item_id = q.vec_id CROSS JOIN embeddings e),
 vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v QUALIFY rank <= 20),
 fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score
  FROM (SELECT query_id, id, rank FROM vk UNION ALL SELECT query_id, id, rank FROM kw) GROUP BY ALL),
 hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 5)"""


@query("hybrid_search", f"WITH {HYBRID} SELECT * FROM hy")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid_hits(spark, folder)


@query("rendered_hits", f"""WITH {bm25(5)}, {b.DOCS} SELECT query_id, string_agg('### ' || CASE WHEN l.doc_id IS NULL THEN 'unknown'
 ELSE path END || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS rendered
 FROM kw JOIN docs ON file_id = id LEFT JOIN labels l ON l.doc_id = id GROUP BY query_id""")
def rendered_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = keyword_index.keyword_search(questions(spark, folder), indexed(spark, folder))
    docs = b.documents(spark, folder).select(F.col("file_id").alias("id"), "path", "content")
    known = b.table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("known"))
    full = hits.join(docs, "id").join(known, "id", "left").withColumn("path", F.when(F.col("known"), F.col("path")))
    return retrieval.render_hits(full)


@query("file_view", f"""WITH {b.DOCS} SELECT file_id, '### ' || path || chr(10) || '```' || chr(10) || CASE WHEN length(content) > 10000
 THEN substr(content, 1, 10000) || chr(10) || chr(10) || '[...truncated, ' || length(content) || ' chars total]' ELSE content END
 || chr(10) || '```' AS view FROM docs""")
def file_view(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts.view_file(b.documents(spark, folder), F.col("path"), F.col("content")).select("file_id", "view")


@query("graph_view", f"""WITH {b.DOCS} SELECT file_id, CASE WHEN quality IS NULL THEN 'No CFG graphs found for ' || path || '.'
 ELSE '### ' || path || ' (CFG)' || chr(10) || '```json' || chr(10) || '{{"quality":' || quality || '}}' || chr(10) || '```' END AS view
 FROM docs LEFT JOIN labels ON doc_id = file_id""")
def graph_view(spark: SparkSession, folder: str) -> DataFrame:
    labels = b.table(spark, folder, "labels").select(F.col("doc_id").alias("file_id"), "quality")
    graphs = b.documents(spark, folder).join(labels, "file_id", "left")
    json = F.when(F.col("quality").isNotNull(), F.to_json(F.struct("quality")))
    return artifacts.view_graph(graphs, "cfg", json).select("file_id", "view")


PROMPTS = f"""WITH {b.DOCS} SELECT file_id, '# File to analyze: ' || path || chr(10) || chr(10)
 || '## Source code' || chr(10) || chr(10) || '```' || lang || chr(10) || substr(content, 1, 10000) || chr(10) || '```' || chr(10) || chr(10)
 || '## Abstract Syntax Tree (AST)' || chr(10) || chr(10) || '```json' || chr(10)
 || CASE WHEN quality IS NULL THEN 'N/A' ELSE '{{"quality":' || quality || '}}' END || chr(10) || '```' || chr(10) || chr(10)
 || '## Control Flow Graphs (CFG)' || chr(10) || chr(10) || '```json' || chr(10)
 || CASE WHEN length(content) > 10000 THEN substr(content, 1, 10000) || chr(10) || '... [TRUNCATED — ' || (length(content) - 10000)
  || ' chars omitted]' ELSE content END || chr(10) || '```' || chr(10) || chr(10)
 || '## Data Flow Graphs (DFG)' || chr(10) || chr(10) || '```json' || chr(10) || 'N/A' || chr(10) || '```' || chr(10) || chr(10)
 || '## Instructions' || chr(10) || chr(10) || CASE lang WHEN 'en' THEN 'Describe the file.' ELSE '' END AS prompt
 FROM docs LEFT JOIN labels ON doc_id = file_id"""


@query("prompt_sets", PROMPTS)
def prompt_sets(spark: SparkSession, folder: str) -> DataFrame:
    labels = b.table(spark, folder, "labels").select(F.col("doc_id").alias("file_id"), "quality")
    rows = b.documents(spark, folder).join(labels, "file_id", "left")
    ast = F.when(F.col("quality").isNotNull(), F.to_json(F.struct("quality")))
    prompts = artifacts.prompt_set(
        rows, F.col("content"), ast, F.col("content"), F.lit(None).cast("string"), F.col("lang"),
        {"en": "Describe the file."})
    return prompts.select("file_id", "prompt")
