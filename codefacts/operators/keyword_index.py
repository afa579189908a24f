"""A stored inverted index with bounds per block, and exact BM25 top k that skips blocks that can't matter.

A cell is up to ``CELL_ROWS`` chunks of one group that lie next to each other in the input, so the index is built where
the chunks are, without a shuffle. A posting block is one term in one cell: its chunks, counts and lengths as arrays,
with the largest count and the smallest length. A frequent term is many blocks, in as many tasks as there are cells.

A question first asks the cells with the highest bounds. The k-th best score found there is the least that counts, and
only cells whose bound reaches it are opened after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, new_table_path
from . import retrieval

CELL_ROWS = 512
FIRST_CELLS = 2
SLACK = 2 * 10.0**-retrieval.SCORE_DIGITS  # scores are rounded


def _postings(kinds: dict[str, str]):
    """Batches of (group, id, terms) to posting blocks and, with a null term, one row of sizes per cell."""
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    group_kind, id_kind = types[kinds["group"]], types[kinds["id"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, CELL_ROWS):
                part = batch.slice(start, CELL_ROWS)
                coded = part.column("group").dictionary_encode()
                numbers = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
                for number in np.unique(numbers):
                    rows = part.take(pa.array(np.flatnonzero(numbers == number)))
                    cell += 1
                    yield _cell(rows, cell, group_kind, id_kind)

    return run


def _cell(rows: pa.RecordBatch, cell: int, group_kind: pa.DataType, id_kind: pa.DataType) -> pa.RecordBatch:
    lists = rows.column("terms")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(sizes)) + doc, return_counts=True)
    term, doc = pairs // max(1, len(sizes)), pairs % max(1, len(sizes))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(first, len(term)).astype(np.int32)
    n = len(first)
    lengths = sizes[doc]

    def listed(values: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), values.cast(kind)), pa.array([None], pa.list_(kind))])

    def ends_with(values: np.ndarray, last: int) -> pa.Array:
        return pa.array(np.append(values, last).astype(np.int64))

    return pa.RecordBatch.from_arrays([
        pa.array([rows.column("group")[0].as_py()] * (n + 1), group_kind), pa.array(np.full(n + 1, cell)),
        pa.concat_arrays([coded.dictionary.take(pa.array(term[first])).cast(pa.string()), pa.array([None], pa.string())]),
        ends_with(np.diff(ends), int((sizes > 0).sum())), ends_with(np.maximum.reduceat(tf, first) if n else tf, 0),
        ends_with(np.minimum.reduceat(lengths, first) if n else tf, int(sizes.sum())),
        listed(rows.column("id").take(pa.array(doc)), id_kind), listed(pa.array(tf), pa.int64()), listed(pa.array(lengths), pa.int64()),
    ], ["group", "cell", "term", "n", "most", "least", "ids", "tfs", "lens"])


def build_index(chunks: DataFrame, path: str, id_col: str = "id", text: str = "text", group: str = "repo_id") -> None:
    """Index ``chunks`` below ``path``: ``blocks``, ``groups`` (n, avg_len) and ``terms`` (df). Chunks without words have no postings."""
    spark = chunks.sparkSession
    split = chunks.select(F.col(group).alias("group"), F.col(id_col).alias("id"), retrieval.tokens(F.col(text)).alias("terms"))
    split = split.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    kinds = dict(split.dtypes)
    columns = f"group {kinds['group']}, cell long, term string, n long, most long, least long, ids array<{kinds['id']}>, tfs array<long>, lens array<long>"
    split.mapInArrow(_postings(kinds), columns).write.mode("errorifexists").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    # the row of sizes: n chunks with words, and in ``least`` all their words
    blocks.filter("term IS NULL").groupBy("group").agg(F.sum("n").alias("n"), F.sum("least").alias("words")).filter("n > 0").select(
        "group", "n", (F.col("words") / F.col("n")).alias("avg_len")).write.parquet(f"{path}/groups")
    blocks.filter("term IS NOT NULL").groupBy("group", "term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")


def _gain(tf: Column, length: Column) -> Column:
    """What a term adds to a score, but for its rarity; grows with the count and falls with the length."""
    k1, b = retrieval.K1, retrieval.B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avg_len")))


def ask_index(spark: SparkSession, path: str, queries: DataFrame, group: str = "repo_id", k: int = retrieval.TOP_K,
              query_rows: int = retrieval.QUERY_ROWS) -> DataFrame:
    """Exact BM25 top ``k`` (query_id, id, score, rank) of each question ``(query_id, group, query)`` within its group.

    Questions and cells meet by the bounds of the asked terms' blocks, never by their postings. A task scores one cell for
    up to ``query_rows`` questions, and k rows per question leave it.
    """
    blocks = spark.read.parquet(f"{path}/blocks").filter("term IS NOT NULL")
    sizes, terms = spark.read.parquet(f"{path}/groups"), spark.read.parquet(f"{path}/terms")
    asked = queries.select("query_id", F.col(group).alias("group"), F.explode(F.array_distinct(retrieval.tokens(F.col("query")))).alias("term"))
    rare = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = materialize(asked.join(terms, ["group", "term"]).join(sizes, "group").select("query_id", "group", "term", "avg_len", rare.alias("idf")), "asked")
    wanted = asked.select("group", "term").distinct()
    # only blocks of asked terms are read again; at most one row per asked term and cell
    blocks = materialize(blocks.join(wanted, ["group", "term"], "left_semi"), "asked_blocks")
    bounds = blocks.select("group", "cell", "term", "most", "least").join(asked, ["group", "term"]).groupBy("query_id", "group", "cell").agg(
        F.sum(F.col("idf") * _gain(F.col("most"), F.col("least"))).alias("bound"))
    bounds = materialize(bounds, "bounds")
    slices = max(1, -(-queries.count() // query_rows))
    # a question may be asked of several groups, and each counts for itself
    high = Window.partitionBy("query_id", "group").orderBy(F.desc("bound"), "cell")
    first = bounds.withColumn("_n", F.row_number().over(high)).filter(F.col("_n") <= FIRST_CELLS).select("query_id", "group", "cell")
    found = materialize(_scored(blocks, asked, first, slices, k), "first_hits")
    least = found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("_s")).filter(F.size("_s") >= k).select(
        "query_id", F.element_at("_s", k).alias("least"))
    open_ = bounds.join(first, ["query_id", "group", "cell"], "left_anti").join(least, "query_id", "left").filter(
        F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least")))
    rest = _scored(blocks, asked, open_.select("query_id", "group", "cell"), slices, k)
    return retrieval.top_k(found.unionByName(rest), k)


def _scored(blocks: DataFrame, asked: DataFrame, pairs: DataFrame, slices: int, k: int) -> DataFrame:
    """The k best of each question in each of its cells."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice")
    left = pairs.join(asked, ["query_id", "group"]).select("query_id", "cell", part, "term", "idf", "avg_len")
    tasks = left.select("cell", "slice").distinct()
    right = blocks.join(tasks, "cell").select(F.col("cell").alias("cell"), F.col("slice").alias("slice"), F.col("term").alias("term"), "ids", "tfs", "lens")
    on = ["cell", "slice"]
    kinds = f"query_id {dict(left.dtypes)['query_id']}, id {dict(blocks.dtypes)['ids'][6:-1]}, score double"
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(lambda q, c: _score_cell(q, c, k), kinds)


def _score_cell(asked: pd.DataFrame, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    if asked.empty or blocks.empty:
        return pd.DataFrame({"query_id": [], "id": [], "score": []})
    rows, query_ids = pd.factorize(asked["query_id"])
    columns, ids = pd.factorize(np.concatenate(blocks["ids"].to_numpy()))
    ends = np.append(0, np.cumsum([len(i) for i in blocks["ids"]]))
    place = {t: i for i, t in enumerate(blocks["term"])}
    total = np.zeros((len(query_ids), len(ids)))
    k1, b = retrieval.K1, retrieval.B
    idf, average = asked["idf"].to_numpy(), asked["avg_len"].to_numpy()
    for term, at in sorted(pd.Series(rows).groupby(asked["term"].to_numpy()).indices.items()):
        if term in place:
            i = place[term]
            tf, lens = np.asarray(blocks["tfs"].iloc[i], float), np.asarray(blocks["lens"].iloc[i], float)
            gain = idf[at[0]] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / average[at[0]]))
            total[np.ix_(rows[at], columns[ends[i] : ends[i + 1]])] += gain
    return retrieval.best(np.asarray(query_ids), np.asarray(ids), total, total > 0, k)


def keyword_search(queries: DataFrame, chunks: DataFrame, id_col: str = "id", text: str = "text", group: str = "repo_id",
                   k: int = retrieval.TOP_K, query_rows: int = retrieval.QUERY_ROWS) -> DataFrame:
    """Index once, ask once. Keep the index and call :func:`ask_index` to ask again."""
    path = new_table_path(chunks.sparkSession, "keyword_index")
    build_index(chunks, path, id_col, text, group)
    return ask_index(chunks.sparkSession, path, queries, group, k, query_rows)
