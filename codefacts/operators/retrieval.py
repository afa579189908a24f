"""Chunks, keyword, vector and hybrid search for many questions at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys

CHUNK_SIZE, CHUNK_OVERLAP, TOP_K = 500, 50, 5  # fixed values
K1, B = 1.2, 0.75  # published BM25 constants
RRF = 60  # published constant of reciprocal rank fusion
BLOCK_ROWS = 8_192  # vectors of one block of the similarity join
QUERY_ROWS = 1_024  # questions of one block of the similarity join
SCORE_DIGITS = 6


def chunk(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` words, each sharing ``overlap`` words with the one before.

    Input ``(repo_id, file_id, path, content)``; the whole text is covered, and no chunk lies inside its predecessor.
    """
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    last = F.greatest(F.size("_w") - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    cut = docs.withColumn("_w", words).filter(F.size("_w") > 0)
    return cut.select(
        "repo_id", "file_id", "path", F.posexplode(F.transform(
            starts, lambda s: F.array_join(F.slice(F.col("_w"), s + 1, F.lit(size)), " "))).alias("chunk_index", "text"),
    )


SEPARATORS = ("\n\n", "\n", " ")  # fixed values: paragraphs, lines, words; then single characters


def chunk_by_separator(docs: DataFrame, size: int = CHUNK_SIZE * 4, overlap: int = CHUNK_OVERLAP * 4) -> DataFrame:
    """Chunks of at most ``size`` characters that end at paragraphs where they can, else at lines, words, characters.

    Input ``(repo_id, file_id, path, content)``. A text is cut at the first separator; only pieces that are still too
    long are cut at the next one, and words that are too long into ``size`` characters. Pieces keep the separator that
    follows them, so the pieces of a text are the text. They fill a chunk until the next one doesn't fit; each chunk
    then starts with the last pieces of the one before that fit into ``overlap`` characters. Chunks are trimmed, and
    chunks of white space are left out. A null text has none. The work of a text stays in its row.
    """
    pieces = F.array("content")
    for separator in SEPARATORS:
        pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_cut(p, separator))))
    starts = lambda p: F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1)), F.lit(size))
    pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(
        F.transform(starts(p), lambda at: F.substring(p, at, F.lit(size))))))
    # one struct per piece: which chunk it opens or joins, folded from left to right; then runs of pieces are texts
    none = F.array().cast("array<int>")
    state = F.struct(none.alias("from"), none.alias("to"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("used"))
    lengths = F.col("_lengths")

    def step(s: Column, n: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + n > size)
        back = _kept(lengths, s["first"], s["at"], F.least(F.lit(overlap), size - n))
        return F.when(full, F.struct(
            F.concat(s["from"], F.array(s["first"])).alias("from"), F.concat(s["to"], F.array(s["at"])).alias("to"),
            back["first"].alias("first"), (s["at"] + 1).alias("at"), (back["used"] + n).alias("used"),
        )).otherwise(F.struct(s["from"], s["to"], s["first"], (s["at"] + 1).alias("at"), (s["used"] + n).alias("used")))

    cut = docs.filter(F.length("content") > 0).withColumn("_p", F.filter(pieces, lambda p: p != ""))
    cut = cut.withColumn("_lengths", F.transform("_p", F.length))
    folded = F.aggregate("_lengths", state, step, lambda s: F.arrays_zip(
        F.concat(s["from"], F.array(s["first"])).alias("from"), F.concat(s["to"], F.array(s["at"])).alias("to")))
    texts = F.transform(folded, lambda r: F.regexp_replace(
        F.array_join(F.slice("_p", r["from"] + 1, r["to"] - r["from"]), ""), r"^\s+|\s+$", ""))
    return cut.select("repo_id", "file_id", "path", F.posexplode(F.filter(texts, lambda t: t != "")).alias("chunk_index", "text"))


def _cut(text: Column, separator: str) -> Column:
    """The parts of a text, each with the separator after it."""
    parts = F.split(text, separator, -1)
    return F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(separator))).otherwise(p))


def _kept(lengths: Column, first: Column, at: Column, room: Column) -> Column:
    """The first of the last pieces before ``at`` that fit into ``room`` characters, and their length."""
    last = F.reverse(F.slice(lengths, first + 1, at - first))
    return F.aggregate(last, F.struct(at.alias("first"), F.lit(0).alias("used"), F.lit(False).alias("done")), lambda s, n: F.when(
        s["done"] | (s["used"] + n > room), F.struct(s["first"], s["used"], F.lit(True).alias("done"))
    ).otherwise(F.struct((s["first"] - 1).alias("first"), (s["used"] + n).alias("used"), F.lit(False).alias("done"))))


def with_header(chunks: DataFrame) -> DataFrame:
    """Chunk rows with deterministic id and the heading that names their file."""
    header = F.concat(F.lit("Documentation of the file: "), F.col("path"), F.lit("\n\n"), F.col("text"))
    return chunks.select(
        keys.chunk_id(F.col("repo_id").cast("string"), F.col("path"), F.col("chunk_index")).alias("id"),
        "repo_id", "file_id", F.col("path").alias("file_path"), "chunk_index", header.alias("content"),
    )


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _sizes(counts: DataFrame, queries: DataFrame, group: str, block_rows: int, query_rows: int) -> DataFrame:
    """Number of blocks of each side per group."""
    asked = queries.groupBy(group).agg(F.count("*").alias("_nq"))
    return counts.join(asked, group).select(
        group,
        F.ceil(F.col("_nv") / block_rows).cast("int").alias("_bv"),
        F.ceil(F.col("_nq") / query_rows).cast("int").alias("_bq"),
    )


def _spread(df: DataFrame, sizes: DataFrame, group: str, key: str, own: str, other: str, columns: list[str]) -> DataFrame:
    """Rows in the block of their key, once for every block of the other side."""
    count = {"_q": "_bq", "_v": "_bv"}
    placed = df.join(sizes, group).withColumn(own, F.pmod(F.xxhash64(key), F.col(count[own])).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.col(count[other]) - 1)))
    # fresh attribute names: questions may come from the searched table itself
    return placed.select(*[F.col(c).alias(c) for c in (group, "_q", "_v", key, *columns)])


def _in_blocks(left: DataFrame, right: DataFrame, group: str, body) -> DataFrame:
    """Run a function on each pair of blocks; it returns the best hits of the block per question."""
    on = [group, "_q", "_v"]
    ids = [f"{c} {side.schema[c].dataType.simpleString()}" for c, side in (("query_id", left), ("id", right))]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(body, ", ".join([*ids, "score double"]))


def best(query_ids: np.ndarray, ids: np.ndarray, raw: np.ndarray, found: np.ndarray | None, k: int) -> pd.DataFrame:
    """The k best of each row of a score matrix, ties by id."""
    scores = np.round(raw, SCORE_DIGITS)
    if found is not None:
        scores = np.where(found, scores, -np.inf)
    picked = []
    for row in scores:
        limit = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        near = np.flatnonzero((row >= limit) & (row > -np.inf))
        picked.append(near[np.lexsort((ids[near], -row[near]))[:k]])
    return pd.DataFrame({
        "query_id": np.repeat(query_ids, [len(p) for p in picked]),
        "id": np.concatenate([ids[p] for p in picked]),
        "score": np.concatenate([row[p] for row, p in zip(scores, picked)]),
    })


def nothing() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "id": [], "score": []})


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per question, ties by id. Spark limits each group before the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= k)


def unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return rows / norms


def _block_top(questions: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Exact best ``k`` of one block of vectors for one block of questions: one matrix product."""
    if questions.empty or vectors.empty:
        return nothing()
    scores = unit(questions["vector"]) @ unit(vectors["vector"]).T
    return best(questions["query_id"].to_numpy(), vectors["id"].to_numpy(), scores, None, k)


def knn(
    queries: DataFrame, vectors: DataFrame, group: str = "repo_id", k: int = TOP_K,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Exact cosine top k per question within its group.

    ``queries(query_id long, group, vector)``, ``vectors(id long, group, vector)``. Both sides are cut into blocks of
    bounded size, by a hash of their ids: a group with a third of all vectors becomes as many blocks as it needs. A
    task holds one block of each side, and only k rows per question leave it. Pairs are never rows of a DataFrame.
    """
    counts = vectors.groupBy(group).agg(F.count("*").alias("_nv"))
    sizes = _sizes(counts, queries, group, block_rows, query_rows)
    left = _spread(queries, sizes, group, "query_id", "_q", "_v", ["vector"])
    right = _spread(vectors, sizes, group, "id", "_v", "_q", ["vector"])
    return top_k(_in_blocks(left, right, group, lambda q, v: _block_top(q, v, k)), k)


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: sum of 1 / (60 + rank) per hit."""
    lists = vector_hits.select("query_id", "id", "rank").unionByName(keyword_hits.select("query_id", "id", "rank"))
    fused = lists.groupBy("query_id", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))), SCORE_DIGITS).alias("score")
    )
    return top_k(fused, k)


def render_hits(hits: DataFrame) -> DataFrame:
    """One text per question ``(query_id, rank, path, content)``: sections in rank order; at most k rows a group."""
    section = F.concat(F.lit("### "), F.coalesce("path", F.lit("unknown")), F.lit("\n"), F.col("content"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("rank"), section.alias("section"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(listed, lambda s: s["section"]), "\n\n---\n\n").alias("rendered")
    )


def embed(chunks: DataFrame, function, text: str = "content", dimensions: int = 1536) -> DataFrame:
    """Attach vectors from a user's function on a list of texts (the model is not part of this library)."""
    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(function(part.tolist())))

    vector = F.pandas_udf(batches, "array<float>")
    return chunks.withColumn("embedding", vector(F.col(text)))

