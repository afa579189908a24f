"""A stored index for approximate vector search: random-hyperplane buckets, multi-probe and exact scores.

The sign of a vector's products with ``bits`` orthogonal random planes is its bucket. A question visits buckets in the
order of the squared margins its vector would have to cross to lie there. How many it visits is measured when the index
is built: bounded by a parameter, some vectors of the table ask all others exactly, and ``probes`` is the least number
of buckets that holds the wanted share of their neighbours. Every row is indexed; scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval

ROWS_PER_BUCKET, MOST_BITS = 64, 16
SHELF_BITS = 7  # so many buckets of so many rows are about one block of retrieval.BLOCK_ROWS
SAMPLE, RECALL = 256, 0.95
_BATCH = 64


def planes(dimensions: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` orthogonal directions (as columns), the same for the same seed; beyond the dimensions, independent sets."""
    rng, sets = np.random.default_rng(seed), []
    for _ in range(-(-bits // dimensions)):
        sets.append(np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0])
    return np.concatenate(sets, axis=1)[:, :bits]


def probe_order(margins: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of every row of products, nearest first.

    The cost of a bucket is the sum of squares of the products whose sign it changes.
    """
    own = (margins > 0) @ (1 << np.arange(margins.shape[1]))
    cost = np.zeros((len(margins), 1))
    for bit in range(margins.shape[1]):
        cost = np.concatenate([cost, cost + margins[:, bit : bit + 1] ** 2], axis=1)
    if probes < cost.shape[1]:
        near = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
    else:
        near = np.broadcast_to(np.arange(cost.shape[1]), cost.shape)
    ranked = np.take_along_axis(near, np.argsort(np.take_along_axis(cost, near, 1), axis=1, kind="stable"), 1)
    return ranked ^ own[:, None]


def _shelf(group: Column, bucket: Column) -> Column:
    """Neighbouring buckets of one group, about a block of rows together."""
    return F.concat(F.shiftright(bucket, SHELF_BITS).cast("string"), F.lit(":"), F.coalesce(group.cast("string"), F.lit("")))


def _bucketed(vectors: DataFrame, directions: np.ndarray) -> DataFrame:
    """``vectors`` with unit vectors and their buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(directions.shape[1])
        for batch in batches:
            if len(batch):
                unit = retrieval.unit(batch["vector"])
                batch["vector"], batch["bucket"] = list(unit), (unit @ directions > 0) @ powers
            else:
                batch["bucket"] = pd.Series([], dtype="int64")
            yield batch

    columns = [f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema if f.name != "vector"]
    return vectors.mapInPandas(run, ", ".join([*columns, "vector array<double>", "bucket long"]))


def _probed(queries: DataFrame, directions: np.ndarray, probes: int) -> DataFrame:
    """Questions with unit vectors and ``buckets``, those they visit in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), _BATCH):
                part = batch.iloc[start : start + _BATCH].copy()
                unit = retrieval.unit(part["vector"])
                part["vector"], part["buckets"] = list(unit), list(probe_order(unit @ directions, probes))
                yield part

    columns = [f"{f.name} {f.dataType.simpleString()}" for f in queries.schema if f.name != "vector"]
    return queries.mapInPandas(run, ", ".join([*columns, "vector array<double>", "buckets array<long>"]))


def build_index(
    vectors: DataFrame, path: str, group: str = "repo_id", k: int = retrieval.TOP_K, recall: float = RECALL,
    rows_per_bucket: int = ROWS_PER_BUCKET, most_bits: int = MOST_BITS, sample: int = SAMPLE, seed: int = 7,
) -> DataFrame:
    """Index ``vectors(id, group, vector)`` below ``path``; returns the one row that describes the index.

    ``cells`` holds every vector once, at unit length, sorted by shelf and bucket; ``about`` says how to ask. ``sample``
    vectors at most, those with the smallest hashes, ask all rows of their group exactly to find ``probes``.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", F.col(group).alias("group"), "vector").filter("vector IS NOT NULL AND size(vector) > 0")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    n, dimensions = shape["n"], shape["d"] or 1
    bits = int(min(most_bits, max(1, np.ceil(np.log2(max(1, n / rows_per_bucket))))))
    directions = planes(dimensions, bits, seed)
    cells = _bucketed(rows, directions).select("id", "group", _shelf(F.col("group"), F.col("bucket")).alias("shelf"), "bucket", "vector")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells.repartitionByRange(parts, "shelf", "bucket", F.xxhash64("id")).sortWithinPartitions("shelf", "bucket").write.mode("errorifexists").parquet(f"{path}/cells")
    stored = spark.read.parquet(f"{path}/cells")
    # copies of one vector find each other in any bucket, so each vector asks once
    few = stored.groupBy("group", F.xxhash64("vector").alias("h")).agg(F.min("id").alias("id")).orderBy("h", "id").limit(sample).select("id")
    asked = stored.join(few, "id", "left_semi").select(F.col("id").alias("query_id"), "group", "vector")
    near = retrieval.knn(asked, stored.select("id", "group", "vector"), group="group", k=k)
    # in which of the question's buckets each true neighbour lies
    order = _probed(asked, directions, 1 << bits).select("query_id", F.posexplode("buckets").alias("place", "bucket"))
    places = near.join(stored.select("id", "bucket"), "id").join(order, ["query_id", "bucket"]).groupBy("place").count().orderBy("place").collect()
    total, seen, probes = sum(r["count"] for r in places), 0, 1
    for r in places:
        seen, probes = seen + r["count"], r["place"] + 1
        if seen >= recall * total:
            break
    about = spark.createDataFrame(
        [(n, dimensions, bits, seed, probes, seen / total if total else 1.0)],
        "rows long, dimensions int, bits int, seed long, probes int, sample_recall double")
    about.write.mode("errorifexists").parquet(f"{path}/about")
    return spark.read.parquet(f"{path}/about")


def ask_index(
    spark: SparkSession, path: str, queries: DataFrame, group: str = "repo_id", k: int = retrieval.TOP_K, probes: int | None = None,
) -> DataFrame:
    """The best ``k`` (query_id, id, score, rank) of each question ``(query_id, group, vector)`` in the buckets it visits.

    A question goes once to every shelf that has one of its buckets, and k rows leave it there. Shelves and questions meet
    as groups do in :func:`retrieval.knn`, in blocks of bounded size: a shelf with a bucket that holds a third of all vectors
    (copies of one, say) is many tasks. An id lies in one bucket, so nothing is found twice.
    """
    about = spark.read.parquet(f"{path}/about").first()
    directions = planes(about["dimensions"], about["bits"], about["seed"])
    wanted = min(probes or about["probes"], 1 << about["bits"])
    fine = queries.select("query_id", F.col(group).alias("group"), "vector").filter(F.size("vector") == about["dimensions"])
    shelves = F.array_distinct(F.transform("buckets", lambda b: F.shiftright(b, SHELF_BITS)))
    visits = _probed(fine, directions, wanted).select("query_id", "group", "vector", "buckets", F.explode(shelves).alias("_s"))
    asked = visits.select(
        "query_id", _shelf(F.col("group"), F.shiftleft(F.col("_s"), SHELF_BITS)).alias("shelf"), "vector",
        F.filter("buckets", lambda b: F.shiftright(b, SHELF_BITS) == F.col("_s")).alias("buckets"))
    stored = spark.read.parquet(f"{path}/cells").select("id", "shelf", "bucket", "vector")
    sizes = retrieval._sizes(stored.groupBy("shelf").agg(F.count("*").alias("_nv")), asked, "shelf", retrieval.BLOCK_ROWS, retrieval.QUERY_ROWS)
    left = retrieval._spread(asked, sizes, "shelf", "query_id", "_q", "_v", ["vector", "buckets"])
    right = retrieval._spread(stored, sizes, "shelf", "id", "_v", "_q", ["vector", "bucket"])
    return retrieval.top_k(retrieval._in_blocks(left, right, "shelf", lambda q, v: _block_top(q, v, k)), k)


def _block_top(questions: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of one block of a shelf for each question, among the buckets that it visits."""
    if questions.empty or vectors.empty:
        return retrieval.nothing()
    visited = np.zeros((len(questions), 1 << SHELF_BITS), bool)
    for row, buckets in zip(visited, questions["buckets"]):
        row[np.asarray(buckets) & ((1 << SHELF_BITS) - 1)] = True
    low = vectors["bucket"].to_numpy() & ((1 << SHELF_BITS) - 1)
    used = visited.any(axis=0)[low]  # buckets that nobody visits aren't multiplied
    if not used.any():
        return retrieval.nothing()
    scores = np.stack(questions["vector"]) @ np.stack(vectors["vector"][used]).T
    return retrieval.best(questions["query_id"].to_numpy(), vectors["id"].to_numpy()[used], scores, visited[:, low[used]], k)
