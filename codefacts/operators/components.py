"""Weakly connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_table, new_table_path


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Label every node with the smallest node of its component, per graph.

    ``nodes(keys…, node)`` and ``edges(keys…, src, dst)``; ends of edges that ``nodes`` lacks are labelled too. Edges
    with a null end are ignored. A large star links each larger neighbour of a node to the smallest node around it, a
    small star does the same with the smaller neighbours; both keep the components and never add edges, and after
    O(log n) rounds every node hangs on the smallest one. Minima are partial sums, so a hub sends one row per task, and
    the joins back read plain shuffles with one row per node on one side, so a hub's rows can be split. Each round is a
    table in the shared folder; the one before is deleted.
    """
    spark = nodes.sparkSession

    def star(rows: DataFrame, others: DataFrame) -> DataFrame:
        """``others`` with the smallest node around their src."""
        least = rows.groupBy(*keys, "src").agg(F.min("dst").alias("low"))
        # a key that Spark doesn't know from the aggregate: the join shuffles anew, and AQE can split its hot keys
        return others.join(least.withColumn("src", F.array_max(F.array("src"))), [*keys, "src"])

    pair = edges.select(*keys, "src", "dst").filter("src <> dst").select(
        *keys, F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    path, seen = None, None
    while True:
        if path is None:
            large = pair.distinct()
        else:
            both = pair.unionByName(pair.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
            large = star(both, both.filter("dst > src")).select(
                *keys, F.col("dst").alias("src"), F.least("src", "low").alias("dst")).distinct()
        small = star(large, large).select(
            *keys, F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"),
            F.col("low").alias("dst"),
        ).distinct()
        new = new_table_path(spark, "stars")
        small.write.parquet(new)
        pair = spark.read.schema(small.schema).parquet(new)
        now = pair.agg(F.count("*"), F.sum(F.xxhash64(*keys, "src", "dst").cast("decimal(38,0)"))).first()
        if path is not None:
            delete_table(spark, path)
        if now == seen or not now[0]:
            break
        path, seen = new, now
    every = nodes.select(*keys, "node").unionByName(
        edges.filter("src <> dst").select(*keys, F.explode(F.array("src", "dst")).alias("node"))
    ).distinct()
    return every.join(
        pair.select(*keys, F.col("src").alias("node"), F.col("dst").alias("label")), [*keys, "node"], "left"
    ).withColumn("label", F.coalesce("label", "node"))
