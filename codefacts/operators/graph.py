"""Node, edge and access tables of many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import node_label
from .components import components
from .ordering import neighbour, paged_lists, positions


def assign_ids(
    df: DataFrame, keys: list[str], order: list[str], out: str = "id", first: int = 0,
    bounded: bool = False,
) -> DataFrame:
    """Dense ids within each group, from 0 or from 1."""
    numbered = positions(df, keys, order, out, bounded)
    return numbered.withColumn(out, F.col(out) + first) if first else numbered


def valid_edges(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges whose two ends are nodes of their graph."""
    starts = nodes.select(*keys, F.col("node").alias("src"))
    ends = nodes.select(*keys, F.col("node").alias("dst"))
    return edges.join(starts, [*keys, "src"], "left_semi").join(ends, [*keys, "dst"], "left_semi")


def link_def_use(accesses: DataFrame, bounded: bool = False) -> DataFrame:
    """Attach to each use the latest earlier definition: by key, else by bare variable name.

    ``accesses(scope, seq, var_key, variable, op)``; op ``use`` or ``read`` uses, ``def``, ``write`` and ``init``
    define. The result holds the uses with ``def_seq`` (null when nothing was defined before).
    """
    defines = F.when(F.col("op").isin("def", "write", "init"), F.col("seq"))
    keyed = neighbour(accesses, ["scope", "var_key"], ["seq"], {"_by_key": defines}, bounded)
    named = neighbour(keyed, ["scope", "variable"], ["seq"], {"_by_name": defines}, bounded)
    return (
        named.filter(F.col("op").isin("use", "read"))
        .withColumn("def_seq", F.coalesce("_by_key", "_by_name")).drop("_by_key", "_by_name")
    )


def successor_edges(rows: DataFrame, bounded: bool = False) -> DataFrame:
    """Sequence edges of each scope ``(scope, seq)``: row to the next row."""
    return (
        neighbour(rows, ["scope"], ["seq"], {"dst": F.col("seq")}, bounded, following=True)
        .filter("dst IS NOT NULL").select("scope", F.col("seq").alias("src"), "dst")
    )


def cfg_metrics(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes, edges and cyclomatic complexity (at least 1) of each control-flow graph."""
    labels = components(nodes, edges, keys)
    parts = labels.filter("node = label").groupBy(*keys).agg(F.count("*").alias("components"))
    return graph_counts(nodes, edges, parts, keys)


def graph_counts(nodes: DataFrame, edges: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Complexity from node, edge and component counts."""
    n = nodes.groupBy(*keys).agg(F.count("*").alias("nodes_count"))
    e = edges.groupBy(*keys).agg(F.count("*").alias("edges_count"))
    both = n.join(e, keys, "left").join(parts, keys, "left").fillna(0, ["edges_count"]).fillna(1, ["components"])
    complexity = F.greatest(F.lit(1), F.col("edges_count") - F.col("nodes_count") + 2 * F.col("components"))
    return both.withColumn("cyclomatic_complexity", complexity)


def dfg_metrics(accesses: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions (writes included), uses, writes and distinct variables of each data-flow graph."""
    op = F.col("op")
    # distinct names are counted over pre-aggregated rows, so a hot graph shrinks before the second shuffle
    per_name = accesses.groupBy(*keys, "variable").agg(
        F.count_if(op.isin("def", "write", "init")).alias("d"),
        F.count_if(op.isin("use", "read")).alias("u"),
        F.count_if(op == "write").alias("w"),
    )
    return per_name.groupBy(*keys).agg(
        F.sum("d").alias("defs_count"), F.sum("u").alias("uses_count"),
        F.sum("w").alias("writes_count"), F.count("*").alias("variables_count"),
    )


def def_use_index(
    accesses: DataFrame, page_size: int = 1000, bounded: bool = False
) -> DataFrame:
    """Node ids that define and that use each variable of a scope, in order, in pages."""
    roles = accesses.withColumn(
        "role", F.when(F.col("op").isin("def", "write", "init"), "defs").otherwise("uses")
    )
    return paged_lists(roles, ["scope", "var_key", "role"], ["seq"], F.col("seq"), "node_ids", page_size, bounded)


def scope_members(symbols: DataFrame, bounded: bool = False, page_size: int = 1000) -> DataFrame:
    """Symbol ids of each scope in order, in pages: ``(scope, n, symbol_id)``."""
    return paged_lists(symbols, ["scope"], ["n"], F.col("symbol_id"), "symbol_ids", page_size, bounded)


def zip_positions(left: DataFrame, right: DataFrame, owner: list[str], pos: str = "pos") -> DataFrame:
    """Pair rows of the same owner by position, so equal names cannot be mixed up."""
    return left.join(right, [*owner, pos])


def align_facts(ast: DataFrame, cfg: DataFrame, dfg: DataFrame, on: list[str]) -> DataFrame:
    """Statements with their control-flow node and number of data accesses, on the shared statement key."""
    accesses = dfg.groupBy(*on).agg(F.count("*").alias("accesses"))
    return ast.join(cfg, on, "left").join(accesses, on, "left").fillna(0, ["accesses"])


def one_edge_per_pair(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First edge of each (src, dst) by the given order: partial minima instead of a ranked window."""
    rest = [c for c in edges.columns if c not in (*keys, "src", "dst")]
    return edges.groupBy(*keys, "src", "dst").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_e")
    ).select(*keys, "src", "dst", "_e.*")


def graph_elements(
    nodes: DataFrame, edges: DataFrame, keys: list[str], bounded: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Node and edge lists for display.

    ``nodes(keys…, node, type, label, operation, variable, name)``, ``edges(keys…, seq, src, dst, label)``. Dangling
    edges go, and the rest are numbered in their order for stable ids.
    """
    shown = nodes.select(
        *keys, F.col("node").cast("string").alias("id"),
        node_label(F.col("label"), F.col("operation"), F.col("variable"), F.col("name"), F.col("node")).alias("label"),
        F.coalesce("type", F.lit("")).alias("node_type"),
    )
    kept = positions(valid_edges(nodes, edges, keys), keys, ["seq"], "_i", bounded)
    source, target = F.col("src").cast("string"), F.col("dst").cast("string")
    links = kept.select(
        *keys, F.concat_ws("-", F.lit("e"), source, target, F.col("_i").cast("string")).alias("id"),
        source.alias("source"), target.alias("target"), F.coalesce("label", F.lit("")).alias("label"),
    )
    return shown, links
