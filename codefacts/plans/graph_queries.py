"""Queries over graphs, accesses and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, graph
from ..operators.ordering import neighbour, positions
from . import bindings as b
from .registry import query


@query("dense_ids", """SELECT user_id AS scope, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id
 FROM events""")
def dense_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = b.table(spark, folder, "events").select(F.col("user_id").alias("scope"), "event_id")
    return graph.assign_ids(rows, ["scope"], ["event_id"], first=1)


@query("valid_edges", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN
 (SELECT p_partkey FROM part WHERE p_size > 10) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def valid_edges(spark: SparkSession, folder: str) -> DataFrame:
    nodes = b.table(spark, folder, "part").filter("p_size > 10").select(F.col("p_partkey").alias("node"))
    edges = b.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_orderkey", "l_linenumber")
    return graph.valid_edges(nodes, edges, []).select("l_orderkey", "l_linenumber")


@query("definition_of_use", f"""WITH {b.ACCESSES}, d AS (SELECT *, CASE WHEN op <> 'use' THEN seq END AS def FROM acc),
 k AS (SELECT *, last_value(def IGNORE NULLS) OVER (PARTITION BY scope, var_key ORDER BY seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_key,
  last_value(def IGNORE NULLS) OVER (PARTITION BY scope, variable ORDER BY seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_name FROM d)
 SELECT scope, seq, var_key, variable, op, coalesce(by_key, by_name) AS def_seq FROM k WHERE op = 'use'""")
def definition_of_use(spark: SparkSession, folder: str) -> DataFrame:
    return graph.link_def_use(b.accesses(spark, folder))


@query("sequence_edges", """SELECT scope, src, dst FROM (SELECT user_id AS scope, event_id AS src,
 lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events) WHERE dst IS NOT NULL""")
def sequence_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.successor_edges(b.accesses(spark, folder).select("scope", "seq"))


@query("aligned_positions", """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey, l_suppkey FROM lineitem""")
def aligned_positions(spark: SparkSession, folder: str) -> DataFrame:
    lines = positions(
        b.table(spark, folder, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "pos")
    return graph.zip_positions(
        lines.select("l_orderkey", "pos", "l_partkey"), lines.select("l_orderkey", "pos", "l_suppkey"), ["l_orderkey"])


REACH = f"""RECURSIVE {b.TYPE_GRAPH},
 both_ways AS (SELECT scope, src, dst FROM edges UNION SELECT scope, dst, src FROM edges),
 reach AS (SELECT scope, node, node AS seen FROM nodes UNION
  SELECT r.scope, r.node, e.dst FROM reach r JOIN both_ways e ON e.scope = r.scope AND e.src = r.seen),
 labels AS (SELECT scope, node, min(seen) AS label FROM reach GROUP BY ALL)"""


@query("connected_types", f"WITH {REACH} SELECT * FROM labels")
def connected_types(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = b.type_graph(spark, folder)
    return components.components(nodes, edges, ["scope"])


def returned(condition: str) -> str:
    """Labels of parts and suppliers over line items: each round passes on the smaller label, one row per node is kept."""
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem WHERE {condition}),
 g AS (SELECT p AS src, s AS dst FROM e UNION SELECT s, p FROM e),
 nodes AS (SELECT 'p' || p_partkey AS node FROM part UNION SELECT src FROM g),
 cc(node, label) USING KEY (node) AS (SELECT node, node FROM nodes
  UNION SELECT g.dst, min(cc.label) FROM cc JOIN g ON g.src = cc.node JOIN recurring.cc r ON r.node = g.dst WHERE cc.label < r.label GROUP BY g.dst)
 SELECT node, label FROM cc"""


def _returned(spark: SparkSession, folder: str, condition: str) -> DataFrame:
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    items = b.table(spark, folder, "lineitem").filter(condition)
    nodes = b.table(spark, folder, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return components.components(nodes, items.select(part.alias("src"), supplier.alias("dst")), [])


@query("connected_parts", returned("l_returnflag = 'R' AND l_discount >= 0.1"))
def connected_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and suppliers joined by line items that were returned at a high discount."""
    return _returned(spark, folder, "l_returnflag = 'R' AND l_discount >= 0.1")


@query("connected_returns", returned("l_returnflag = 'R'"))
def connected_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and suppliers joined by all returned line items."""
    return _returned(spark, folder, "l_returnflag = 'R'")


@query("connected_orders", """SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS label FROM orders""")
def connected_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders joined to the customer's next one, in the order of a hash: long paths with shuffled ids."""
    orders = b.table(spark, folder, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("node"))
    placed = orders.withColumn("seq", F.xxhash64("node"))
    edges = neighbour(placed, ["scope"], ["seq"], {"dst": F.col("node")}).filter("dst IS NOT NULL")
    return components.components(orders.select("node"), edges.select(F.col("node").alias("src"), "dst"), [])


@query("control_flow_metrics", f"""WITH {REACH},
 n AS (SELECT scope, count(*) AS nodes_count FROM nodes GROUP BY scope),
 e AS (SELECT scope, count(*) AS edges_count FROM edges GROUP BY scope),
 c AS (SELECT scope, count(*) AS components FROM labels WHERE node = label GROUP BY scope)
 SELECT scope, nodes_count, coalesce(edges_count, 0) AS edges_count, components,
 greatest(1, coalesce(edges_count, 0) - nodes_count + 2 * components) AS cyclomatic_complexity
 FROM n LEFT JOIN e USING (scope) JOIN c USING (scope)""")
def control_flow_metrics(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = b.type_graph(spark, folder)
    return graph.cfg_metrics(nodes, edges, ["scope"])


@query("data_flow_metrics", f"""WITH {b.ACCESSES} SELECT scope, count(*) FILTER (WHERE op <> 'use') AS defs_count,
 count(*) FILTER (WHERE op = 'use') AS uses_count, count(*) FILTER (WHERE op = 'write') AS writes_count,
 count(DISTINCT variable) AS variables_count FROM acc GROUP BY scope""")
def data_flow_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dfg_metrics(b.accesses(spark, folder), ["scope"])


@query("def_use_index", f"""WITH {b.ACCESSES}, r AS (SELECT scope, var_key, CASE WHEN op = 'use' THEN 'uses' ELSE 'defs' END AS role,
  seq FROM acc), p AS (SELECT *, (row_number() OVER (PARTITION BY scope, var_key, role ORDER BY seq) - 1) // 3 AS page FROM r)
 SELECT scope, var_key, role, page, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS node_ids FROM p GROUP BY ALL""")
def def_use_index(spark: SparkSession, folder: str) -> DataFrame:
    index = graph.def_use_index(b.accesses(spark, folder), page_size=3)
    return index.withColumn("node_ids", F.array_join(F.col("node_ids").cast("array<string>"), ","))


@query("scope_members", """SELECT r_name AS scope, 0::BIGINT AS page, string_agg(n_name, ',' ORDER BY n_nationkey) AS symbol_ids
 FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def scope_members(spark: SparkSession, folder: str) -> DataFrame:
    symbols = b.table(spark, folder, "nation").join(
        b.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("r_name").alias("scope"), F.col("n_nationkey").alias("n"), F.col("n_name").alias("symbol_id"))
    return graph.scope_members(symbols).withColumn("symbol_ids", F.array_join("symbol_ids", ","))


def _elements(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = b.type_graph(spark, folder)
    none = F.lit(None).cast("string")
    shown = nodes.filter("node <> 'signup'").select(
        "scope", "node", F.lit("statement").alias("type"), none.alias("label"),
        F.when(F.col("node") == "click", "use").alias("operation"),
        F.when(F.col("node").isin("click", "view"), F.col("node")).alias("variable"), none.alias("name"))
    return graph.graph_elements(shown, edges.withColumn("label", F.when(F.col("src") == "view", "true")), ["scope"])


@query("graph_nodes", f"""WITH {b.TYPE_GRAPH} SELECT scope, node AS id, CASE WHEN node = 'click' THEN 'use click' ELSE node END AS label,
 'statement' AS node_type FROM nodes WHERE node <> 'signup'""")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _elements(spark, folder)[0]


@query("graph_edges", f"""WITH {b.TYPE_GRAPH}, k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq) - 1 AS i
 FROM edges WHERE src <> 'signup' AND dst <> 'signup')
 SELECT scope, 'e-' || src || '-' || dst || '-' || i AS id, src AS source, dst AS target,
 CASE WHEN src = 'view' THEN 'true' ELSE '' END AS label FROM k""")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _elements(spark, folder)[1]
