import random

from pyspark.sql import functions as F

from codefacts.operators import graph
from codefacts.operators.components import components

from .conftest import rows


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    # a hub with half of all edges, and long chains
    edges = [(g, 0, rng.randint(1, 60)) for g in (1, 2) for _ in range(40)]
    edges += [(3, n, n + 1) for n in range(0, 80)] + [(3, n, n + 1) for n in range(100, 130)]
    edges += [(4, rng.randint(0, 50), rng.randint(0, 50)) for _ in range(30)]
    nodes = sorted({(g, n) for g, a, b in edges for n in (a, b)} | {(g, 999) for g in (1, 4)})
    parent = {n: n for n in nodes}
    for g, a, b in edges:
        x, y = find(parent, (g, a)), find(parent, (g, b))
        parent[max(x, y)] = min(x, y)
    want = sorted([(g, n, find(parent, (g, n))[1]) for g, n in nodes], key=repr)
    got = components(spark.createDataFrame(nodes, "g int, node int"), spark.createDataFrame(edges, "g int, src int, dst int"), ["g"])
    assert rows(got, "g", "node", "label") == want


def test_all_returned_items_connect(spark):
    from codefacts.plans.registry import QUERIES

    folder = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").collect()
    parts = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey").collect()
    parent = {n: n for n in [f"p{r.p_partkey}" for r in parts] + [f"{k}{i}" for r in items for k, i in zip("ps", r)]}
    for r in items:
        x, y = find(parent, f"p{r.l_partkey}"), find(parent, f"s{r.l_suppkey}")
        parent[max(x, y)] = min(x, y)
    got = rows(QUERIES["connected_returns"](spark, folder), "node", "label")
    assert got == sorted([(n, find(parent, n)) for n in parent], key=repr)


def test_shuffled_path_takes_few_rounds(spark, monkeypatch):
    from codefacts.operators import components as module

    ids = list(range(600))
    random.Random(5).shuffle(ids)
    edges = spark.createDataFrame([("g", a, b) for a, b in zip(ids, ids[1:])], "g string, src int, dst int")
    tables = []
    monkeypatch.setattr(module, "new_table_path", lambda s, n, f=module.new_table_path: tables.append(n) or f(s, n))
    got = components(edges.select("g", edges.src.alias("node")).limit(0), edges, ["g"])
    assert rows(got, "label") == [(0,)] * 600
    assert tables.count("stars") <= 14


def test_metrics_count_components(spark):
    nodes = spark.createDataFrame([("s", n) for n in range(5)], "scope string, node int")
    edges = spark.createDataFrame([("s", 0, 1), ("s", 1, 0), ("s", 2, 3)], "scope string, src int, dst int")
    assert rows(graph.cfg_metrics(nodes, edges, ["scope"]), "components", "cyclomatic_complexity") == [(3, 4)]


def test_edges_and_elements(spark):
    nodes = spark.createDataFrame([("s", 1, "statement", "x = 1", None, None, None), ("s", 2, None, None, "use", "x", None), ("s", 3, None, None, None, None, None)],
                                  "scope string, node int, type string, label string, operation string, variable string, name string")
    edges = spark.createDataFrame([("s", 5, 1, 2, "true"), ("s", 6, 2, 9, ""), ("s", 7, 3, 1, None)], "scope string, seq int, src int, dst int, label string")
    shown, links = graph.graph_elements(nodes, edges, ["scope"])
    assert rows(shown, "id", "label", "node_type") == [("1", "x = 1", "statement"), ("2", "use x", ""), ("3", "3", "")]
    assert rows(links, "id", "label") == [("e-1-2-0", "true"), ("e-3-1-1", "")]
    twice = spark.createDataFrame([("s", 1, 2, "b", 2), ("s", 1, 2, "a", 1)], "scope string, src int, dst int, label string, o int")
    assert rows(graph.one_edge_per_pair(twice, ["scope"], ["o"]), "label") == [("a",)]


def test_dense_ids(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "g int, n int")
    assert rows(graph.assign_ids(df, ["g"], ["n"], first=1)) == [(1, 3, 1), (1, 5, 2), (2, 9, 1)]
    assert df.filter(F.col("n") > 100).count() == 0
