"""Bucketed tables, deletions by partition, and documents without a schema."""

import datetime as dt
import re
from pathlib import Path

from pyspark.sql import functions as F

from codefacts.sources.json_facts import parse_open, read_fields
from codefacts.sources.layout import GraphStore, rewrite, write_bucketed

from .conftest import rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(spark, df):
    """How many rows of the table the scan of a query opened, by the plan's own metric."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    while leaf.children().size():
        leaf = leaf.children().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def graph_tables(spark, files=200):
    make = lambda data, schema: spark.createDataFrame(data, schema)
    scoped = "file_id long, seq long, scope string, content string"
    return {
        "files": make([(i,) for i in range(files)], "file_id long"),
        "ast": make([(i, f"a{i}") for i in range(0, files, 2)], "file_id long, content string"),
        "cfg": make([(i, j, f"s{j}", "c") for i in range(files) for j in range(i % 4)], scoped),
        "dfg": make([(i, j, f"s{j}", "d") for i in range(files) for j in range(i % 3)], scoped)}


def test_point_reads_open_one_bucket_and_lists_need_no_exchange(spark):
    store = GraphStore(graph_tables(spark), buckets=8)
    one = store.of_file("cfg", 7)
    assert rows(one, "scope") == [("s0",), ("s1",), ("s2",)]
    # rows the scan hands on before the filter: those of one bucket
    assert scanned(spark, one) < 0.3 * store.tables["cfg"].count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as large tables have them
    try:
        every = store.with_graphs()
        assert "Exchange" not in plan(every).replace("ReusedExchange", "Exchange")
        got = {r.file_id: (r.ast, [g["scope"] for g in r.cfg], [g["scope"] for g in r.dfg]) for r in every.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: (f"a{i}" if i % 2 == 0 else None, [f"s{j}" for j in range(i % 4)], [f"s{j}" for j in range(i % 3)]) for i in range(200)}


def test_two_keys_prune_by_both(spark):
    df = spark.createDataFrame([(f"r{i % 5}", i, i * 2) for i in range(100)], "repo_id string, file_id long, n long")
    stored = write_bucketed(df, ["repo_id", "file_id"], 8)
    assert rows(stored.filter("repo_id = 'r3' AND file_id = 13"), "n") == [(26,)] and rows(stored) == rows(df)
    assert "Exchange" not in plan(stored.groupBy("repo_id", "file_id").agg(F.sum("n")))


def files_of(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    data = [(i, "abcd"[i % 4], dt.datetime(2024, 1, 1 + i % 20), None if i % 10 == 0 else "x") for i in range(100)] + [(500, None, None, "x")]
    df = spark.createDataFrame(data, "id long, part string, at timestamp, note string")
    df.repartition("part").write.partitionBy("part").parquet(path)
    before = files_of(path)
    assert rewrite(spark, path, ["part"], (F.col("part") == "b") & (F.col("id") > 50)) == 1
    after = files_of(path)
    assert {p for p in before if "part=b" not in str(p)} == {p for p in after if "part=b" not in str(p)}
    assert all(after[p] == t for p, t in before.items() if "part=b" not in str(p))
    keep = [r for r in data if not (r[1] == "b" and r[0] > 50)]
    read = lambda: sorted(r.id for r in spark.read.parquet(path).collect())
    assert read() == sorted(r[0] for r in keep)
    # by a list: a whole partition goes, and the one of nulls
    ids = [r[0] for r in keep if r[1] in ("c", None)] + [9999]
    assert rewrite(spark, path, ["part"], spark.createDataFrame([(i,) for i in ids], "id long"), on=["id"]) == 2
    assert read() == sorted(r[0] for r in keep if r[1] not in ("c", None)) and not list(Path(path).glob("part=c"))
    # a condition that is null deletes nothing; nothing to delete touches nothing
    now = files_of(path)
    assert rewrite(spark, path, ["part"], F.col("note") == "y") == 0 and files_of(path) == now


def test_documents_of_any_shape(spark):
    texts = ['{"k": 1}', '{"k": "one", "more": [1, {"a": null}]}', '{"k": 2', "[1, 2]", "7", '""', None, "", '{"k": {"deep": 3}, "é": true}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = read_fields(parse_open(df), {"k": ("$.k", "int"), "deep": ("$.k.deep", "int")}).orderBy("id").collect()
    assert [(r.k, r.deep, r.rest, r.bad_record) for r in got] == [
        (1, None, {}, None), (None, None, {"more": '[1,{"a":null}]'}, None), (None, None, None, '{"k": 2'), (None, None, None, None),
        (None, None, None, None), (None, None, None, None), (None, None, None, None), (None, None, None, ""), (None, 3, {"é": "true"}, None)]
    assert re.fullmatch("variant", dict(parse_open(df).dtypes)["doc"])
