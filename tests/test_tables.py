import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codefacts.operators import access, artifacts, catalog, messages, runs, stats

from .conftest import rows

T = dt.datetime(2024, 1, 1)


def test_message_slices(spark):
    def cut(data, **options):
        df = spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(data)], "thread int, turn int, role string, content string")
        return [(r.position, r.total, r.content) for r in messages.slice_messages(df, **options).orderBy("position").collect()]

    said = [("human", "What is in the oven?"), ("ai", "Two loaves of rye."), ("human", "o" * 512), ("ai", "Now three.")]
    every = [(i + 1, 4, c if len(c) <= 500 else c[:500] + f"\n\n[...truncated, {len(c)} chars total]") for i, (_, c) in enumerate(said)]
    assert cut(said) == every and cut(said, start=2, limit=2) == every[1:3]
    assert cut(said, start=-2) == every[2:] and cut(said, start=-40, limit=70) == every
    assert cut(said, start=5) == [] and cut(said, start=0) == []
    assert cut(said, start=3, limit=1, full_content=True) == [(3, 4, "o" * 512)]


def test_assembled_pieces_travel_as_lists(spark):
    """A row per run of neighbours, not per piece; pieces out of order, repeated or null come out as one by one."""
    batch = pa.RecordBatch.from_pydict({"m": [1, 1, None, None, 1], "n": [0, 1, 0, 1, 2], "t": list("abcde")})
    packed = list(messages._packed(["m"], "n", "t")(iter([batch, batch.slice(0, 0)])))
    assert [b.to_pydict() for b in packed] == [{"m": [1, None, 1], "_orders": [[0, 1], [0, 1], [2]], "_texts": [["a", "b"], ["c", "d"], ["e"]]}]
    data = [(1, 2, "c"), (2, 0, "x"), (1, 0, "a"), (None, 1, "q"), (1, 1, "b"), (1, 1, "a"), (1, None, "z"), (2, 1, None), (None, 0, "p")]
    df = spark.createDataFrame(data, "m int, n int, t string").repartition(3)
    assert rows(messages.assemble_messages(df, ["m"], "n", "t")) == sorted([(1, "zaabc", 5), (2, "x", 2), (None, "pq", 2)], key=repr)


def test_keep_first(spark):
    df = spark.createDataFrame([("rye", "x", 4), ("oat", "y", 2), ("rye", "z", 1), ("oat", "w", 9), ("bun", "v", 3)], "path string, file_id string, n int")
    assert rows(messages.dedupe_first(df, ["path"], ["n"])) == [("bun", "v", 3), ("oat", "y", 2), ("rye", "z", 1)]


def test_reasoning_pages(spark):
    data = [(1, 0, "text", "a"), (1, 1, "tool", ""), (1, 2, "text", "b"), (1, 3, "text", "c"), (1, 4, "text", "d"), (2, 0, "text", "z"), (3, 0, "tool", "")]
    df = spark.createDataFrame(data, "message int, seq int, type string, content string")
    assert rows(messages.split_reasoning(df)) == [(1, 0, 2, "bcd"), (2, 0, 0, "z"), (3, 0, 1, "")]
    assert rows(messages.split_reasoning(df, page_size=2)) == [(1, 0, 2, "bc"), (1, 1, 2, "d"), (2, 0, 0, "z"), (3, 0, 1, "")]


def test_list_repos(spark):
    links = spark.createDataFrame([("u", "1", "repo-a", T), ("u", "2", "repo-b", T + dt.timedelta(1))], "user_id string, repo_id string, name string, linked_at timestamp")
    repos = spark.createDataFrame([("1", 1), ("2", 1)], "repo_id string, user_count int")
    newest = access.list_repos(links, repos, "u").orderBy(F.desc("linked_at"))
    assert [r["name"] for r in newest.collect()] == ["repo-b", "repo-a"]
    for query, n in (("repo-a", 1), ("REPO-A", 1), ("repo", 2), ("nonexistent", 0), (None, 2)):
        assert access.list_repos(links, repos, "u", query).count() == n
    assert access.scoped(links, "u", "2").count() == 1 and access.scoped(links, "x").count() == 0


def test_join_decisions(spark):
    links = spark.createDataFrame([("u", "1", "test-repo", T), ("v", "3", "gone", T)], "user_id string, repo_id string, name string, linked_at timestamp")
    repos = spark.createDataFrame([("1", 1), ("2", 1), ("3", 0)], "repo_id string, user_count int")
    wanted = spark.createDataFrame([("u", "1"), ("w", "1"), ("w", "2"), ("w", "3")], "user_id string, repo_id string")
    assert rows(access.plan_joins(wanted, links, repos)) == [
        ("u", "1", "conflict", None, 1), ("w", "1", "joined", "test-repo", 2), ("w", "2", "not_found", None, 1), ("w", "3", "not_found", None, 0)]


def test_patch(spark):
    base = spark.createDataFrame([(i, "grey" if i % 2 else None, f"loaf {i}") for i in range(6)], "id int, color string, name string")
    patches = spark.createDataFrame([
        (0, ["color"], "brown", None), (1, ["color", "name"], None, "bun"), (2, ["name"], "unused", "roll"), (3, [], "unused", "unused"),
    ], "id int, supplied array<string>, color string, name string")
    assert rows(access.patch(base, patches, "id", ["color"], ["name"])) == [
        (0, "brown", "loaf 0"), (1, None, "bun"), (2, None, "roll"), (3, "grey", "loaf 3"), (4, None, "loaf 4"), (5, "grey", "loaf 5")]


def test_unlink(spark):
    links = spark.createDataFrame([("u", "1"), ("v", "1")], "user_id string, repo_id string")
    threads = spark.createDataFrame([("u", "1", 7), ("v", "1", 8)], "user_id string, repo_id string, thread int")
    repos = spark.createDataFrame([("1", 2), ("2", 1)], "repo_id string, user_count int")
    out = access.unlink(links.filter("user_id = 'u'"), links, {"threads": threads}, repos)
    assert rows(out["threads"]) == [("v", "1", 8)] and rows(out["links"]) == [("v", "1")] and rows(out["repos"]) == [("1", 1), ("2", 1)]


RESULTS = "repo_id string, file_id string, analysed boolean, file_persisted boolean, ast_persisted boolean, cfg_persisted int, cfg_failed int, cfg_built boolean, dfg_persisted int, dfg_failed int, dfg_built boolean, doc_persisted boolean, rag_persisted boolean"


def test_run_statistics(spark):
    found = spark.createDataFrame([("r", f) for f in "ABCD"], "repo_id string, file_id string")
    results = spark.createDataFrame([
        ("r", "A", True, True, True, 2, 0, True, 2, 0, True, True, True),
        ("r", "B", True, True, False, 0, 0, False, 1, 1, True, True, False),
        ("r", "C", True, False, False, 0, 0, False, 0, 0, False, False, False),
        ("r", "D", False, True, False, 0, 0, False, 0, 0, False, False, False)], RESULTS)
    got = stats.run_stats(found, results).first().asDict()
    want = dict(files_detected=4, file_success=3, file_failed=1, ast_success=1, ast_failed=2, cfg_success=2, cfg_failed=0, cfg_build_failed=2,
                dfg_success=3, dfg_failed=1, dfg_build_failed=1, doc_success=2, doc_failed=1, rag_success=1, rag_failed=1, repo_id="r")
    assert got == want
    text = stats.stats_markdown(stats.run_stats(found, results)).first().content
    assert "| CFG    | 2 | 0 (2) |\n" in text and text.startswith("# Résumé de l'analyse\n\n| Métrique")
    stats.gate(stats.run_stats(found, results))
    nothing = stats.run_stats(found, results.filter("file_id = 'C'"))
    with pytest.raises(RuntimeError):
        stats.gate(nothing)


def test_breakdown_rounds_half_up(spark):
    counts = spark.createDataFrame([("r", ".java", 1), ("r", ".ts", 3), ("r", ".tsx", 4), ("r", ".zzz", 192)], "repo_id string, extension string, files long")
    assert rows(stats.language_breakdown(counts), "language", "percentage") == [("Java", 1), ("Other", 96), ("TypeScript", 4)]


def test_insert_and_upserts(spark):
    new = spark.createDataFrame([("r", "a", 2), ("r", "a", 1), ("r", "b", 1)], "repo_id string, path string, v int")
    old = spark.createDataFrame([("r", "b", 0)], "repo_id string, path string, v int")
    on = ["repo_id", "path"]
    assert rows(catalog.new_rows(new, old, on), *on) == [("r", "a")]
    assert rows(catalog.first_write_wins(new, old, on, "v")) == [("r", "a", 1), ("r", "b", 0)]
    assert rows(catalog.last_write_wins(new, old, on, "v")) == [("r", "a", 2), ("r", "b", 1)]
    outcome = catalog.insert_outcome(new, old, on, F.when(F.col("v") == 2, 16)).first()
    assert tuple(outcome) == (2, 1, 1, 1, "16")
    wanted = spark.createDataFrame([("java",), ("cobol",), ("ada",), ("ada",)], "language string")
    known = spark.createDataFrame([("java",)], "language string")
    assert [r.language for r in catalog.unsupported(wanted, known).collect()] == ["ada", "cobol"]


def test_file_graph_pages(spark):
    found = spark.createDataFrame([(1,), (2,)], "file_id int")
    ast = spark.createDataFrame([(1, "{}")], "file_id int, content string")
    cfg = spark.createDataFrame([(1, n, f"s{n}", "{}") for n in range(5)], "file_id int, seq int, scope string, content string")
    got = artifacts.file_graphs(found, ast, cfg, cfg.filter("seq = 0"), page_size=2).orderBy("file_id", "page").collect()
    assert [(r.file_id, r.page, r.ast, [g.scope for g in r.cfg], [g.scope for g in r.dfg]) for r in got] == [
        (1, 0, "{}", ["s0", "s1"], ["s0"]), (1, 1, "{}", ["s2", "s3"], []), (1, 2, "{}", ["s4"], []), (2, 0, None, [], [])]


def test_views(spark):
    asked = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "repo_id string, path string")
    found = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "repo_id string, path string, file_id int")
    docs = spark.createDataFrame([(1, "text")], "file_id int, content string")
    views = artifacts.view_doc(artifacts.file_docs(asked, found, docs))
    assert rows(views, "path", "view") == [("a", "### a\ntext"), ("b", "No documentation found for b."), ("c", "File not found: c")]
    graphs = spark.createDataFrame([("a", "x" * 10_500), ("b", None)], "path string, json string")
    shown = rows(artifacts.view_graph(graphs, "cfg", F.col("json")), "path", "view")
    assert shown[0][1].endswith("[...truncated, 10500 chars total]\n```") and shown[1][1] == "No CFG graphs found for b."
    full = {r.path: r.view for r in artifacts.view_graph(graphs, "ast", F.col("json"), full=True).collect()}
    assert full["b"] == "No AST graph found for b." and len(full["a"]) > 10_500


def test_prompt_set(spark):
    rows_ = spark.createDataFrame([("a.java", "class A {}", "java")], "path string, content string, lang string")
    prompt = artifacts.prompt_set(rows_, F.col("content"), F.struct("path"), F.lit(None).cast("string"), F.lit("x" * 20), F.col("lang"), {"java": "Look."}, limit=8).first().prompt
    assert prompt.startswith("# File to analyze: a.java\n\n## Source code\n\n```java\nclass A \n```")
    assert "N/A" in prompt and "xxxxxxxx\n... [TRUNCATED — 12 chars omitted]" in prompt and prompt.endswith("Look.")


def test_runs(spark):
    at = lambda s: T + dt.timedelta(seconds=s)
    state = spark.createDataFrame([("a", "running"), ("b", "running"), ("c", "completed"), ("d", "running")], "run_id string, status string").withColumns(
        {"finished_at": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")})
    beats = spark.createDataFrame([("a", at(0)), ("a", at(50)), ("b", at(600)), ("c", at(0))], "run_id string, ts timestamp")
    got = {r.run_id: r for r in runs.detect_stale(beats, state, F.lit(at(900))).collect()}
    assert got["a"].status == "failed" and got["a"].finished_at == at(50) and got["a"].last_heartbeat_at is None and got["a"].error == runs.STALE_ERROR
    assert got["b"].status == "running" and got["c"].status == "completed" and got["d"].status == "running"
    events = spark.createDataFrame([
        ("a", at(0), 1, "pending", None), ("a", at(1), 2, "running", "m1"), ("a", at(2), 3, None, "m2"), ("a", at(3), 4, "completed", None), ("a", at(4), 5, "running", None),
        ("b", at(0), 6, "running", "m"), ("b", at(5), 7, "failed", None), ("c", at(0), 8, None, "w")], "run_id string, ts timestamp, event_id long, status string, message string")
    assert rows(runs.fold_runs(events)) == sorted([
        ("a", "completed", at(0), at(3), None), ("b", "failed", at(0), at(5), "m"), ("c", "pending", at(0), None, "w")], key=repr)
    old = spark.createDataFrame([("a", "completed", at(0)), ("b", "running", at(0)), ("c", "completed", at(86400 * 20))], "run_id string, status string, created_at timestamp")
    assert rows(runs.purge(old, F.lit(at(86400 * 40))), "run_id") == [("b",), ("c",)]
