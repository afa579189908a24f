import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from codefacts.operators import runs as batch
from codefacts.sources import files as sources
from codefacts.sources.json_facts import explode_ast
from codefacts.streaming import runs, sinks
from codefacts.streaming import sources as arriving
from codefacts.streaming.state import Silences, join_stretch

from .conftest import rows

T = dt.datetime(2024, 1, 1)


def archive(path, members):
    with zipfile.ZipFile(path, "w") as out:
        for name, data in members.items():
            out.writestr(name, data)


def test_archives(spark, tmp_path):
    archive(tmp_path / "one.zip", {"src/": b"", "src/a.java": b"class A {}", "__MACOSX/src/a.java": b"x", "b.bin": b"\xff\xfeok"})
    archive(tmp_path / "two.zip", {"c.txt": "é".encode()})
    got = {r.path.split("/", 1)[1].split(str(tmp_path).strip("/"))[-1]: r.content for r in sources.read_archives(spark, f"{tmp_path}/*.zip").collect()}
    assert got == {"/one/src/a.java": "class A {}", "/one/b.bin": "��ok", "/two/c.txt": "é"}


def test_source_tree(spark, tmp_path):
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / "p" / "q" / "a.java").write_bytes(b"x\xffy")
    (tmp_path / "p" / "b.txt").write_text("t")
    assert rows(sources.read_sources(spark, str(tmp_path)), "path", "content") == [("p/b.txt", "t"), ("p/q/a.java", "x�y")]
    assert sources.read_sources(spark, str(tmp_path), "*.java").count() == 1


def test_graph_tables_and_point_reads(spark, tmp_path):
    path = str(tmp_path / "g")
    df = spark.createDataFrame([("r1", "f1", "s1", "{}"), ("r1", "f1", "s1", "{}"), ("r2", "f2", "s1", "{}")], "repo_id string, file_id string, scope string, content string")
    sources.write_graphs(df, path, ["repo_id", "file_id", "scope"])
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    one = sources.get_rows(stored, "r2", "f2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and "PartitionFilters: [isnotnull(repo_id" in plan and "EqualTo(file_id,f2)" in plan
    outcome = sources.graph_outcome(spark.createDataFrame([(1, True, "a"), (1, True, "b"), (2, False, None), (3, True, None)], "file_id int, built boolean, scope string"))
    assert rows(outcome) == [(1, 2, 0), (2, 0, -1), (3, 0, 0)]
    sources.write_text(df, str(tmp_path / "j"))
    sources.write_text(df.withColumn("t", F.lit("a\nb")), str(tmp_path / "t"), "t")
    assert spark.read.json(str(tmp_path / "j")).count() == 3 and spark.read.text(str(tmp_path / "t")).first()[0] == "a\\nb"


def test_stored_syntax_trees(spark):
    doc = {"file": "p/A.java", "key": "file:p/A.java", "package": "p", "imports": [{"path": "x.Y", "static": False, "wildcard": False}], "extra": 1,
           "classes": [{"name": "A", "fqn": "p.A", "key": "type:p.A", "line_start": 3, "fields": [{"name": "f", "type_simple": "int", "type_fqn": "int"}],
                        "methods": [{"name": "m", "return_type_fqn": "void", "signature_simple": "m()"}]}],
           "interfaces": [{"name": "I", "fqn": "p.I", "methods": [{"name": "n"}]}], "enums": [{"name": "E", "fqn": "p.E", "body": ["X"]}]}
    df = spark.createDataFrame([("r", "f", json.dumps(doc)), ("r", "g", "{}")], "repo_id string, file_id string, content string")
    facts = explode_ast(df)
    assert rows(facts["types"], "kind", "fqn") == [("class", "p.A"), ("enum", "p.E"), ("interface", "p.I")]
    assert rows(facts["methods"], "owner_fqn", "name") == [("p.A", "m"), ("p.I", "n")]
    assert rows(facts["fields"], "owner_fqn", "name") == [("p.A", "f")] and rows(facts["imports"], "path") == [("x.Y",)]


def arrivals(spark, tmp_path, data, schema, files=3):
    """A table whose files arrive one per batch."""
    path = str(tmp_path / "in")
    for i in range(files):
        spark.createDataFrame(data[i::files], schema).coalesce(1).write.mode("append").parquet(path)
    return arriving.stream_table(spark, path, files_per_trigger=1), spark.read.parquet(path)


def test_run_state_stream_equals_batch(spark, tmp_path):
    names = ["pending", "running", None, "completed", "failed"]
    data = [(n % 4, T + dt.timedelta(seconds=(n * 7) % 50), n, names[(n * 3) % 5], f"m{n}" if n % 3 else None) for n in range(60)]
    stream, table = arrivals(spark, tmp_path, data, "run_id int, ts timestamp, event_id int, status string, message string")
    assert rows(runs.run_fold(stream)) == rows(batch.fold_runs(table))


def test_silences(spark, tmp_path):
    data = [("a", T + dt.timedelta(seconds=s)) for s in (0, 100, 500, 2000)] + [("b", T + dt.timedelta(seconds=3000))]
    stream, _ = arrivals(spark, tmp_path, data, "run_id string, ts timestamp", files=1)
    at = lambda s: T + dt.timedelta(seconds=s)
    closed = [("a", at(0), at(500), 3), ("a", at(2000), at(2000), 1)]
    assert rows(runs.run_stale_sessions(stream)) == sorted([*closed, ("b", at(3000), at(3000), 1)], key=repr)
    stream, _ = arrivals(spark, tmp_path / "again", data, "run_id string, ts timestamp", files=1)
    assert rows(runs.run_stale_sessions(stream, now=F.lit(at(3200)))) == sorted(closed, key=repr)


def test_silences_of_rows_out_of_order(spark, tmp_path):
    """A row that comes later joins two stretches; the last silence of each run is reported without another heartbeat."""
    # file by file: a0 b0, a800 b100, a400 c700, b5000 a9000
    order = [("a", 0), ("a", 800), ("a", 400), ("b", 5000), ("b", 0), ("b", 100), ("c", 700), ("a", 9000)]
    stream, _ = arrivals(spark, tmp_path, [(r, T + dt.timedelta(seconds=s)) for r, s in order], "run_id string, ts timestamp", files=4)
    at = lambda s: T + dt.timedelta(seconds=s)
    assert rows(runs.run_stale_sessions(stream)) == sorted([
        ("a", at(0), at(800), 3), ("a", at(9000), at(9000), 1), ("b", at(0), at(100), 2), ("b", at(5000), at(5000), 1),
        ("c", at(700), at(700), 1)], key=repr)


def test_silences_make_few_calls_to_the_state():
    """One read, one write and a timer that moves only when the first stretch does, however many stretches are open."""
    calls, held = [], {}

    class Handle:
        def getValueState(self, name, schema):
            return self

        def get(self):
            return calls.append("get") or held.get("state")

        def update(self, state):
            calls.append("update")
            held["state"] = state

        def clear(self):
            calls.append("clear")
            held.clear()

        def registerTimer(self, at):
            calls.append(("timer", at))

        def deleteTimer(self, at):
            calls.append(("no timer", at))

    class At:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    def seen(beats, now):
        calls.clear()
        return [tuple(r) for r in fold.handleInputRows(("a",), [type("R", (), {"at": s * 1_000_000}) for s in beats], At(now))]

    fold = Silences(10)
    fold.init(Handle())
    assert seen([100 * n for n in range(50, 0, -1)], 0) == [] and calls == ["get", ("timer", 110_001), "update"]
    assert seen([105, 205], 0) == [] and calls == ["get", ("no timer", 110_001), ("timer", 115_001), "update"]
    assert seen([5000], 0) == [] and calls == ["get", "update"]
    calls.clear()
    out = [tuple(r) for r in fold.handleExpiredTimer(("a",), At(230_000), None)]
    assert out == [("a", 100_000_000, 105_000_000, 2), ("a", 200_000_000, 205_000_000, 2)] and calls == ["get", ("timer", 310_001), "update"]
    calls.clear()
    out = [tuple(r) for r in fold.handleExpiredTimer(("a",), At(9_000_000), None)]
    assert len(out) == 48 and out[-1] == ("a", 5_000_000_000, 5_000_000_000, 2) and calls == ["get", "clear"]
    stretches = []
    for at in (50, 9, 70, 60, 20, 10, 85):
        join_stretch(stretches, at, 10)
    assert stretches == [(9, 20, 3), (50, 70, 3), (85, 85, 1)]


def test_state_of_silent_runs_goes(spark, tmp_path):
    """Each file has runs of its own, hours after the last file's; a run that comes back after its state went is merged."""
    data = [(f * 10 + n % 10, T + dt.timedelta(hours=f, seconds=n), f * 20 + n, ("running", "completed")[n // 10], f"m{n}") for f in range(6) for n in range(20)]
    data += [(3, T + dt.timedelta(hours=6, seconds=s), 900 + s, "running", "again") for s in range(6)]
    path = str(tmp_path / "in")
    for f in range(7):
        part = data[f * 20 : f * 20 + 20]
        spark.createDataFrame(part, "run_id int, ts timestamp, event_id int, status string, message string").coalesce(1).write.mode("append").parquet(path)
    stream, table = arriving.stream_table(spark, path, files_per_trigger=1), spark.read.parquet(path)
    held = []
    original = sinks.run_batches

    def watched(stream, name, body, mode="append"):
        where = original(stream, name, body, mode)
        held.append(spark.read.format("statestore").option("path", f"{where.removesuffix('/data')}/state").option("stateVarName", "fold").load().count())
        return where

    runs.run_batches = watched
    try:
        got = rows(runs.run_fold(stream, grace_seconds=600))
    finally:
        runs.run_batches = original
    assert got == rows(batch.fold_runs(table)) and table.select("run_id").distinct().count() == 60
    assert held[0] <= 11  # the runs of the last file, and those the watermark has not reached


def test_progress_and_late_rows(spark, tmp_path):
    data = [("a", n, T + dt.timedelta(seconds=n / 4)) for n in range(40)]
    stream, table = arrivals(spark, tmp_path, data, "run string, n int, ts timestamp", files=1)
    want = batch.throttle(table, "run", "1 second")
    assert rows(runs.run_throttled(stream, "run", "1 second", "0 seconds")) == rows(want)
    emitted = sinks.run_to_table(runs.throttled(stream, "run", "1 second", "0 seconds"), "closed")
    assert set(rows(emitted)) < set(rows(want)) and emitted.count() == 9
    left = runs.late_rows(want, emitted, ["run", "bucket"])
    assert rows(emitted.unionByName(left)) == rows(want)


def test_replays_add_nothing(spark, tmp_path):
    data = [(n % 10, n) for n in range(30)]
    stream, _ = arrivals(spark, tmp_path, data, "k int, n int")
    assert [k for (k,) in rows(runs.run_insert(stream, ["k"]), "k")] == list(range(10))
    body = sinks.insert_batch(["k"])
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(1, 1), (2, 2)], "k int, n int")
    for _ in range(2):  # the same batch twice
        body(first, 0, path)
    body(spark.createDataFrame([(2, 9), (3, 3)], "k int, n int"), 1, path)
    assert rows(sinks.read_batches(spark, path, first.schema)) == [(1, 1), (2, 2), (3, 3)]


def test_files_read_per_batch_do_not_grow(spark, tmp_path):
    """Twenty batches of a few keys each: a batch opens the files of its own buckets, at most two in each."""
    path, seen, most_read = str(tmp_path / "store"), {}, []
    for number in range(20):
        data = [(k % 97, None if k % 5 else "x", number) for k in range(number * 3, number * 3 + 5)]
        for _ in range(1 + number % 2):  # every other batch is replayed
            store = sinks.KeyedStore(spark, path, ["k", "s"], buckets=16, most=2)
            store.insert(spark.createDataFrame(data, "k int, s string, n int"), number)
        for k, s, n in data:
            seen.setdefault((k, s), n)
        most_read.append(store.files_read)
    assert max(most_read) <= 5 * 2  # five buckets at most, two files in each
    assert rows(sinks.read_batches(spark, path, "k int, s string, n int")) == sorted([(k, s, n) for (k, s), n in seen.items()], key=repr)
    kept = list((tmp_path / "store" / "data").glob("*/bucket=*/*.parquet"))
    assert len(kept) <= 2 * 16 * 5


def test_a_batch_that_failed_before_its_manifest_is_done_again(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda: sinks.KeyedStore(spark, path, ["k"], buckets=4)
    make().insert(spark.createDataFrame([(1, 1), (2, 1)], "k int, n int"), 0)
    broken = make()
    broken._sweep = lambda number: None
    original = broken.spark.createDataFrame
    try:
        broken.spark.createDataFrame = lambda *a, **b: 1 / 0  # the rows are written, the manifest is not
        broken.insert(original([(2, 2), (3, 2)], "k int, n int"), 1)
    except ZeroDivisionError:
        pass
    finally:
        del broken.spark.createDataFrame
    assert rows(sinks.read_batches(spark, path, "k int, n int")) == [(1, 1), (2, 1)]
    make().insert(spark.createDataFrame([(2, 2), (3, 2)], "k int, n int"), 1)
    assert rows(sinks.read_batches(spark, path, "k int, n int")) == [(1, 1), (2, 1), (3, 2)]


def test_arriving_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in" / "r1.zip", {"a.java": b"1", "b/c.java": b"2"})
    archive(tmp_path / "in" / "r2.zip", {"a.java": b"3"})
    stream = arriving.stream_archives(spark, str(tmp_path / "in"), files_per_trigger=1)
    catalog = arriving.run_archive_catalog(stream, lambda path: F.regexp_extract(path, r"/(r\d)/", 1))
    assert sorted((r.repo_id, r.path.rsplit("/in/", 1)[1]) for r in catalog.collect()) == [("r1", "r1/a.java"), ("r1", "r1/b/c.java"), ("r2", "r2/a.java")]


def test_graph_table_rows_are_all_compared(spark):
    from codefacts.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert rows(QUERIES["graph_table_rows"](spark, folder), "file_id", "scope") == rows(docs, "doc_id", "lang")
