"""Facts kept up to date against facts of everything at once."""

from pathlib import Path

from codefacts.operators.facts import CodeFacts
from codefacts.operators.incremental import TABLES, FactStore, run_facts
from codefacts.streaming.sources import stream_table

from .conftest import rows

SCHEMA = "repo_id string, file_id long, path string, content string, deleted boolean, n int"


def text(i, v):
    return f"package p{v}; import a.B{v}; class C{i} {{ int f{v}; int m{v}(int a) {{ if (a > {v}) {{ f{v} = a; }} return a; }} }}"


def test_three_batches_equal_one_batch(spark, tmp_path):
    one = [("r", i, f"{i}.java", text(i, 0), False, 0) for i in range(30)]
    two = [("r", i, f"{i}.java", text(i, 1 if i % 3 == 0 else 0), False, 1) for i in range(0, 30, 2)]  # some of them changed
    two += [("r", 1, "1.java", text(1, 7), False, 1), ("r", 1, "1.java", text(1, 8), False, 2), ("r", 40, "new.java", None, False, 1)]
    three = [("r", i, f"{i}.java", None, True, 3) for i in (0, 1, 5, 77)] + [("r", 2, "moved.java", text(2, 0), False, 3), ("r", 41, "bad.java", "class {", False, 3)]
    state = {}
    for _, i, path, content, deleted, n in sorted(one + two + three, key=lambda r: r[-1]):
        state.pop(i, None)
        if not deleted:
            state[i] = ("r", i, path, content)
    for batch in (one, two, three):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = FactStore(spark, str(tmp_path / "store"), buckets=8)
    read = run_facts(stream_table(spark, str(tmp_path / "in"), files_per_trigger=1), store, "n")
    assert read == [30, 5 + 2, 2]  # files 0 6 12 18 24, 1 and 40; then the moved one and the new one
    code = CodeFacts(spark.createDataFrame(list(state.values()), "repo_id string, file_id long, path string, content string"))
    for name, table in TABLES.items():
        want = table(code)
        assert rows(store.read(name), *want.columns) == rows(want), name
    assert sorted(r.file_id for r in store.read("hashes").collect()) == sorted(state)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    tables = {"methods": TABLES["methods"]}
    store = FactStore(spark, str(tmp_path / "store"), tables, buckets=8)
    make = lambda data: spark.createDataFrame(data, SCHEMA).drop("n")
    every = [("r", i, f"{i}.java", text(i, 0), False, 0) for i in range(40)]
    assert store.update(make(every)) == 40
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(tmp_path, "store", "methods").rglob("*.parquet")}
    before = files()
    assert store.update(make(every)) == 0 and files() == before  # a repeated update changes nothing
    assert store.update(make([("r", 3, "3.java", text(3, 9), False, 0)])) == 1
    after = files()
    assert len(before.keys() & after.keys()) == len(before) - 1 and all(after[p] == before[p] for p in before.keys() & after.keys())
    assert store.update(make([("r", i, None, None, True, 0) for i in range(40)])) == 0 and store.read("methods").count() == 0
