"""The cut form of ordered work gives what the plain window gives."""

import random

from pyspark.sql import functions as F

from codefacts.operators import graph, messages
from codefacts.operators.ordering import neighbour, paged_lists, positions

from .conftest import rows


def sample(spark):
    rng = random.Random(1)
    # key 0 holds most rows
    data = [(0 if rng.random() < 0.6 else rng.randint(1, 5), n * 2, rng.choice([None, n])) for n in range(250)]
    return spark.createDataFrame(data, "k int, n long, v long").repartition(7)


def test_positions(spark):
    df = sample(spark)
    assert rows(positions(df, ["k"], ["n"], bounded=True)) == rows(positions(df, ["k"], ["n"]))


def test_neighbour_both_ways(spark):
    df = sample(spark)
    for following in (False, True):
        values = {"a": F.col("v"), "b": F.col("n")}
        plain = neighbour(df, ["k"], ["n"], values, True, following).select("k", "n", "v", "a", "b")
        cut = neighbour(df, ["k"], ["n"], values, False, following).select("k", "n", "v", "a", "b")
        assert rows(plain) == rows(cut)


def test_paged_lists(spark):
    df = sample(spark)
    cut = paged_lists(df, ["k"], ["n"], F.col("n"), page_size=7)
    assert rows(paged_lists(df, ["k"], ["n"], F.col("n"), page_size=7, bounded=True)) == rows(cut)
    assert cut.filter(F.size("items") > 7).count() == 0


def test_hot_key_in_a_narrow_range(spark):
    """Nine tenths of the rows in one key, in texts that share a long prefix: no partition gets them all."""
    from codefacts.operators.ordering import _swept

    data = [("hot", f"a very long prefix that all share {n:05d}") for n in range(900)] + [(f"k{n}", "z") for n in range(100)] + [(None, "x"), (None, "y")]
    df = spark.createDataFrame(data, "k string, s string")
    spread = _swept(df, ["k"], ["s"], {})
    most = spread.filter("k = 'hot'").groupBy("_piece").count().agg(F.max("count")).first()[0]
    assert most < 600
    assert rows(positions(df, ["k"], ["s"])) == rows(positions(df, ["k"], ["s"], bounded=True))


def test_keys_that_go_on_over_batches_and_partitions(spark):
    """Batches of three rows, more partitions than keys, null keys and values, two key columns, values of several types."""
    rng = random.Random(11)
    for n, most in ((1, 1), (40, 2), (400, 2), (400, 60)):
        data = [(rng.choice([None, *range(most)]), rng.choice(["x", "y", None]), i, rng.choice([None, None, i]), rng.choice([None, f"t{i}"])) for i in range(n)]
        df = spark.createDataFrame(data, "k int, j string, n long, v long, t string").repartition(3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        try:
            assert rows(positions(df, ["k", "j"], ["n"])) == rows(positions(df, ["k", "j"], ["n"], bounded=True))
            values = {"a": F.col("v"), "b": F.struct("t", "n"), "c": F.when(F.col("n") % 7 == 0, F.col("t"))}
            for following in (False, True):
                cut = neighbour(df, ["k", "j"], ["n"], values, following=following)
                assert rows(cut) == rows(neighbour(df, ["k", "j"], ["n"], values, True, following))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert positions(df.limit(0), ["k"], ["n"]).collect() == []


def test_def_use_in_pieces_equals_a_loop(spark):
    rng = random.Random(5)
    data = [(rng.randint(0, 2), n, f"k{rng.randint(0, 6)}", f"v{rng.randint(0, 3)}", rng.choice(["use", "def", "write"])) for n in range(300)]
    df = spark.createDataFrame(data, "scope int, seq long, var_key string, variable string, op string")
    want, keyed, named = [], {}, {}
    for scope, seq, key, variable, op in data:
        if op == "use":
            want.append((scope, seq, keyed.get((scope, key), named.get((scope, variable)))))
        else:
            keyed[scope, key] = named[scope, variable] = seq
    for bounded in (True, False):
        got = rows(graph.link_def_use(df, bounded), "scope", "seq", "def_seq")
        assert got == sorted(want, key=repr)


def test_slices_and_lineage_in_pieces(spark):
    data = [(t, n, "user" if n % 2 else "ai", f"m{n}") for t in range(3) for n in range(40)]
    df = spark.createDataFrame(data, "thread int, turn long, role string, content string")
    for start in (1, 5, -3, 0, 100):
        plain = messages.slice_messages(df, role="user", start=start, limit=4, bounded=True)
        cut = messages.slice_messages(df, role="user", start=start, limit=4)
        assert rows(plain) == rows(cut)
    turns = df.select("thread", "turn", F.concat_ws("-", "thread", "turn").alias("checkpoint_id"))
    columns = ["thread", "turn", "checkpoint_id", "parent_checkpoint_id"]
    assert rows(messages.turn_lineage(turns, []), *columns) == rows(messages.turn_lineage(turns, [7.0]), *columns)
