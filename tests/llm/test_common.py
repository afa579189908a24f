from pyspark.sql import functions as F

from codefacts.llm.common import computed, only_rows, sampled

from . import data


def test_sampled_is_bounded_and_stable(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 7)
    some = sampled(df, 300, "id").collect()
    assert 250 <= len(some) <= 300
    assert some == sampled(df.repartition(9), 300, "id").collect()
    assert sampled(df, 10_000, "id").count() == 5000 and sampled(df.limit(0), 10, "id").count() == 0


def test_only_rows_keeps_whole_copies_once(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, ""), (2, "a")]
    docs = data.table(spark, rows)
    kept = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).filter("doc_id is null or doc_id = 1")
    out = only_rows(docs, kept)
    assert out.columns == docs.columns
    found = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=repr)
    assert found == [(1, "a"), (1, "b"), (None, "")]


def test_computed_once_per_row(spark):
    df = computed(spark.range(3), a=F.col("id") + 1, b=F.lit("x"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(0, 1, "x"), (1, 2, "x"), (2, 3, "x")]
    assert "Generate" in df.filter("a > 1")._jdf.queryExecution().optimizedPlan().toString()


def test_members(spark):
    import numpy as np

    from codefacts.llm import common

    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), 1 << 63, (3000, 2), dtype=np.int64)
    held = common.members(spark.createDataFrame(keys[:1000].tolist(), "id long, rid long"))
    assert held.has(keys[:1000, 0], keys[:1000, 1]).all() and held.has(keys[1000:, 0], keys[1000:, 1]).mean() < 0.1
    assert not common.members(spark.createDataFrame([], "id long, rid long")).has(keys[:, 0], keys[:, 1]).any()
