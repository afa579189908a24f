"""The pipeline against a plain version of its stages, and what it keeps of the table's columns."""

from collections import Counter

import corpus_pipeline
from codefacts.llm import quality_rules

from . import brute, data
from .test_tokens import check_packed


def write(spark, folder, rows, labels):
    data.table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def plain(rows):
    rows = [(i, t) for i, t in rows if not brute.statistics(t)[5]]
    best = {}
    for i, t in rows:
        key = (t or "").translate(brute.LOWER)
        if key not in best or (brute.low(i), t) > (brute.low(best[key][0]), best[key][1]):
            best[key] = (i, t)
    rows = list(best.values())
    classes = brute.near_classes(rows)
    return [r for r, (i, c, _) in zip(rows, classes) if brute.low(i) == brute.low(c)]


def test_pipeline(spark, tmp_path):
    rows = data.rows()
    write(spark, str(tmp_path), rows, [])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain(rows)
    assert len(want) > 5
    check_packed([(i, t) for i, t in want], out)


def test_stages_keep_columns_and_decide(spark, tmp_path):
    rows = data.rows()
    write(spark, str(tmp_path), rows, [])
    docs = data.table(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "jaccard_join", "secret_scan", "packing"]
    redacted = {r.doc_id: r.text for r in corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()}
    assert "hunter2" not in redacted[62] and redacted[1] is None and redacted[30] == dict(rows)[30]


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_of_the_given_labels_keep_the_good(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.learn_from(docs, labels)
    out = quality_rules.judged(docs, rules).filter("not __verdict.base_failed").join(labels, "doc_id").select("quality", "__verdict.kept")
    found = Counter(tuple(r) for r in out.collect())
    assert found[1, False] <= 0.01 * found[1, True] and found[0, True] <= 0.1 * found[0, False]
