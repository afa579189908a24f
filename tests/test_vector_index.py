"""The stored vector index: all rows, exact scores, recall against the exact operator."""

import numpy as np
import pytest

from codefacts.operators import vector_index
from codefacts.operators.retrieval import knn
from codefacts.plans.registry import QUERIES
from codefacts.session import new_table_path

from .conftest import rows


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_recall_against_the_exact_operator(spark, scale):
    folder = f"/root/testdata/sf{scale}"
    exact = {(r.query_id, r.id): r.score for r in QUERIES["vector_neighbours"](spark, folder).collect()}
    got = {(r.query_id, r.id): r.score for r in QUERIES["approximate_neighbours"](spark, folder).collect()}
    both = exact.keys() & got.keys()
    assert len(both) >= 0.9 * len(exact) and {q for q, _ in got} == {q for q, _ in exact}
    assert all(got[p] == exact[p] for p in both)


def test_probes_come_in_the_order_of_their_margins():
    rng = np.random.default_rng(1)
    margins = rng.normal(size=(20, 6))
    every = vector_index.probe_order(margins, 64)
    signs = (every[:, :, None] >> np.arange(6)) & 1
    cost = np.where(signs == (margins > 0)[:, None, :], 0, margins[:, None, :] ** 2).sum(axis=2)
    assert (np.diff(cost, axis=1) >= 0).all() and all(sorted(r) == list(range(64)) for r in every.tolist())
    assert (vector_index.probe_order(margins, 9) == every[:, :9]).all()
    wide = vector_index.planes(4, 10, 3)
    assert wide.shape == (4, 10) and np.allclose(wide[:, :4].T @ wide[:, :4], np.eye(4))


def test_every_row_is_indexed_and_groups_stay_apart(spark):
    """Clustered vectors, a hot bucket of copies, nulls and two groups; with all probes the index is exact."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    data = [(i, "ab"[i % 2], (centres[i % 12] + 0.2 * rng.normal(size=16)).tolist()) for i in range(600)]
    data += [(1000 + i, "a", data[0][2]) for i in range(300)] + [(2000, "a", None), (2001, "b", [0.0] * 16)]
    vectors = spark.createDataFrame(data, "id long, repo_id string, vector array<double>")
    asked = spark.createDataFrame([(i, g, v) for i, g, v in data[1:200:7]] + [(9999, "c", data[0][2])], "query_id long, repo_id string, vector array<double>")
    path = new_table_path(spark, "index")
    about = vector_index.build_index(vectors, path, rows_per_bucket=16).first()
    assert about.rows == 901 and about.probes < 1 << about.bits and about.sample_recall >= 0.95
    assert sorted(r.id for r in spark.read.parquet(f"{path}/cells").collect()) == sorted(i for i, _, v in data if v)
    want = rows(knn(asked, vectors.filter("vector IS NOT NULL")), "query_id", "id", "rank")
    assert rows(vector_index.ask_index(spark, path, asked, probes=1 << about.bits), "query_id", "id", "rank") == want
    got = {(q, i) for q, i, _ in rows(vector_index.ask_index(spark, path, asked), "query_id", "id", "rank")}
    assert len(got & {(q, i) for q, i, _ in want}) >= 0.9 * len(want)


def test_an_empty_table_gives_an_empty_index(spark):
    path = new_table_path(spark, "index")
    none = spark.createDataFrame([], "id long, repo_id string, vector array<float>")
    assert vector_index.build_index(none, path).first().rows == 0
    assert vector_index.ask_index(spark, path, none.withColumnRenamed("id", "query_id")).collect() == []
