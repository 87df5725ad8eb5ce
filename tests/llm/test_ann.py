"""Nearest neighbours: exact scores, and recall against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import ann, queries


def brute(x, ids, q, k):
    s = x @ x[q]
    s[ids == ids[q]] = -np.inf
    order = np.lexsort((ids, -s))
    return ids[order[np.isfinite(s[order])][:k]]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1", "check_h"])
def test_recall_and_scores(spark, sf):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):  # the check tool's tables are not everywhere
        pytest.skip(folder)
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got = queries.op3_nearest_neighbours(spark, folder).toPandas().sort_values(["query_id", "rank"])
    asks = np.flatnonzero(ids % 20 == 0)
    assert set(got.query_id) == set(ids[asks]) and len(got) == 20 * len(asks)
    hits = 0
    for q in asks:
        mine = got[got.query_id == ids[q]]
        assert list(mine["rank"]) == list(range(1, 21)) and ids[q] not in set(mine.vec_id)
        want = x[np.searchsorted(ids, mine.vec_id)] @ x[q]
        assert np.allclose(mine.score, want, rtol=0, atol=1e-12) and (np.diff(mine.score) <= 0).all()
        hits += len(set(mine.vec_id) & set(brute(x, ids, q, 20)))
    assert hits / (20 * len(asks)) > 0.95


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=10)]) for i in range(0, 400)]
    rows += [(1000 + i, [1.0] * 10) for i in range(500)]  # copies: ties go to smaller ids
    bad = [(5000, None), (5020, []), (5040, [0.0] * 10), (5060, [None] + [1.0] * 9), (5080, [float("nan")] + [1.0] * 9), (5100, [float("inf")] * 10), (5120, [1.0] * 9), (None, [1.0] * 10)]
    schema = "vec_id long, embedding array<double>, score string"
    vectors = spark.createDataFrame([(*r, "x") for r in rows + bad], schema)
    got = ann.search(vectors, F.col("vec_id") % 20 == 0, k=5, block_rows=64).toPandas()
    assert set(got.query_id) == {i for i, _ in rows if i % 20 == 0}
    mine = got[got.query_id == 1020].sort_values("rank")
    assert list(mine.vec_id) == [1000, 1001, 1002, 1003, 1004] and (mine.score == 10).all()
    assert list(got[got.query_id == 1000].sort_values("rank").vec_id) == [1001, 1002, 1003, 1004, 1005]


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], schema)
    got = ann.search(three, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert ann.search(three.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(three, F.col("vec_id") < 0).count() == 0
    assert ann.search(three.limit(1), F.lit(True)).count() == 0


def hot_vectors(spark, n=12_000):
    """A third of all rows close to one vector, and copies among them."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 24))
    x[: n // 3] = x[0] + 0.05 * rng.normal(size=(n // 3, 24))
    x[: n // 20] = x[0]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_hot_group_and_share_of_rows(spark):
    x, table = hot_vectors(spark)
    stats = {}
    got = ann.search(table, F.col("vec_id") % 20 == 0, k=20, m=8, block_rows=1024, stats=stats).toPandas()
    assert stats["share"] < 0.5
    ids, hits, asks = np.arange(len(x)), 0, range(0, len(x), 20 * 16)
    by = got.sort_values("rank").groupby("query_id").vec_id.apply(list)
    for q in asks:
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        edge = np.sort(s)[-20]
        hits += sum(s[i] >= edge for i in by[q])  # of equals beyond the twentieth any is as near
    assert hits / (20 * len(asks)) > 0.95
    assert len(got) == 20 * len(by) == 20 * 600


def test_sampled_index_of_a_larger_table(spark):
    """More rows than the sample: all are indexed, and found."""
    x, table = hot_vectors(spark)
    got = ann.search(table, F.col("vec_id") % 400 == 0, k=10, m=8, sample_rows=1500, guide_rows=500, max_cells=64, block_rows=900).toPandas()
    for q in range(0, len(x), 400):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, s[mine.vec_id]) and len(mine) == 10
    assert ann.measured_recall(got_frame(spark, got), table, F.col("vec_id") % 400 == 0, k=10) > 0.9


def got_frame(spark, pdf):
    return spark.createDataFrame(pdf[["query_id", "vec_id"]])


def test_strings_as_ids_and_several_vectors_of_a_query(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.5]), ("c", [0.25, 0.25]), ("c", [0.25, 0.25])]
    got = ann.search(spark.createDataFrame(rows, "vec_id string, embedding array<float>"), F.col("vec_id") == "a", k=3, m=2)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [("a", 1, "b", 0.5), ("a", 2, "c", 0.25), ("a", 3, "c", 0.25)]
