"""One way of searching for any number of queries: double vectors, gaps, lengths, copies and many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from semlode.operators import search


def rows(df):
    return [(r["qid"], r["id"], r["rank"], round(r["score"], 12)) for r in df.orderBy("qid", "rank").collect()]


def test_double_vectors_and_gaps(spark):
    corpus = spark.createDataFrame([(1, [0.1, 0.3]), (2, [0.1 + 1e-12, 0.3]), (3, [0.7, 0.1]), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, None), (None, [1.0, 1.0]), (8, [])], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 1.0]), (4, [2.0]), (5, [1.0, 2.0, 3.0]), (6, [])], "qid long, vector array<double>")
    assert [r[:3] for r in rows(search.nearest(queries, corpus, 3))] == [(1, 3, 1), (1, 2, 2), (1, 1, 3), (3, 3, 1), (3, 2, 2), (3, 1, 3), (4, 4, 1)]


@pytest.mark.parametrize("block", [2_000, 7])
def test_many_queries_and_copies(spark, monkeypatch, block):
    """Beyond 500 queries, in one block and in many, over vectors of which most are copies of one."""
    monkeypatch.setattr(search, "CHUNK", 20_000)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    x[50:300] = x[17]
    ids, q = rng.permutation(400), rng.normal(size=(600, 6))
    corpus = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>")
    want = []
    for i, v in enumerate(q):
        exact = (x * v).sum(axis=1)
        want += [(i, int(ids[j]), place, round(float(exact[j]), 12)) for place, j in enumerate(np.lexsort((ids, -exact))[:9], 1)]
    assert rows(search.nearest(queries, corpus, 9, block=block)) == want


def test_scores_have_a_bound(spark):
    """Many queries against many short vectors: no more than the scores of one slice at a time."""
    import tracemalloc

    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(2_000, 16)), rng.normal(size=(40_000, 16))
    tracemalloc.start()
    who, row, score = search._best(q, x, 10, 8 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # the whole matrix has 640 MB
    exact = q[:40] @ x.T
    assert [sorted(row[who == i].tolist()) for i in range(40)] == [sorted(np.argsort(-exact[i])[:10].tolist()) for i in range(40)] and len(score) == 20_000


def test_infinite_values(spark):
    """A vector with an infinity is not searched, and a query with one is not answered."""
    inf = float("inf")
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [inf, 0.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, [inf, 1.0])], "qid long, vector array<double>")
    assert [r[:3] for r in rows(search.nearest(queries, corpus, 3))] == [(1, 3, 1), (1, 1, 2)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    one = spark.createDataFrame([(1, [1.0])], "qid long, vector array<float>")
    assert search.nearest(one.limit(0), one.select(F.col("qid").alias("id"), "vector")).count() == 0


def test_rows_of_one_score_have_a_bound():
    """Every row has the same score for every query: only some pairs are looked at together, and the first rows win."""
    import tracemalloc

    x, q = np.zeros((8_000, 16)), np.zeros((100, 16))
    x[:, 0], x[:, 1:] = 0.5, np.random.default_rng(5).normal(size=(8_000, 15))
    q[:, 0] = np.arange(1, 101)
    tracemalloc.start()
    who, row, score = search._best(q, x, 10, 8 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(row.reshape(100, 10), np.tile(np.arange(10), (100, 1))) and np.array_equal(score, np.repeat(np.arange(1, 101) * 0.5, 10))
    assert peak < 50 << 20


def test_low_of_rows_seen_before():
    """Rows below what k rows before have reached are left out; those that equal it stay, as their ids may be smaller."""
    x, q, low = np.array([[3.0], [2.0], [1.0], [2.0]]), np.ones((1, 1)), np.full(1, -np.inf)
    assert search._best(q, x, 2, 1 << 20, low)[1].tolist() == [0, 1] and low.tolist() == [2.0]
    assert search._best(q, np.array([[1.0], [2.0], [0.5]]), 2, 1 << 20, low)[1].tolist() == [1]


def test_equal_queries_are_compared_once(spark, monkeypatch):
    """Queries of one vector share its comparisons, and rows that share a qid are one query."""
    seen, blocks = [], search.query_blocks
    monkeypatch.setattr(search, "query_blocks", lambda q, *a, **k: seen.append(q.count()) or blocks(q, *a, **k))
    corpus = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(10)] + [(None, [1.0, 1.0]), (3, [1.0, 1.0])], "qid long, vector array<double>")
    got = search.nearest(queries, corpus, 3).orderBy("qid", "rank").collect()
    want = {0: [0, 1, 2], 1: [4, 9, 14]}
    assert seen == [2]
    assert [r["id"] for r in got if r["qid"] is None] == want[1] and [r["id"] for r in got if r["qid"] == 3] == [4, 4, 9]
    assert all([r["id"] for r in got if r["qid"] == i] == want[i % 2] for i in range(10) if i != 3)


def test_vectors_of_one_length_are_not_copied_again():
    """A column of vectors of one length becomes a matrix of doubles without a second one."""
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(6).normal(size=(40_000, 64)).astype(np.float32)
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * 40_001, 64), pa.int32()), pa.array(x.ravel()))
    tracemalloc.start()
    rows_, matrix = search.vectors_of(column)[64]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(matrix, x.astype(np.float64)) and len(rows_) == 40_000
    assert peak < 1.5 * matrix.nbytes
