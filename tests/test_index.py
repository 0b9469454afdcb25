"""The stored index: exact by bounds against brute force, recall of the approximate search, partitions that are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from semlode.operators import search, vector_index
from semlode.operators.vector_index import VectorIndex
from semlode.plans import queries as Q
from semlode.plans import staging as S


def rows(df):
    return [(r["qid"], r["id"], r["rank"], r["score"]) for r in df.orderBy("qid", "rank").collect()]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_shares(spark, sf):
    d = f"/root/testdata/{sf}"
    got = Q.QUERIES["ann_shares"](spark, d)
    mean = got.agg(F.avg("recall").alias("recall"), F.avg("coded").alias("coded"), F.avg("products").alias("products"), F.count("qid").alias("n")).first()
    index = S.stored_index(spark, d)
    whole = index.centres.shape[1] * np.dtype(index.dtype).itemsize
    code = index.centres.shape[1] / 2 + 8  # four bits a coordinate, reach and what they leave out
    read = (mean["coded"] * code + mean["products"] * whole) / whole
    print(f"{sf}: {mean['n']} queries, recall@10 {mean['recall']:.3f}, {mean['products']:.3f} of pairs in full, {mean['coded']:.3f} by codes, at most {read:.3f} of the bytes of vectors")
    assert mean["n"] == S.query_vectors(spark, d).count()
    assert mean["recall"] >= 0.9 and mean["products"] <= 0.25
    # ann_topk is what the shares are of.
    exact = {r[:2] for r in rows(index.exact(S.query_vectors(spark, d), 10))}
    assert len({r[:2] for r in rows(Q.QUERIES["ann_topk"](spark, d))} & exact) == round(mean["recall"] * mean["n"] * 10)


def test_exact_equals_brute_force_with_few_products(spark):
    d = "/root/testdata/sf0.1"
    index, asked = S.stored_index(spark, d), S.query_vectors(spark, d)
    found, blocks = index.candidates(asked, 50, None, None)
    assert rows(index.ranked(index.products(found, blocks), 50)) == rows(search.nearest(asked, S.stored_corpus(spark, d), 50))
    share = index.work(asked, found, 50).agg(F.avg(F.col("products") / F.col("rows"))).first()[0]
    print(f"exact top 50: {share:.3f} of pairs in full")
    assert share < 0.12


@pytest.mark.parametrize("rows_of_a_file", [7, 1 << 16])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_copies_gaps_and_names(spark, tmp_path, monkeypatch, rows_of_a_file, kind):
    """Copies beyond k, names as texts, odd lengths, nulls, infinities; a matrix of a few rows at a time."""
    monkeypatch.setattr(vector_index, "MATRIX", 4_000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5))
    x[40:200] = x[7]
    x[210] = 0
    data = [(f"n{i:03}", v.tolist()) for i, v in enumerate(x)] + [("short", [1.0]), ("gap", [None, 1.0, 1.0, 1.0, 1.0]), ("far", [float("inf")] * 5), (None, [1.0] * 5), ("none", None)]
    corpus = spark.createDataFrame(data, f"id string, vector array<{kind}>").repartition(4)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*rng.normal(size=(40, 5)), x[7], np.zeros(5)])] + [(90, [1.0]), (91, None), (92, [float("nan")] * 5)], f"qid long, vector array<{kind}>")
    VectorIndex.build(corpus, f"file://{tmp_path}/i", lists=6, rows=rows_of_a_file)
    index = VectorIndex.open(spark, f"file://{tmp_path}/i")
    assert index.codes().count() == 300
    want = [r for r in rows(search.nearest(asked, corpus, 9)) if r[0] < 90]
    assert rows(index.exact(asked, 9)) == want
    assert rows(index.approximate(asked, 9, probes=6, short=300)) == want
    some = {r[:2] for r in rows(index.approximate(asked, 9, probes=3, short=40))}
    assert len(some & {r[:2] for r in want}) > 0.6 * len(want)


def test_bounds_hold(spark):
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(500, 33)) * rng.choice([1e-6, 1, 1e4], size=(500, 1)), rng.normal(size=(50, 33))
    high, low, reach, off_high, off_low = vector_index.encode(x, x[3])
    for part, off in ((None, off_high), (low, off_low)):
        near = vector_index.decode(x[3], reach, high, part)
        assert (np.abs(q @ x.T - q @ near.T) <= np.linalg.norm(q, axis=1)[:, None] * off[None, :].astype(float) + 1e-9 * np.abs(q @ x.T) + 1e-12).all()
    assert (off_low <= off_high).mean() > 0.99


def test_other_partitions_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(7)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))], "id long, vector array<float>")
    index = VectorIndex.build(corpus, f"file://{tmp_path}/i", lists=8)
    plan = index.codes([2, 5])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert {r[0] for r in index.codes([2, 5]).select("list").distinct().collect()} == {2, 5}


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vector array<float>")
    one = spark.createDataFrame([(1, [1.0])], "qid long, vector array<float>")
    index = VectorIndex.build(none, f"file://{tmp_path}/i")
    assert index.exact(one).count() == 0 and VectorIndex.open(spark, f"file://{tmp_path}/i").approximate(one).count() == 0
