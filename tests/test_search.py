"""Exact search, with queries broadcast and in blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F
from semlode.operators import search


def unit(rng):
    v = [rng.uniform(-1, 1) for _ in range(5)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_blocked_search_equals_brute_force(spark, kind):
    rng = random.Random(4)
    name = (lambda i: f"é-{i}") if kind == "string" else (lambda i: i)
    rows = [(name(i), unit(rng)) for i in range(60)]
    rows += [(name(60), rows[7][1]), (None, unit(rng)), (name(61), None)]
    asked = [(name(i), unit(rng)) for i in range(7)]
    corpus = spark.createDataFrame(rows, f"id {kind}, vector array<double>").repartition(3).withColumn("vector", F.col("vector").cast("array<float>"))
    queries = spark.createDataFrame(asked, f"qid {kind}, vector array<double>")
    where = F.coalesce(F.col("id").cast("string") != F.lit(str(name(3))), F.lit(True))
    known = [(r["id"], r["vector"]) for r in corpus.collect() if r["id"] is not None and r["vector"] is not None and r["id"] != name(3)]
    want = set()
    for q, v in asked:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known)[:4]
        want |= {(q, i, rank) for rank, (_, i) in enumerate(best, 1)}
    blocked = search.nearest(queries, corpus, 4, where, block=3)
    assert [t for _, t in blocked.dtypes[:2]] == [t for _, t in corpus.dtypes[:1]] * 2
    assert {(r["qid"], r["id"], r["rank"]) for r in blocked.collect()} == want
    assert {(r["qid"], r["id"], r["rank"]) for r in search.nearest(queries, corpus, 4, where).collect()} == want


def test_no_queries_and_no_rows(spark):
    corpus = spark.createDataFrame([], "id string, vector array<float>")
    queries = spark.createDataFrame([("a", [1.0, 0.0])], "qid string, vector array<float>")
    assert search.nearest(queries, corpus).count() == 0
    assert search.nearest(queries.limit(0), corpus).count() == 0


def test_filters_skip_row_groups(spark):
    """A payload filter reaches the statistics of the corpus's files: most rows are not read."""
    from semlode.plans import staging as S
    from semlode.sources.shared import scanned

    corpus = S.stored_corpus(spark, "/root/testdata/sf0.1")
    every = scanned(corpus.select("id", "vector"))
    some = scanned(search.searchable(corpus, search.payload_filter(min_stars=30, license="Brand#12")).select("id", "vector"))
    print(f"{some['rows']} of {every['rows']} rows are read for one license and its stars")
    assert every["rows"] == corpus.count() and 0 < some["rows"] <= 0.5 * every["rows"]
    far = scanned(search.searchable(corpus, search.payload_filter(license="none such")).select("id", "vector"))
    assert far["rows"] == 0
