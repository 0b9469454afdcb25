import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from semlode.llm import mixing
from semlode.llm._shared import join_heavy


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * left / total > epochs * sizes[s]}
        if not over:
            return target | {s: w[s] * left / total for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_targets_and_taken(small, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, got = brute_targets(sizes), mixing.mix(small).collect()
    assert len(got) == len(rows)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(w for i, w in words.items() if rows[i][2] == s)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(small).collect()))


def test_clamped_sources(spark):
    data = [(i, "w " * 10, "big", "", 0) for i in range(1000)] + [(2000 + i, "w " * 10, "a-small", "", 0) for i in range(10)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _, _ in data], "doc_id long, text string, source string")
    got = {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg({"target": "max", "taken": "sum", "source_size": "max"}).collect()}
    assert got["a-small"]["max(target)"] == 200 and got["a-small"]["sum(taken)"] == 200
    assert got["big"]["max(target)"] == pytest.approx(1.5 * 10100 - 200)
    assert abs(got["big"]["sum(taken)"] - got["big"]["max(target)"]) < 100


def test_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert [r["size"] for r in got if r["doc_id"] == 1 and r["source"] == "s1"] == [14, 14]
    repeated = mixing.repeat_documents(odd)
    assert repeated.columns == odd.columns
    assert repeated.count() == sum(r["copies"] for r in got)


def test_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0


def test_rows_that_repeat_meet_the_target_too(spark):
    docs = spark.range(1000).select(F.lit(1).alias("doc_id"), F.lit("w " * 10).alias("text"), F.lit("s").alias("source"), F.col("id").alias("mix_id"), F.col("id").alias("MIX_copy"))
    got = mixing.mix(docs)
    assert got.count() == 1000 and {r["taken"] for r in got.collect()} == {10, 20}
    assert got.agg(F.sum("taken")).first()[0] == 15_000
    repeated = mixing.repeat_documents(docs)
    assert repeated.columns == docs.columns and repeated.count() == 1500
    assert repeated.select("mix_id").distinct().count() == 1000


def test_many_sources(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"))
    sources = sorted({f"s{i}" for i in range(300)})
    want = brute_targets({s: 9 for s in sources})
    got = mixing.mix(docs).collect()
    assert {r["source"]: r["target"] for r in got} == {s: pytest.approx(t) for s, t in want.items()}


def test_heavy_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(30)] + [(None, 1)], "k string, v long")
    table = spark.createDataFrame([("hot", "H"), ("k1", "a"), ("k2", "b"), ("unused", "c")], "k string, w string")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, rows.join(table, "k", how).collect()), key=repr)
        assert sorted(map(tuple, join_heavy(rows, table, "k", how, share=10).select("k", "v", "w").collect()), key=repr) == plain
