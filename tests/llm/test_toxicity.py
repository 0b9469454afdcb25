import itertools
import json
import zlib

import numpy as np
from semlode.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == 10_000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in truth if got[i]["held_out"]]
    toxic = [got[i]["predicted"] for i in held if truth[i]]
    clean = [got[i]["predicted"] for i in held if not truth[i]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {texts[i][a:b].lower() for i in held for a, b in json.loads(got[i]["spans"])}
    assert {"idiot", "moron", "scum"} <= words


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(0, np.uint64), np.zeros(0), -1.0, rng.normal(size=(2, 2)), np.zeros(5))
    emission, gaps = np.array([2.0, -0.5]), np.array([1, 2, 1])
    chain = [field.bias, emission[0], field.bias, field.bias, emission[1], field.bias]
    weight = np.zeros((len(chain), 2))
    for states in itertools.product((0, 1), repeat=len(chain)):
        total, before = 0.0, 0
        for e, s in zip(chain, states):
            total += field.trans[before, s] + (e if s else 0.0)
            before = s
        for i, s in enumerate(states):
            weight[i, s] += np.exp(total)
    want = weight[:, 1] / weight.sum(axis=1)
    assert np.allclose(toxicity.marginals(field, emission, gaps), want[[1, 4]])


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 0, 0), (6, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.classify(empty, labels).count() == 0


def test_spans_are_code_points(spark):
    train = [(i, ("é bad fool day " if i % 2 else "é good kind day ") * 5) for i in range(60)]
    docs = spark.createDataFrame(train, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in train], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    spans = json.loads(got[1]["spans"])
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and {train[1][1][a:b] for a, b in spans} == {"bad", "fool"}
