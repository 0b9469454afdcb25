import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from semlode.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == 10_000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i in truth if got[i]["held_out"]]
    right = np.mean([got[i]["predicted"] == truth[i] for i in held])
    base = np.mean([truth[i] for i in held])
    assert right > 0.97 > base
    good = np.array([got[i]["score"] for i in held if truth[i] == 1])
    bad = np.array([got[i]["score"] for i in held if truth[i] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.95


def test_compiled_rules_match_numpy(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(small, labels)
    assert 0 < len(model.rules) < 400
    rows = quality.with_statistics(small, ["doc_id"]).withColumn("score", quality.score_column(model)).select("score", "stats.*").toPandas()
    x = rows[quality.STATS].to_numpy(float)
    total = model.bias + sum(w * quality._holds(x, r) for r, w in zip(model.rules, model.weights))
    assert np.allclose(1 / (1 + np.exp(-total)), rows["score"])


def test_odd_rows(spark, small, odd, empty):
    labels = spark.createDataFrame([(1, 1, None), (8, 0, 1), (None, 0, 0), (6, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int").withColumn("y", F.lit(1))
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert quality.classify(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.classify(empty, labels).count() == 0
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_rules_as_one_compiled_expression(spark):
    """Hundreds of rules give the sum of their weights, in code that compiles (no fallback to interpretation)."""
    rng = np.random.default_rng(8)
    k = len(quality.STATS)
    x = rng.random((50, k)).round(3)
    rules = {}
    for _ in range(120):
        path = tuple((int(rng.integers(k)), bool(rng.integers(2)), round(float(rng.random()), 3)) for _ in range(3))
        other = (*path[:1], (path[1][0], not path[1][1], path[1][2]))
        rules |= dict.fromkeys([path[:1], path[:2], path, other])
    model = quality.Ensemble(list(rules), rng.normal(0, 0.1, len(rules)).tolist(), 0.3)
    on = np.stack([quality._holds(x, r) for r in model.rules], axis=1)
    want = 1 / (1 + np.exp(-(on @ np.array(model.weights) + model.bias)))
    fields = ", ".join(f"{s}: double" for s in quality.STATS)
    df = spark.createDataFrame([(i, tuple(map(float, row))) for i, row in enumerate(x)], f"i int, stats struct<{fields}>")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = {r["i"]: r["score"] for r in df.repartition(2).withColumn("score", quality.score_column(model)).where("score >= 0").collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert np.allclose([got[i] for i in range(len(x))], want)


def plain_statistics(text):
    """The statistics of one text, character by character."""
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", low)]
    n, letters = len(words), [b for b in raw if b >= 0x80 or chr(b).isalpha()]
    count = lambda chars: sum(chr(b) in chars for b in raw if b < 0x80)
    share = lambda k, m: k / max(m, 1)
    tokens = [low[a:b] for a, b in words]
    lines = {}
    for a, b in words:
        lines.setdefault(low[:a].count(b"\n"), []).append(low[a:b])
    said = [tuple(v) for v in lines.values()]
    pairs = list(zip(tokens, tokens[1:]))
    out = [n, len(raw), share(sum(map(len, tokens)), n), share(sum(65 <= b <= 90 for b in raw), len(letters)), share(count("#$%&*@^~=+<>{}[]\\_/"), len(raw)), share(count("0123456789"), len(raw)), share(count("!"), n), share(count("|"), n), share(count(".?"), n)]
    out += [share(len(set(tokens)), n), share(sum(len(t) <= 3 for t in tokens), n), share(sum(len(t) >= 20 for t in tokens), n), share(sum(not any(b >= 0x80 or chr(b).isalpha() for b in t) for t in tokens), n), n / max(len(said), 1)]
    # Lines are told apart by the sum of their words, so an order of words is not seen.
    out += [1 - share(len({tuple(sorted(s)) for s in said}), len(said)), share(sum(b >= 0x80 for b in raw), len(raw)), 1 - share(len(set(pairs)), len(pairs))]
    return [round(v, 9) if n or k < 9 else 0 for k, v in enumerate(out)]


def test_statistics_against_plain_reading(spark, odd):
    texts = [r["text"] for r in odd.where("doc_id IS NULL OR doc_id <> 5").collect()] + ["A b\nA b\n\nb A\n", "1 2 || !!! ... é", "x\n" * 40, "a a a a b", "Ünï CODE #1 $2 " + "long" * 9]
    got = quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    for r in got:
        assert np.allclose(list(r["stats"]), plain_statistics(texts[r["doc_id"]]), atol=2e-9), (texts[r["doc_id"]], dict(zip(quality.STATS, r["stats"])), plain_statistics(texts[r["doc_id"]]))


def test_columns_stay_as_they_are(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = small.withColumns({"stats": F.lit("mine"), "__score": F.lit("too"), "Stats_": F.lit(1), "a.b": F.lit(2)})
    kept = quality.keep_good(docs, labels)
    assert kept.dtypes == docs.dtypes
    good = {r["doc_id"] for r in quality.classify(small, labels).where("score >= 0.5").collect()}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == good and {(r["stats"], r["__score"], r["Stats_"], r["a.b"]) for r in rows} == {("mine", "too", 1, 2)}


def test_repeated_ids_and_labels(spark):
    docs = spark.createDataFrame([(i % 30, f"text {i} " * (i + 1)) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 2, "doc_id long, quality int")
    a, b = quality.train(docs, labels, max_rows=20), quality.train(docs.repartition(7), labels.repartition(5), max_rows=20)
    assert a == b
