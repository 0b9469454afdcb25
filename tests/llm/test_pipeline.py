"""The pipeline by its stages, each on what the one before kept, and on odd and empty tables."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from semlode.llm import mixing, quality, tokens
from test_decontaminate import brute as contaminated
from test_near_duplicates import kept as first_of_groups
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark, small):
    docs, held = small, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        held.append((docs, docs.collect()))
    good, distinct, clean, mixed, written = (h[1] for h in held)
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(good) == sorted(r["doc_id"] for r in quality.classify(small, labels).where("score >= 0.5").collect()) and len(good) < small.count()
    pairs = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    assert ids(distinct) == sorted(first_of_groups(pairs(good))) and len(distinct) < len(good)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(clean) == sorted(r[0] for r in contaminated(pairs(distinct), items) if not r[5]) and len(clean) < len(distinct)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(held[2][0]).collect() if r["copies"]}
    assert Counter(ids(mixed)) == copies and max(copies.values()) == 2
    library, start, text = Tokenizer.from_file(tokens.default_tokenizer()), 0, dict(pairs(mixed))
    for r in sorted(written, key=lambda r: r["start"]):
        found = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [tokens.END_ID]
        assert tuple(r) == (r["doc_id"], start, len(found), zlib.crc32(np.array(found, dtype="<u4").tobytes()))
        start += len(found)
    assert ids(written) == ids(mixed)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, written))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_columns_of_odd_and_empty_tables(spark, odd, empty, name, stage):
    docs = odd.withColumns({"__score": F.lit("x"), "mix_id": F.lit(1), "group_key": F.lit(2), "a.b": F.lit(3)})
    out = stage(spark, docs, SF)
    assert out.dtypes == docs.dtypes and out.count() <= 2 * docs.count()
    assert {(r["__score"], r["mix_id"], r["group_key"], r["a.b"]) for r in out.collect()} <= {("x", 1, 2, 3)}
    assert stage(spark, empty, SF).count() == 0


def test_last_stage_on_odd_and_empty_tables(spark, odd, empty):
    assert corpus_pipeline.token_stage(spark, odd, SF).count() == odd.count() and corpus_pipeline.token_stage(spark, empty, SF).count() == 0
