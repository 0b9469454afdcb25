import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from semlode.llm import tokens
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


def test_query(small, rows, library):
    got = sorted(map(tuple, tokens.encode_and_read(small).collect()))
    start = 0
    for (i, text, _), r in zip(sorted(rows), got, strict=True):
        ids = ids_of(library, text)
        assert r == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_odd_rows(odd, empty, library):
    got = tokens.encode_and_read(odd).collect()
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] is not None, r["text"]))
    start, want = 0, []
    for r in rows:
        ids = ids_of(library, r["text"])
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.encode_and_read(empty).count() == 0


def test_small_shards_and_keyed_access(spark, small, rows, library):
    manifest = tokens.write(small, tokens.default_tokenizer(), partitions=3, shard_ids=20_000)
    assert manifest.count() > 20
    assert tokens.read(manifest).count() == len(rows)
    keys = spark.createDataFrame([(5,), (77,), (999,), (5000,)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in tokens.lookup(manifest, keys).collect()}
    assert got == {i: ids_of(library, rows[i][1]) for i in (5, 77, 999)}


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_tokenizer(), most=50)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab 'st\n\t\r.!1é日  <|endofx>"), max_size=40))
def test_pieces_are_what_the_library_gives(encoder, text):
    got = np.frombuffer(encoder.encode(text), dtype="<u2").tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_token(encoder):
    text = "a <|endoftext|> b"
    assert np.frombuffer(encoder.encode(text), dtype="<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), max_size=300))
def test_perfect_hash(keys):
    values = np.array(sorted(keys), dtype=np.int64)
    table = tokens.PerfectHash.build(values)
    assert sorted(table.find(values).tolist()) == list(range(len(values)))


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("a \n\xa0　,"), max_size=20), max_size=6))
def test_white_space_of_all_kinds_around_spaces(encoder, texts):
    texts = [*texts, "a\n \xa0 \xa0", " \xa0 \xa0 ", "a\xa0 \xa0 a"]
    got = [np.frombuffer(b, dtype="<u2").tolist() for b in encoder.encode_many(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_lookup_reads_little_and_takes_any_keys(spark, small, rows, library, monkeypatch):
    docs = small.where("doc_id < 40 OR doc_id = 999").unionByName(small.where("doc_id = 7").withColumn("text", F.lit("zz"))).unionByName(small.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    manifest = tokens.write(docs, tokens.default_tokenizer(), partitions=4, shard_ids=2_000)
    monkeypatch.setattr(tokens, "Shard", None)
    asked = [(i,) for i in [*range(45), 7, 7, 999, 1000, -1, None]]
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.lookup(manifest, spark.createDataFrame(asked, "doc_id long").repartition(3)).collect())
    first = min(rows[7][1], "zz")
    assert got == sorted((i, ids_of(library, first if i == 7 else rows[i][1])) for i in [*range(40), 7, 7, 999])
    assert "Join" not in tokens.lookup(manifest, spark.createDataFrame(asked, "doc_id long"))._jdf.queryExecution().toString()
    assert tokens.lookup(manifest.limit(0), spark.createDataFrame(asked, "doc_id long")).count() == 0


def test_pieces_whose_cuts_are_elsewhere(encoder, monkeypatch):
    monkeypatch.setattr(encoder, "spaced", np.zeros_like(encoder.spaced))
    text = "some never seen wordsqq here zzqx"
    assert np.frombuffer(encoder.encode(text), dtype="<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_documents_without_ids_are_in_many_ranges(spark, library):
    """Half of all rows have no id: their ranges are about as large as those of the others, and in the order of texts."""
    texts = [f"{'x' * (i % 5)} word {i} é" for i in range(400)]
    docs = spark.createDataFrame([(i if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    manifest = tokens.write(docs, tokens.default_tokenizer(), partitions=8)
    most = max(r["docs"] for r in manifest.groupBy("part").agg(F.sum("docs").alias("docs")).collect())
    assert most < 150 and manifest.where("first_id IS NULL").select("part").distinct().count() >= 3
    want = sorted(((i if i % 2 else None, t) for i, t in enumerate(texts)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = tokens.read(manifest).orderBy("start").collect()
    start = 0
    for r, (key, text) in zip(got, want, strict=True):
        ids = ids_of(library, text)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
