"""Event streams in pieces: any cutting gives the same rows, in both dialects; silence, restarts and late pieces."""

import random
import time

import pytest
from pyspark.sql import functions as F
from semlode.sources import sse
from semlode.streaming import answers

TEXT = (
    "\n: only a comment\n\nevent: llm_delta\ndata: {\"text\": \"é🎉\"}\n\n: hidden if strict\ndata:   x \n\ndata: a\ndata:b\nevent:  odd \n\n\n\n\nid: 4\nevent: none\n\nevent: llm_delta\r\ndata: ﻿1\x1c\n\ndata:\n\nevent: llm_done\ndata: 2\n\nevent: late\ndata: 3\n\n"
)
WANT = {
    "strict": [("llm_delta", '{"text": "é🎉"}'), ("odd", "a\nb"), ("llm_delta", "﻿1"), ("message", ""), ("llm_done", "2")],
    "browser": [("llm_delta", '{"text": "é🎉"}'), ("message", "x "), ("odd", "a\nb"), ("llm_delta", "1\x1c"), ("message", ""), ("llm_done", "2")],
}


@pytest.mark.parametrize("dialect", sse.DIALECTS)
def test_columns_and_blocks_agree(spark, dialect):
    df = spark.createDataFrame([(1, TEXT + "data: no end")], "id long, buffer string")
    got = [(r["event"], r["data"]) for r in sse.parse(df, dialect=dialect).orderBy("seq").collect()]
    assert got == [*WANT[dialect], ("late", "3")]
    assert got == [b for b in (sse.read_block(x, dialect) for x in TEXT.split("\n\n")[:-1]) if b]


def cut(rng, data):
    at = sorted(rng.sample(range(1, len(data)), rng.randrange(0, 12)))
    return [data[a:b] for a, b in zip([0, *at], [*at, len(data)])]


@pytest.mark.parametrize("dialect", sse.DIALECTS)
def test_any_cutting_gives_the_same_rows(spark, tmp_path, dialect):
    rng = random.Random(dialect)
    rows = []
    for i in range(40):
        parts = list(enumerate(cut(rng, TEXT.encode())))
        rows += [(i, s, p) for s, p in parts] + [(i, s, p) for s, p in parts if rng.random() < 0.2]
    rows += [(None, 0, b"data: 1\n\n"), (41, None, b"data: 1\n\n"), (42, 0, None)]
    rng.shuffle(rows)
    schema = "id long, seq long, piece binary"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    answers.follow(source, dialect=dialect).writeStream.foreachBatch(out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("id", "n").collect():
        got.setdefault(r["id"], []).append((r["n"], r["event"], r["data"]))
    assert set(got) == set(range(40)) and all(v == [(n, *e) for n, e in enumerate(WANT[dialect])] for v in got.values())


def test_silence_restart_and_late_pieces(spark, tmp_path):
    """A stream that falls silent ends by the clock, also when the run was begun again; what comes later is passed over."""
    schema = spark.createDataFrame([], "id string, seq long, piece binary").schema
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([("whole", 0, b"data: 1\n\neve"), ("silent", 0, b"event: llm_delta\ndata: 1\n\nevent: llm_d")])
    first = answers.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), silent_ms=60_000)
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    run = first.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").start()
    until = time.monotonic() + 60
    while not run.recentProgress and time.monotonic() < until:
        time.sleep(0.2)
    run.stop()
    put([("whole", 1, b"nt: llm_done\ndata: 2\n\n"), ("silent", 2, b"never read")])
    got = answers.ended(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/c", silent_ms=1_000, wait_s=60)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [("silent", 0, "llm_delta", "1"), ("silent", 1, "llm_error", '{"message": "no answer within 1 s"}'), ("whole", 0, "message", "1"), ("whole", 1, "llm_done", "2")]
    put([("silent", 1, b"one\ndata: 9\n\n")])
    again = answers.ended(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/c", silent_ms=1_000, wait_s=60)
    assert sorted(tuple(r) for r in again.collect()) == rows


def test_unknown_dialect(spark):
    with pytest.raises(ValueError):
        answers.follow(spark.createDataFrame([], "id long, seq long, piece binary"), dialect="other")
    with pytest.raises(ValueError):
        sse.frames(F.lit(""), "other")
