"""Event streams that arrive in pieces: frames are read as they become whole, and silence is an error.

The state of a stream is in Spark's checkpoint: the bytes after the last whole frame, the number of the next
piece, and pieces that came before their turn.  So a frame, or a character in it, may be cut anywhere, between
pieces, micro-batches and runs, and any cutting of the same bytes gives the same rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import hadoop_fs
from ..sources.sse import DIALECTS, read_block

#: After these a stream is at its end.
LAST = ("llm_done", "llm_error")
STATE = "tail binary, next long, given long, seqs array<long>, pieces array<binary>, ended boolean"
#: How long the state of a stream that has ended is kept, so that what still comes is known to be late.
FORGET_MS = 600_000


def follow(pieces: DataFrame, *, dialect: str = "strict", silent_ms: int | None = None, forget_ms: int = FORGET_MS) -> DataFrame:
    """A stream of (id, seq, piece binary) to (id, n, event, data): every frame once, n from 0 within its stream.

    seq numbers the pieces of a stream from 0; those that come again are passed over, those that come early wait.
    With silent_ms, a stream without a piece for that time of the clock ends with an llm_error, and what comes
    after is passed over (such a run has batches without data, and so never ends by itself), as is what comes after an llm_done or llm_error of the stream itself.  Null ids, seqs
    and pieces are no pieces.  Bytes that are not UTF-8 become U+FFFD.  State is one row an open stream.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect: {dialect}")
    key = pieces.schema["id"]
    out = T.StructType([T.StructField("id", key.dataType), T.StructField("n", T.LongType()), T.StructField("event", T.StringType()), T.StructField("data", T.StringType())])

    def step(name: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        tail, turn, given, seqs, waiting, ended = state.get if state.exists else (b"", 0, 0, [], [], False)
        early, rows = dict(zip(seqs, map(bytes, waiting))), []
        if state.hasTimedOut:
            if ended:
                state.remove()
                return
            rows, ended = [("llm_error", json.dumps({"message": f"no answer within {silent_ms / 1000:.0f} s"}))], True
        else:
            for batch in batches:
                early |= {int(s): bytes(p) for s, p in zip(batch["seq"], batch["piece"]) if s >= turn}
            while turn in early and not ended:
                *whole, tail = (bytes(tail) + early.pop(turn)).split(b"\n\n")
                turn += 1
                for frame in (read_block(w.decode(errors="replace"), dialect) for w in whole):
                    if frame and not ended:
                        rows.append(frame)
                        ended = frame[0] in LAST
        if ended:
            tail, early = b"", {}
        state.update((bytes(tail), turn, given + len(rows), list(early), list(early.values()), ended))
        if silent_ms is not None:
            state.setTimeoutDuration(forget_ms if ended else silent_ms)
        if rows:
            yield pd.DataFrame({"id": [name[0]] * len(rows), "n": range(given, given + len(rows)), "event": [r[0] for r in rows], "data": [r[1] for r in rows]})

    timer = GroupStateTimeout.NoTimeout if silent_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    whole = pieces.where("id IS NOT NULL AND seq IS NOT NULL AND piece IS NOT NULL").select("id", "seq", "piece")
    return whole.groupBy("id").applyInPandasWithState(step, out, STATE, "append", timer)


def ended(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, *, dialect: str = "strict", silent_ms: int, every_ms: int = 200, files_per_batch: int = 1, wait_s: float = 600) -> DataFrame:
    """Follow what is in a directory of pieces until each of its streams has ended, by itself or by silence; the events.

    Batches are written by their number, so one that is repeated replaces itself.  A run that is begun again on
    the same checkpoint goes on.
    """
    put = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    run = follow(source, dialect=dialect, silent_ms=silent_ms).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint)
    streams = spark.read.schema(schema).parquet(path).where("id IS NOT NULL AND seq IS NOT NULL AND piece IS NOT NULL").select("id").distinct().count()
    events = T.StructType([T.StructField("id", schema["id"].dataType), *[T.StructField(c, k) for c, k in (("n", T.LongType()), ("event", T.StringType()), ("data", T.StringType()))]])
    query, limit = run.trigger(processingTime=f"{every_ms} milliseconds").start(), time.monotonic() + wait_s
    try:
        done = 0
        while done < streams:
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > limit:
                raise TimeoutError(f"{done} of {streams} streams have ended")
            time.sleep(every_ms / 1000)
            _, where, fs = hadoop_fs(spark, out)
            done = spark.read.schema(events).parquet(out).where(F.col("event").isin(*LAST)).count() if fs.exists(where) else 0
    finally:
        query.stop()
    return spark.read.schema(events).parquet(out).select("id", "n", "event", "data")
