"""Server-sent events as rows: writing frames, reading them back, folding them into one answer."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def frame(event: Column, data: Column) -> Column:
    """One frame; data is JSON text."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


#: Two readings of the same frames: `strict` leaves out blocks that begin as comments and trims values on both sides;
#: `browser` reads every line of every block, and trims values of data at the beginning only.
DIALECTS = ("strict", "browser")

#: What a browser trims (fixed).
_SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def frames(events: Column, dialect: str = "strict") -> Column:
    """array<struct<event, data>> of the whole frames in a buffer.

    Frames without data and, if strict, comments are left out; the event is `message` by default; several data
    lines are joined by line breaks.  What follows the last blank line is no frame yet (see tail).
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect: {dialect}")
    whole = F.slice(F.split(events, "\n\n"), 1, F.greatest(F.size(F.split(events, "\n\n")) - 1, F.lit(0)))
    trim = strip if dialect == "strict" else lambda c: F.regexp_replace(c, f"^[{_SPACE}]+|[{_SPACE}]+$", "")
    start = strip if dialect == "strict" else lambda c: F.regexp_replace(c, f"^[{_SPACE}]+", "")
    blocks = F.filter(F.transform(whole, strip), lambda b: (b != "") & ~b.startswith(":")) if dialect == "strict" else whole

    def one(block: Column) -> Column:
        lines = F.split(block, "\n")
        said = lambda key, cut: F.transform(F.filter(lines, lambda x: x.startswith(key)), lambda x: cut(F.substring(x, len(key) + 1, 1 << 30)))
        names, data = said("event:", trim), said("data:", start)
        return F.struct(F.coalesce(F.when(F.size(names) > 0, F.element_at(names, -1)), F.lit("message")).alias("event"), F.when(F.size(data) > 0, F.array_join(data, "\n")).alias("data"))

    return F.filter(F.transform(blocks, one), lambda f: f["data"].isNotNull())


def read_block(block: str, dialect: str = "strict") -> tuple[str, str] | None:
    """(event, data) of one frame without its blank line, as `frames` has them; None if it has no data."""
    trim, start = (str.strip, str.strip) if dialect == "strict" else (_cut(True), _cut(False))
    if dialect == "strict" and (block := block.strip()).startswith(":"):
        return None
    lines = block.split("\n")
    names, data = ([cut(x[len(key) :]) for x in lines if x.startswith(key)] for key, cut in (("event:", trim), ("data:", start)))
    return ((names or ["message"])[-1], "\n".join(data)) if data else None


def _cut(both: bool):
    one = f"[{_SPACE}]+"
    return lambda x: re.sub(rf"\A{one}" + (rf"|{one}\Z" if both else ""), "", x)


def tail(events: Column) -> Column:
    return F.element_at(F.split(events, "\n\n"), -1)


def parse(buffers: DataFrame, key: str = "id", text: str = "buffer", dialect: str = "strict") -> DataFrame:
    """(key, seq, event, data) of every frame."""
    return buffers.select(key, F.posexplode(frames(F.col(text), dialect)).alias("seq", "f")).select(key, "seq", "f.event", "f.data")


def collapse(events: DataFrame, key: str = "id") -> DataFrame:
    """One row an answer: the last event of each kind wins; a generation error keeps the ranked list."""
    last = lambda kind: F.max_by(F.when(F.col("event") == kind, F.col("data")), F.when(F.col("event") == kind, F.col("seq")))
    folded = events.groupBy(key).agg(last("ranked_list").alias("ranked_list"), last("llm_done").alias("llm_done"), last("llm_error").alias("llm_error"))
    message = F.coalesce(F.nullif(F.get_json_object("llm_error", "$.message"), F.lit("")), F.when(F.col("llm_error").isNotNull(), F.lit("Generation failed.")))
    return folded.select(key, "ranked_list", F.get_json_object("llm_done", "$.recommendations").alias("recommendations"), F.get_json_object("llm_done", "$.dropped").alias("dropped"), message.alias("error"))


def take_frames(buffer: str) -> tuple[str, list[tuple[str, dict]]]:
    """For a client that reads piece by piece: (what is left, the whole frames so far)."""
    *whole, rest = buffer.split("\n\n")
    out = []
    for block in (b.strip() for b in whole):
        fields: dict[str, list[str]] = {}
        for line in block.split("\n") if block and not block.startswith(":") else []:
            key, _, value = line.partition(":")
            fields.setdefault(key, []).append(value.strip())
        if "data" in fields:
            out.append((fields.get("event", ["message"])[-1], json.loads("\n".join(fields["data"]))))
    return rest, out


def write_frame(event: str, data) -> str:
    return f"event: {event}\ndata: {json.dumps(data, default=str)}\n\n"
