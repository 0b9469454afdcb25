"""Mixing sources to target weights (operator 1), with DataFrame functions only.

The word budget is shared by weight.  A source whose share is above `max_epochs` times its size is
clamped there and the excess is shared again by weight, until no share is above its cap (capped water
filling).  A source is then repeated: every document floor(target / size) times, and seeded whole
documents once more for the rest.

Defined cases: a null or empty text has size 0 and is never short of its share (taken 0); null sources
form one source, ordered last; of rows that repeat (same id, text and source) as many get a further copy as
their group's cut says, and which of them is all the same; a null id is an id like another; of a very long
text every word counts; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import columns_of, join_heavy, materialize, prefix_for, ranked

#: Fixed pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, budget: float, epochs: float) -> float:
    """The level at which sum(least(weight * level, cap)) is the budget; inf where the caps are below it.

    Each round is one aggregate over one row a source; two numbers come to the driver.
    """
    cap, level = F.col("source_size") * F.lit(epochs), 0.0
    held = -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count(F.when(over, 1)).alias("clamped"),
        ).first()
        if row["clamped"] == held or not row["free"]:
            return math.inf if not row["free"] else level
        held, level = row["clamped"], max(0.0, (budget - row["fixed"]) / row["free"])


def tie(seed: int) -> Column:
    """A seeded number of 60 bits from id and text, the same in every run."""
    known = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(known), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> tuple[DataFrame, int]:
    """One row a source: source, key, n_docs, source_size, weight, target; and the number of sources."""
    grouped = sized.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size"))
    placed = ranked(grouped, F.col("source").asc_nulls_last(), "mix-order")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialize(placed.withColumn("weight", weight).drop("place"), "mix-sources")
    row = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("total")).first()
    level = water_level(sources, share * row["total"], epochs)
    cap = F.col("source_size") * F.lit(float(epochs))
    return sources.withColumn("target", cap if math.isinf(level) else F.least(F.col("weight") * F.lit(level), cap)), row["n"]


def decide(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, group_rows: int = 256) -> DataFrame:
    """docs (doc_id, text, source) to one row a distinct row: doc_id, source, tie, size, source_size, target, n_rows, base, extra.

    Of its n_rows rows, `extra` are taken base + 1 times and the others base times.  A source of any size is
    split by the seeded hash `tie` into groups of about group_rows documents.  In each group documents are
    taken in the order of `tie` up to the fractional part of the rate; the cut is at the middle of a
    document, so the errors of groups cancel out.  Windows see only short rows and no group grows with its
    source; rows that repeat are one row with a count.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sized = materialize(docs.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"), tie(seed).alias("tie")), "mix-sized")
    sources, n = source_targets(sized, weights, share, max_epochs)
    plan = sources.select("key", "n_docs", "source_size", "target")
    distinct = sized.groupBy("doc_id", "source", "key", "tie", "size").agg(F.count(F.lit(1)).alias("n_rows"))
    # Sources are few as a rule; beyond that, only those with many documents are broadcast.
    joined = distinct.join(F.broadcast(plan), "key") if n <= 100_000 else join_heavy(materialize(distinct, "mix-distinct"), plan, "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.pmod(F.shiftright("tie", 20), F.ceil(F.col("n_docs") / group_rows))
    joined = joined.withColumns({"rate": rate, "part": part, "words": F.col("n_rows") * F.col("size")}).drop("n_docs")
    group = Window.partitionBy("key", "part")
    before = F.coalesce(F.sum("words").over(group.orderBy("tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (F.col("rate") - F.floor("rate")) * F.sum("words").over(group)
    fits = F.floor((cut - before) / F.col("size") + 0.5)
    extra = F.when((F.col("rate") > F.floor("rate")) & (F.col("size") > 0), F.least(F.col("n_rows"), F.greatest(fits, F.lit(0)))).otherwise(0)
    decided = joined.select("doc_id", "source", "tie", "size", "source_size", "target", "n_rows", F.floor("rate").cast("long").alias("base"), extra.cast("long").alias("extra"))
    return materialize(decided, "mix-decided")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source) to a row each: doc_id, source, tie, size, source_size, target, copies, taken."""
    some = F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("extra").alias("many")), F.struct(F.col("base").alias("copies"), (F.col("n_rows") - F.col("extra")).alias("many")))
    each = decide(docs, **options).withColumn("some", F.explode(F.filter(some, lambda x: x["many"] > 0))).select("doc_id", "source", "tie", "size", "source_size", "target", "some.*")
    # A row that repeats very often is spelt out in blocks.
    size = 1 << 16
    blocks = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / size))))
    each = blocks.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(size), F.col("many") - F.col("block") * size))))
    return each.select("doc_id", "source", "tie", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, every one as often as the mix takes it, with the columns of docs."""
    p, seed = prefix_for(docs, "mix"), options.get("seed", 17)
    key = [f"{p}_id", f"{p}_source", f"{p}_tie"]
    decided = decide(docs, **options).select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "source", "tie"), key)], "n_rows", "base", "extra")
    decided = decided.withColumnsRenamed({c: f"{p}_{c}" for c in ("n_rows", "base", "extra")})
    n_rows, base, extra = (F.col(f"{p}_{c}") for c in ("n_rows", "base", "extra"))
    on = F.col("doc_id").eqNullSafe(F.col(key[0])) & F.col("source").eqNullSafe(F.col(key[1])) & (tie(seed) == F.col(key[2]))
    copies = F.col(f"{p}_copies")
    spelt = lambda df: df.where(copies > 0).withColumn(f"{p}_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*columns_of(docs))
    alike = decided.where((extra == 0) | (extra == n_rows)).withColumn(f"{p}_copies", base + F.when(extra > 0, 1).otherwise(0)).where(copies > 0)
    out = spelt(docs.join(alike, on))
    divided = decided.where((extra > 0) & (extra < n_rows))
    if divided.isEmpty():
        return out
    # Rows that repeat and are not taken alike are numbered: within the partitions of a written table, then by those before.
    some = materialize(docs.join(divided, on).withColumn(f"{p}_uid", F.monotonically_increasing_id()).withColumn(f"{p}_part", F.shiftright(f"{p}_uid", 33)), "mix-divided")
    counts = some.groupBy(*key, f"{p}_part").agg(F.count(F.lit(1)).alias(f"{p}_n"))
    first = F.coalesce(F.sum(f"{p}_n").over(Window.partitionBy(*key).orderBy(f"{p}_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"{k}2") for k in key], F.col(f"{p}_part").alias(f"{p}_part2"), first.alias(f"{p}_first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in (*key, f"{p}_part")])
    number = F.row_number().over(Window.partitionBy(*key, f"{p}_part").orderBy(f"{p}_uid")) + F.col(f"{p}_first")
    return out.unionByName(spelt(some.join(counts, same).withColumn(f"{p}_copies", base + F.when(number <= extra, 1).otherwise(0))))


#: Weights (3, 1, 2), 150 % and two epochs in DuckDB's SQL.  Sources whose level is above their cap come first in the order of cap / weight.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS tie FROM documents),
s AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, n_docs, source_size, coalesce(least(weight * (SELECT max(level) FILTER (level <= ratio) FROM l), cap), cap) AS target FROM l),
g AS (SELECT doc_id, source, size, tie, count(*) AS n_rows FROM d GROUP BY ALL),
p AS (SELECT g.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, (tie >> 20) % CAST(ceil(n_docs / 256.0) AS BIGINT) AS part
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (rate - floor(rate)) * sum(n_rows * size) OVER (PARTITION BY source, part) AS cut,
    coalesce(sum(n_rows * size) OVER (PARTITION BY source, part ORDER BY tie, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
e AS (SELECT *, CASE WHEN rate > floor(rate) AND size > 0 THEN least(n_rows, greatest(floor((cut - before) / size + 0.5), 0)) ELSE 0 END AS extra FROM c)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST((floor(rate) + CASE WHEN i < extra THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM (SELECT *, unnest(range(n_rows)) AS i FROM e)"""
