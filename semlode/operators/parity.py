"""Whether two models may stand for each other: two score tables of the same pairs, compared query by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

#: Fixed bound of the gate, besides the same order.
CORRELATION = 0.99


def inversions(scores: DataFrame, *by: str) -> DataFrame:
    """(by…, a, b) to by…, inversions: pairs that a and b put in opposite orders; ties are in no order.

    As in a merge sort: at each level the rows of a query are in runs by the high bits of their place by b, and
    pass in the order of a; a row of the lower half comes after as many of the upper half as it is inverted with.
    A level is one running sum, so the work is n log n and no query is held in memory.
    """
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy("b")) - 1
    placed = materialize(scores.where("a IS NOT NULL AND b IS NOT NULL").withColumn("place", place.cast("long")), "places")
    most = placed.agg(F.max("place")).first()[0] or 0
    levels = placed.select(*by, F.lit(0).cast("long").alias("n")).distinct()
    for bit in range(int(most).bit_length()):
        upper = F.shiftright("place", bit).bitwiseAND(F.lit(1))
        run = Window.partitionBy(*by, F.shiftright("place", bit + 1)).orderBy("a", "upper").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        level = placed.withColumn("upper", upper).withColumn("before", F.sum("upper").over(run))
        levels = levels.unionByName(level.where("upper = 0").groupBy(*by).agg(F.sum("before").alias("n")))
    out = materialize(levels.groupBy(*by).agg(F.sum("n").alias("inversions")), "inversions")
    discard(placed)
    return out


def gate(scores: DataFrame, *by: str) -> DataFrame:
    """(by…, a, b) to by…, n, correlation, inversions, passed: correlation of 0.99 at least (or none to speak of: one value) and the same order.

    Pairs that lack a score are not compared; by… are not null.
    """
    both = scores.where("a IS NOT NULL AND b IS NOT NULL")
    flat = (F.min("a") == F.max("a")) & (F.min("b") == F.max("b"))
    sums = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("correlation"), flat.alias("flat"))
    joined = sums.join(inversions(both, *by), list(by))
    return joined.select(*by, "n", "correlation", "inversions", ((F.col("inversions") == 0) & F.coalesce(F.col("flat") | (F.col("correlation") >= CORRELATION), F.lit(False))).alias("passed"))
