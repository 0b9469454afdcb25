"""Latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

#: Parts that a pass cuts a range of values into; rows of a range that are put in order at once.
PARTS, SETTLED = 1024, 4096


def ranked_values(values: DataFrame, ranks: DataFrame, parts: int = PARTS, settled: int = SETTLED) -> DataFrame:
    """Exact selection: values (g, v), ranks (g, rank from 0 below the number of rows of g), to (g, rank, value).

    Every pass counts the values of the range around each rank in `parts` parts and goes on with the part that
    has the rank, until that has one value or `settled` rows at most, which are put in order.  A group is never
    held: what passes on is a short row a part.  NaN counts as the largest value, nulls are not values.
    """
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    ends = [F.min("v").alias("low"), F.max("v").alias("high"), F.min(finite(F.col("v"))).alias("first"), F.max(finite(F.col("v"))).alias("last"), F.count(F.lit(1)).alias("rows")]
    state = materialize(ranks.join(values.groupBy("g").agg(*ends), "g").withColumn("before", F.lit(0).cast("long")), "ranks")
    open_ = F.expr(f"rows > {settled} AND low <> high")
    while not state.where(open_).isEmpty():
        ranges = state.where(open_).select("g", "low", "high", "first", "last").distinct()
        width, halved = F.col("last") - F.col("first"), lambda c: F.col(c) / 2
        # Halves where the width of a range is beyond what a double can hold.
        share = F.when(width == float("inf"), F.try_divide(halved("v") - halved("first"), halved("last") - halved("first"))).otherwise(F.try_divide(F.col("v") - F.col("first"), width))
        part = F.when(F.isnan("v"), parts + 2).when(F.col("v") == float("inf"), parts + 1).when(F.col("v") == float("-inf"), -1).when(F.col("first") == F.col("last"), 0).otherwise(F.floor(share * parts))
        inside = values.join(ranges, "g").where(F.col("v").between(F.col("low"), F.col("high"))).withColumn("part", part)
        counted = inside.groupBy("g", F.col("low").alias("of_low"), F.col("high").alias("of_high"), "part").agg(*ends)
        # At most parts + 4 short rows a range.
        upto = Window.partitionBy("g", "of_low", "of_high").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("earlier", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
        went = state.where(open_).select("g", "rank", "before", F.col("low").alias("of_low"), F.col("high").alias("of_high")).join(counted, ["g", "of_low", "of_high"])
        at = F.col("rank") - F.col("before")
        went = went.where((at >= F.col("earlier")) & (at < F.col("earlier") + F.col("rows"))).withColumn("before", F.col("before") + F.col("earlier"))
        last, state = state, materialize(state.where(~open_).unionByName(went.select(state.columns)), "ranks")
        discard(last)
    ranges = state.where("low <> high").select("g", "low", "high").distinct()
    few = values.join(ranges, "g").where(F.col("v").between(F.col("low"), F.col("high")))
    order = few.withColumn("nth", F.row_number().over(Window.partitionBy("g", "low", "high").orderBy("v")) - 1)
    found = state.where("low <> high").join(order, ["g", "low", "high"]).where(F.col("nth") == F.col("rank") - F.col("before")).select("g", "rank", F.col("v").alias("value"))
    return found.unionByName(state.where("low = high").select("g", "rank", F.col("low").alias("value")))


def quantiles(df: DataFrame, value: str | Column, shares: list[float], *by: str, parts: int = PARTS, settled: int = SETTLED) -> DataFrame:
    """(by…, n, max, shares array<double>): exact quantiles by linear interpolation, of the values that are not null.

    Without `by` there is one group, and no row if there are no values.  Names of `by` may be any.
    """
    value = F.col(value) if isinstance(value, str) else value
    group = F.struct(F.lit(0).alias("all"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])
    # -0.0 and 0.0 are one value.
    values = materialize(df.where(value.isNotNull()).select(group.alias("g"), (value.cast("double") + F.lit(0.0)).alias("v")), "values")
    sizes = materialize(values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max")), "sizes")
    places = sizes.select("g", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"), "n").withColumn("at", F.col("share") * (F.col("n") - 1))
    places = places.select("g", "share", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"))
    picked = materialize(ranked_values(values, places.select("g", "rank").distinct(), parts, settled), "picked")
    ends = places.join(picked, ["g", "rank"]).groupBy("g", "share", "at").agg(F.min_by("value", "rank").alias("a"), F.max_by("value", "rank").alias("b"))
    rest = F.col("at") - F.floor("at")
    done = ends.select("g", "share", F.when(rest == 0, F.col("a")).otherwise(F.col("a") * (1 - rest) + F.col("b") * rest).alias("value"))
    map_of = done.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("share", "value"))).alias("m"))
    out = sizes.join(map_of, "g").select(*[F.col(f"g.k{i}").alias(c) for i, c in enumerate(by)], "n", "max", F.array(*[F.col("m")[F.lit(s)] for s in shares]).alias("shares"))
    out = materialize(out, "quantiles")
    discard(values, sizes, picked)
    return out


def percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, p50, p95, p99 (linear interpolation) and max of the rows that are ok and have the value."""
    found = quantiles(df.where("ok"), value, [0.5, 0.95, 0.99], *by)
    return found.select(*by, "n", *[F.col("shares")[i].alias(c) for i, c in enumerate(("p50", "p95", "p99"))], "max")


def success(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("total"))


def summary_line(label: str, row: dict) -> str:
    if not row.get("n"):
        return f"{label:16}  n=0"
    return f"{label:16}  n={row['n']:<3}  " + "  ".join(f"{k}={row[k]:7.1f}" for k in ("p50", "p95", "p99", "max")) + "  ms"
