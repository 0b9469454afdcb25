"""The ranking algebra as column expressions; the time of reference is always given."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed constants of the blend.
POPULARITY_SCALE, DECAY_DAYS = 11.5, 180.0


def log_count(x: Column) -> Column:
    return F.when(x > 0, F.log1p(x.cast("double"))).otherwise(F.lit(0.0))


def popularity(stars: Column, downloads: Column, dependents: Column, sourcerank: Column) -> Column:
    """Between 0 and 1.  Known downloads, even 0, come before dependents; 0 counts as no dependents and no rank."""
    base = log_count(stars)
    mixed = F.when(downloads.isNotNull(), 0.5 * base + 0.5 * log_count(downloads)).when(F.coalesce(dependents, F.lit(0)) != 0, 0.6 * base + 0.4 * log_count(dependents)).otherwise(base)
    ranked = F.when(F.coalesce(sourcerank, F.lit(0)) != 0, 0.85 * mixed + 0.15 * log_count(sourcerank)).otherwise(mixed)
    return F.least(ranked / POPULARITY_SCALE, F.lit(1.0))


def recency(when: Column, as_of: Column) -> Column:
    """exp(-age in days / 180); 0 without a time, 1 for the future."""
    days = F.greatest((F.unix_micros(as_of) - F.unix_micros(when)) / 86_400_000_000.0, F.lit(0.0))
    return F.when(when.isNull(), F.lit(0.0)).otherwise(F.exp(-days / DECAY_DAYS))


def blend(relevance: Column, popular: Column, recent: Column, alpha: float = 0.75, beta: float = 0.15, delta: float = 0.10) -> Column:
    return alpha * relevance + beta * popular + delta * recent


def min_max(score: Column, *by: Column | str) -> Column:
    """A score within its group scaled to 0..1; 1 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(1.0))
