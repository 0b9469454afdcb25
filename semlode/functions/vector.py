"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def cls_pool(hidden: Column) -> Column:
    """The first token's vector, at unit length."""
    return l2_normalize(F.element_at(hidden, 1))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """The mean of the tokens under the mask, at unit length."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    zero = F.transform(F.element_at(hidden, 1), lambda x: x.cast("double") * 0)
    weighed = F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x.cast("double") * m))
    summed = F.aggregate(weighed, zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y))
    return l2_normalize(F.transform(summed, lambda x: x / total))


def pool(hidden: Column, mask: Column, pooling: str) -> Column:
    if pooling not in ("cls", "mean"):
        raise ValueError(f"pooling: {pooling}")
    return cls_pool(hidden) if pooling == "cls" else mean_pool(hidden, mask)


def logits_score(logits: Column) -> Column:
    """One logit as it is; of two, the probability of the second; null for others."""
    first, second = F.try_element_at(logits, F.lit(1)).cast("double"), F.try_element_at(logits, F.lit(2)).cast("double")
    top = F.greatest(first, second)
    return F.when(F.size(logits) == 1, first).when(F.size(logits) == 2, F.exp(second - top) / (F.exp(first - top) + F.exp(second - top)))
