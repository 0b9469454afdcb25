"""Quantiles by selection against sorting, with passes forced by small parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from semlode.operators import metrics


def plain(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a if at == math.floor(at) else a * (1 - at % 1) + b * (at % 1)


@pytest.mark.parametrize("parts,settled", [(4, 3), (1024, 4096)])
def test_groups_of_many_kinds(spark, parts, settled):
    rng = random.Random(5)
    groups = {
        "even": [rng.random() for _ in range(300)], "ties": [rng.choice([1.0, 2.0, 2.0, 2.0, 7.5]) for _ in range(200)], "one": [3.25], "two": [-1.0, 1.0], "same": [4.0] * 100,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(60)], "ends": [1.7e308, -1.7e308, 0.0, -0.0, 5e-324] * 5, None: [1.0, 2.0, 3.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("even", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {r["k"]: r for r in metrics.quantiles(df, "v", shares, "k", parts=parts, settled=settled).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values) and got[k]["max"] == max(values)
        assert got[k]["shares"] == pytest.approx([plain(values, s) for s in shares], rel=1e-12), k


def test_infinities_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(-inf,)] * 10 + [(float(i),) for i in range(50)] + [(inf,)] * 10 + [(nan,)] * 10
    got = metrics.quantiles(spark.createDataFrame(rows, "v double"), "v", [0.0, 0.5, 0.8, 1.0], parts=4, settled=2).first()
    assert got["n"] == 80 and got["shares"][:3] == [-inf, 29.5, inf] and math.isnan(got["shares"][3])


def test_no_values(spark):
    none = spark.createDataFrame([(None, True), (1.0, False)], "v double, ok boolean")
    assert metrics.percentiles(none, "v").collect() == []


def test_no_group_is_held(spark):
    """A large group with one hot value: what a pass gives on is a row a part, never a buffer of values."""
    x = np.concatenate([np.full(30_000, 7.0), np.random.default_rng(1).lognormal(size=60_000)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(8).withColumn("ok", F.lit(True))
    got = metrics.percentiles(df, "v").first()
    assert [got[c] for c in ("p50", "p95", "p99")] == pytest.approx(np.percentile(x, [50, 95, 99]).tolist(), rel=1e-12) and got["n"] == 90_000
