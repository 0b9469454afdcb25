"""The parity gate against counting all pairs."""

import random

from semlode.operators import parity


def test_inversions_and_gate(spark):
    rng = random.Random(3)
    rows = []
    for q in range(12):
        for _ in range(rng.randrange(1, 90)):
            rows.append((q, float(rng.randrange(40)), float(rng.randrange(40))))
    rows += [(20, float(i), i * 2.0 + 1) for i in range(33)] + [(21, 5.0, 5.0)] * 4 + [(22, 1.0, None), (23, 1.0, 2.0), (24, 1.0, 2.0), (24, 1.0, 3.0)]
    got = {r["q"]: r for r in parity.gate(spark.createDataFrame(rows, "q long, a double, b double"), "q").collect()}
    assert set(got) == {*range(12), 20, 21, 23, 24}
    for q, r in got.items():
        own = [(a, b) for k, a, b in rows if k == q]
        assert r["inversions"] == sum(x[0] < y[0] and x[1] > y[1] for x in own for y in own) and r["n"] == len(own)
    assert {q for q, r in got.items() if r["passed"]} == {20, 21, 23}


def test_empty(spark):
    assert parity.gate(spark.createDataFrame([], "q long, a double, b double"), "q").collect() == []
