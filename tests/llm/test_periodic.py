"""op13 against brute force: every period of every stretch."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from semlode.llm import periodic


def plain_runs(words, least=6, exponent=4):
    """Maximal stretches for each period, without those that have a smaller one."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, exponent * q):
                part = words[s:e]
                if not any(all(part[k] == part[k + r] for k in range(len(part) - r)) for r in range(1, q)):
                    out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    got = plain_runs(words)
    gone = {i for s, length, q in got for i in range(s + q, s + length)}
    best = max(got, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(got), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in got)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def check(spark, docs):
    want = sorted((plain(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)
    got = periodic.query(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert all(t == "bigint" for c, t in got.dtypes if "sha" not in c)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    return want


def test_documents(spark, small):
    short = small.where("length(text) < 12000")
    want = check(spark, short)
    assert sum(w[1] > 0 for w in want) > 50 and short.count() > 0.95 * small.count()


def test_odd_and_empty(spark, odd, empty):
    from pyspark.sql import functions as F

    check(spark, odd.withColumn("text", F.when(F.length("text") > 9000, F.substring("text", 1, 3000)).otherwise(F.col("text"))))
    assert periodic.query(empty).collect() == []
    long = odd.where("doc_id = 5")
    assert [r[:] for r in periodic.runs(long).select("runs", "collapsed").collect()] == [([(0, 30000, 1)], "word")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_small_alphabets(words):
    assert periodic.find_runs(np.array(words, dtype=np.int64)) == plain_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 60)), max_size=6), st.sampled_from([8, 1 << 16]))
def test_repeated_parts(parts, window):
    words = [w for part, size in parts for w in (part * 60)[:size]]
    assert periodic.find_runs(np.array(words, dtype=np.int64), window=window) == plain_runs(words)


def test_long_periods_and_time():
    rng = random.Random(3)
    for n, p in ((5000, 700), (4000, 999), (3000, 1)):
        root = [rng.randrange(50) for _ in range(p)]
        words = [rng.randrange(50) for _ in range(37)] + (root * n)[:n] + [51]
        assert periodic.find_runs(np.array(words)) == plain_runs(words)
    import time

    began = time.perf_counter()
    assert periodic.find_runs(np.zeros(400_000, dtype=np.int64)) == [(0, 400_000, 1)]
    fib = [0], [0, 1]
    while len(fib[1]) < 100_000:
        fib = fib[1], fib[1] + fib[0]
    periodic.find_runs(np.array(fib[1]))
    assert time.perf_counter() - began < 60


def test_may_repeat_keeps_every_text_with_a_run():
    rng = random.Random(8)
    texts = [[w for _ in range(4) for w in ([rng.randrange(5) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7))] for _ in range(300)]
    numbers, base = [], 0
    for t in texts:
        numbers.append(np.array(t, dtype=np.int64) + base)
        base += 10
    maybe = periodic.may_repeat(np.concatenate(numbers), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert all(m or not plain_runs(t) for m, t in zip(maybe.tolist(), texts)) and not maybe.all()
