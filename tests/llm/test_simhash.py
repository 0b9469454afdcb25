"""op11 against brute force: fingerprints word by word, links by comparing all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import xxhash

from semlode.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, radius=4):
    """(id, fingerprint) to the smallest id reachable, by comparing all pairs; None counts as no id."""
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    codes = np.array([c for _, c in pairs], dtype=np.uint64)
    for i in range(len(pairs)):
        for j in np.flatnonzero(np.bitwise_count(codes[:i] ^ codes[i]) <= radius).tolist():
            parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [ids.get(find(i)) for i in range(len(pairs))]


def check(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = sorted(((d, f"{c:016x}", k) for (d, c), k in zip(prints, components(prints))), key=str)
    assert sorted((tuple(r) for r in simhash.query(docs).collect()), key=str) == want
    return want


def test_documents(spark, small):
    want = check(spark, small)
    assert len({k for _, _, k in want}) < len(want)


def test_odd_and_empty(spark, odd, empty):
    check(spark, odd)
    assert simhash.query(empty).collect() == []


def test_spark_has_the_same_hash(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("a b c d é",)], "s string").select(F.xxhash64("s")).first()[0]
    assert one % (1 << 64) == xxhash.xxh64_intdigest("a b c d é".encode(), 42)


def test_masks_leave_no_pair_out():
    rng = random.Random(4)
    for n in (10, 1 << 20, 1 << 28, 1 << 34, 1 << 40):
        chosen = simhash.masks(n)
        for flips in [*combinations(range(0, 64, 5), 4), *[rng.sample(range(64), 4) for _ in range(2000)]]:
            differ = sum(1 << b for b in flips)
            assert any(not differ & m for m in chosen)


def near(rng, centre, most):
    return centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(most + 1)))


def _groups(codes):
    found = {}
    for i, k in enumerate(components(list(enumerate(codes)))):
        found.setdefault(k, []).append(codes[i])
    return found.values()


def test_tree_against_all_pairs():
    rng = random.Random(7)
    for centres, size, most in ((1, 600, 9), (30, 40, 5), (200, 4, 12)):
        codes = list({near(rng, c, most) for c in [rng.getrandbits(64) for _ in range(centres)] for _ in range(size)})
        half = [sorted(codes[: len(codes) // 2]), sorted(codes[len(codes) // 2 :])]
        for part in half:
            part.sort(key=lambda c: int(simhash.gray_rank(np.array([c], np.uint64))[0]))
        every = np.array(sum(half, []), np.uint64)
        label = simhash.within(every, np.repeat([0, 1], [len(half[0]), len(half[1])]))
        offset = 0
        for part in half:
            found = {}
            for c, k in zip(part, label[offset : offset + len(part)].tolist()):
                found.setdefault(k, set()).add(c)
            assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in _groups(part)}
            offset += len(part)
        # Joined across, with what is linked inside each half, it is the whole.
        mixed = simhash.across(*[np.array(p, np.uint64) for p in half])
        parent = list(range(len(every)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, (x, y) in enumerate(zip(label.tolist(), mixed.tolist())):
            parent[find(i)] = find(x)
            parent[find(i)] = find(y)
        got = {}
        for i, c in enumerate(every.tolist()):
            got.setdefault(find(i), set()).add(c)
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in _groups(every.tolist())}


def test_large_groups_are_dealt_as_tiles(spark):
    """A cluster that fills its upper nodes many tiles over, in small batches, across partitions."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    codes = sorted({near(rng, centre, 12) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(1500)})
    signed = [int(np.array([c], np.uint64).view(np.int64)[0]) for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "fp long").repartition(3)
    for hold in (64, 1 << 16):
        found = simhash.links(table, len(codes), tile=16, hold=hold).collect()
        parent = {c: c for c in signed}

        def find(c):
            while parent[c] != c:
                c = parent[c]
            return c

        for a, b in found:
            parent[find(a)] = find(b)
        got = {}
        for c, s in zip(codes, signed):
            got.setdefault(find(s), set()).add(c)
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in _groups(codes)}
        assert len(found) < 40 * len(codes)  # trees of links, not pairs
