import random
import re

from pyspark.sql import functions as F
from semlode.llm import jaccard


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 90 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return sorted(((d, len(sets[i]), first.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(docs):
    return sorted((tuple(r)[:3] for r in jaccard.join(docs).collect()), key=repr)


def test_query(small, rows):
    assert run(small) == brute([(i, t) for i, t, _ in rows])


def variants(seed, texts=12, copies=14, length=60, changes=4):
    """Groups of near copies with coefficients on both sides of the bound, and a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common, out = [word() for _ in range(20)], []
    for _ in range(texts):
        base = [word() for _ in range(length)] + common
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(changes)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w[: len(w) - rng.randrange(5)]))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_copies(spark):
    for seed in (1, 2):
        rows = variants(seed)
        assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_blocks_find_what_hubs_miss(spark, monkeypatch):
    seen = []
    whole = jaccard.remaining_pairs
    monkeypatch.setattr(jaccard, "remaining_pairs", lambda *a: seen.append(whole(*a)) or seen[-1])
    rows = variants(7, texts=4, copies=40, length=40, changes=7)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert seen[0].count() > 0


def test_odd_rows(spark, odd, empty):
    assert run(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert run(empty) == []
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.where(F.col("doc_id").isNotNull()).collect()} == {1, 2, 3, 4, 5, 6, 8, 9}
    assert jaccard.keep_first(empty).count() == 0


def test_long_lists_in_parts(spark, monkeypatch):
    """One text shares a passage with most others, and lists are dealt in parts of two blocks of four."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PART", 2)
    monkeypatch.setattr(jaccard, "GROUP", 5)
    rows = variants(11, texts=3, copies=60, length=30, changes=8)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_hub_with_most_of_the_rows(spark):
    """Near copies of one text are two thirds of the rows; the rest is unrelated."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:i % 80], "x" * (1 + i // 80), *base[i % 80 + 1 :]])) for i in range(160)]
    rows += [(200 + i, " ".join(f"u{rng.randrange(500)}" for _ in range(30))) for i in range(80)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1, 2), (2, "a b c d", 3, 4), (3, "z", 5, 6), (3, "z", 5, 6)], "doc_id long, text string, group_key long, `g.x` long")
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d", 1, 2), (3, "z", 5, 6)]
