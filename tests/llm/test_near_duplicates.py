"""The pipeline's near-duplicate stage against brute force: five-word shingles, a coefficient of at least 80 %."""

import random
import re

import corpus_pipeline


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def kept(rows, num=80):
    """Rows whose id is the least of their group; the ids of rows are distinct here."""
    sets, parent, where = [shingles(t) for _, t in rows], list(range(len(rows))), {}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in where.get(g, ())}:
            both = len(s & sets[j])
            if 100 * both >= num * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                parent[b] = a
        for g in s:
            where.setdefault(g, []).append(i)
    return {d for i, (d, _) in enumerate(rows) if find(i) == i}


def run(spark, docs):
    return sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())


def test_stage_on_documents(spark, small, rows):
    want = kept([(d, t) for d, t, _ in rows])
    assert run(spark, small) == sorted(want) and len(want) < len(rows)


def test_stage_on_near_copies(spark):
    rng = random.Random(11)
    out = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(80)]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(words[: 80 - rng.randrange(4)]))
    rng.shuffle(out)
    rows = list(enumerate(out))
    assert run(spark, spark.createDataFrame(rows, "doc_id long, text string")) == sorted(kept(rows))
