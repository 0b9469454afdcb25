"""embed_rerank against a brute force in plain Python: the stand-in models, the top 50, reranking, the blend."""

import datetime
import math
import re
import zlib

import numpy as np
from semlode.config import Settings
from semlode.plans import queries as Q
from semlode.plans import staging as S

SF = "/root/testdata/sf0.01"


def vector(text, dim=64):
    v = np.zeros(dim)
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[h % dim] += 1 if h >> 31 else -1
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32).astype(np.float64)


def words(text):
    return {w for w in re.split(r"[^\w]|_", text.lower()) if w}


def test_every_query_and_place(spark):
    docs = [r.asDict() for r in S.packages(spark, SF).collect()]
    x, s, as_of = np.array([vector(d["document"]) for d in docs]), Settings(), datetime.datetime.fromisoformat(S.AS_OF)
    log = lambda v: math.log1p(v) if v and v > 0 else 0.0
    want = {}
    for r in S.query_vectors(spark, SF).select("qid", "query").collect():
        score = (vector(r["query"]) * x).sum(axis=1)
        top = sorted(range(len(docs)), key=lambda i: (-score[i], docs[i]["name"]))[:50][:20]
        asked = words(r["query"])
        raw = [len(asked & words((docs[i]["name"] + "\n" + docs[i]["summary"]).strip())) / max(len(asked), 1) for i in top]
        low, high, rows = min(raw), max(raw), []
        for place, (i, v) in enumerate(zip(top, raw)):
            d = docs[i]
            base = log(d["stars"])
            mixed = 0.6 * base + 0.4 * log(d["dependent_projects_count"]) if d["dependent_projects_count"] else base
            popular = min((0.85 * mixed + 0.15 * log(d["sourcerank"]) if d["sourcerank"] else mixed) / 11.5, 1.0)
            age = max((as_of - d["latest_release"]).total_seconds(), 0) / 86400
            relevance = (v - low) / (high - low) if high > low else 1.0
            rows.append((-(s.rank_alpha * relevance + s.rank_beta * popular + s.rank_delta * math.exp(-age / 180)), place, d["name"]))
        want[r["qid"]] = [(name, round(-f, 5)) for f, _, name in sorted(rows)[:10]]
    got = {}
    for r in Q.QUERIES["embed_rerank"](spark, SF).orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append((r["id"], round(r["final"], 5)))
    assert set(got) == set(want)
    for q, rows in want.items():
        assert [f for _, f in got[q]] == [f for _, f in rows] or np.allclose([f for _, f in got[q]], [f for _, f in rows], atol=2e-5)
        assert {n for n, _ in got[q]} == {n for n, _ in rows}
