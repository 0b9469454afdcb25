import math
import re
from collections import Counter

from pyspark.sql import functions as F
from semlode.llm import licenses

FILES = "file long, path string, text string"


def brute(files, templates=licenses.TEMPLATES, least=0.5):
    words = lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
    cue, name = re.compile(licenses.CUE), re.compile(licenses.LICENSE_FILE)
    said = {}
    for f, path, text in files:
        whole = path is not None and name.search(path)
        if whole:
            parts = (text or "").split("\n")
        else:
            parts = [s for s in re.split(r"\n|(?<=[.])[ ]+(?=[A-Z])", text or "") if cue.search(s)]
        said[f, path] = [s for s in parts if s]
    lines = Counter(s for v in said.values() for s in v)
    df = Counter()
    for line, k in lines.items():
        for w in set(words(line)):
            df[w] += k
    for body in templates.values():
        for w in set(words(body)):
            df[w] += 1
    n = sum(lines.values()) + len(templates)
    idf = {w: math.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}
    vec = lambda t: {w: k * idf[w] for w, k in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = {k: vec(b) for k, b in templates.items()}
    own = {}
    for key, parts in said.items():
        best = None
        for s in parts:
            v = vec(s)
            for k, t in known.items():
                dot = sum(v[w] * t[w] for w in v.keys() & t.keys())
                if dot and (score := round(dot / (norm(v) * norm(t)), 6)) >= least:
                    best = min(best, (-score, k)) if best else (-score, k)
        if best:
            own[key] = best
    given = {}
    for (f, path), (score, k) in own.items():
        if path is not None and name.search(path):
            d = path.rpartition("/")[0]
            given[d] = min(given.get(d, (1, "", "")), (score, path, k))
    out = {}
    for f, path, _ in files:
        if (f, path) in own:
            score, k = own[f, path]
            out[f] = (k, -score, False, None)
            continue
        out[f], d = (None, None, False, None), path.rpartition("/")[0] if path is not None else None
        while d is not None:
            if d in given:
                out[f] = (given[d][2], None, True, given[d][1])
                break
            d = d.rpartition("/")[0] if d else None
    return out


def test_inheritance_and_scores(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    files = [
        (1, "LICENSE", mit), (2, "a/b/COPYING", apache), (3, "a/b/c/x.py", "code"), (4, "a/x.py", "code"), (5, "a/b/y.py", f"prose. {mit} more"), (6, "z.py", None),
        (7, None, "x"), (8, "d/LICENSE.txt", "no such words"), (9, "d/x", ""), (10, "e/f/x", "license " * 2000), (11, "a/b/LICENSE", mit), (12, "README", "Copyright 2020 me. Free"),
    ]
    got = {r["file"]: tuple(r)[2:] for r in licenses.scan(spark.createDataFrame(files, FILES)).collect()}
    assert got == brute(files)
    assert got[3][0] == "Apache-2.0" and got[4][3] == "LICENSE" and got[5][0] == "MIT" and got[7][0] is None and got[9][0] == "MIT"


def test_query(small, odd, empty):
    files = [tuple(r) for r in licenses.document_files(small).collect()]
    got = {r["doc_id"]: tuple(r)[2:] for r in licenses.query(small).collect()}
    want = brute(files)
    assert got == want and sum(v[0] is not None for v in want.values()) > 30
    assert licenses.query(empty).count() == 0
    files = [tuple(r) for r in licenses.document_files(odd).collect()]
    got = sorted((tuple(r) for r in licenses.query(odd).collect()), key=repr)
    assert sorted((r[0], r[1]) for r in got if r[0]) == sorted((f, p) for f, p, _ in files if f) and len(got) == len(files)
    assert all(r[2] is None and r[4] is False for r in got)


def test_texts_of_one_file_and_clashing_names(spark):
    mit, nc = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["CC-BY-NC-4.0"]
    rows = [(1, "a/x", mit), (1, "a/x", nc), (1, "a/x", nc), (None, "b/LICENSE", mit), (2, "b/c", None), (2, "b/c", None)]
    files = spark.createDataFrame(rows, FILES).withColumns({"body": F.lit("clash"), "line": F.lit("clash"), "of": F.lit(1), "license": F.lit("none")})
    got = sorted((r["file"] or 0, r["license"], r["inherited"]) for r in licenses.scan(files).collect())
    assert got == [(0, "MIT", False), (1, "CC-BY-NC-4.0", False), (1, "CC-BY-NC-4.0", False), (1, "MIT", False), (2, "MIT", True), (2, "MIT", True)]
