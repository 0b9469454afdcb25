import hashlib
import re

from pyspark.sql import functions as F
from semlode.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = WORD.findall(lower(text))
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w = WORD.findall(lower(text))
        hit, items = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    items |= found
        items.discard(None)
        said = ",".join(sorted(map(str, items)))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(said.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(docs, bench, **options):
    return sorted(map(tuple, decontaminate.contamination(docs, bench, **options).collect()), key=repr)


def test_query(spark, small, rows):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = brute([(i, t) for i, t, _ in rows], items)
    assert sum(r[5] for r in want) > 0
    assert run(small, bench) == want
    assert run(small, bench, most_windows=200) == want
    kept = decontaminate.keep_clean(small, bench)
    assert kept.columns == small.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in want if not r[5]}


def test_odd_rows(spark, odd, empty):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "X"), (3, ""), (4, None), (None, "a b c"), (5, "é, ü"), (5, "é, ü"), (12, "word " * 20), (9, "d e")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit(3))
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(odd, bench) == brute(docs, items)
    assert run(empty, bench) == []
    assert run(odd, bench.limit(0)) == brute(docs, [])
    assert decontaminate.keep_clean(empty, bench).count() == 0


def test_text_item_ids_and_common_windows(spark, monkeypatch):
    """Many items have the same windows, others share their rarest shingle; candidates come in small slices."""
    monkeypatch.setattr(decontaminate, "CANDIDATES", 7)
    words = [f"w{i}" for i in range(40)]
    items = [(f"é{i}", " ".join(words[:20])) for i in range(30)] + [(f"b{i}", " ".join([*words[5:16], f"x{i}", "y"])) for i in range(20)] + [(None, " ".join(words[20:35]))]
    docs = [(1, " ".join(words)), (2, " ".join(words[5:16]) + " x3 y " + "z " * 500), (3, None), (3, ""), (4, "z")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for most in (500_000, 60):
        assert run(d, b, most_windows=most) == brute(docs, items)
