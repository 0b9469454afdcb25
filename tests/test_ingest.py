"""Batches, watermarks and restarts of the ingest, the collection, and the command line over it."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from semlode import cli
from semlode.config import Settings
from semlode.operators import models
from semlode.schemas import PACKAGE, PACKAGE_FIELDS
from semlode.sources import watermark
from semlode.sources.shared import hadoop_fs
from semlode.sources.store import Collection, points
from semlode.streaming import ingest

DIM = 8


def packages(spark, rows):
    """(name, summary, date) as packages."""
    full = [{c: None for c in PACKAGE_FIELDS} | {"name": n, "summary": s, "keywords": [], "dependencies": [], "classifiers": [], "stars": 1, "update_date": t, "latest_release": t} for n, s, t in rows]
    return spark.createDataFrame(full, PACKAGE)


def day(n):
    return datetime(2024, 1, n, 5)


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}"


def test_dated_batches_and_watermark(spark, place):
    """Three packages in batches of two; the watermark follows each batch and stays at a day."""
    saved = []
    run = ingest.Ingest(Collection(spark, f"{place}/c", DIM), models.hashed_embedder(DIM), f"{place}/last.txt")
    whole = run.batch
    run.batch = lambda *a: (whole(*a), saved.append(watermark.load(spark, f"{place}/last.txt")))
    feed = packages(spark, [("a", "x", day(1)), ("c", "z", day(3)), ("b", "y", day(2))])
    assert ingest.run_batch(feed, run, rows=2) == {"processed": 3, "watermark_before": "1970-01-01", "watermark_after": "2024-01-03"}
    assert len(saved) == 2 and saved == sorted(saved) and saved[-1] == "2024-01-03"
    assert ingest.start_watermark(spark, None, f"{place}/last.txt") == "2024-01-03" and ingest.start_watermark(spark, "2020-01-01", f"{place}/last.txt") == "2020-01-01"
    # The same day is read again and changes nothing but what is new.
    ingest.run_batch(packages(spark, [("c", "again", day(3)), ("d", "w", day(3))]), run)
    assert {r["name"]: r["summary"] for r in run.collection.read().select("payload.name", "payload.summary").collect()} == {"a": "x", "b": "y", "c": "again", "d": "w"}


def test_no_date_writes_no_watermark(spark, place):
    run = ingest.Ingest(Collection(spark, f"{place}/c", DIM), models.hashed_embedder(DIM), f"{place}/last.txt")
    assert ingest.run_batch(packages(spark, [("x", "y", None)]), run, rows=1) == {"processed": 1, "watermark_before": "1970-01-01", "watermark_after": "1970-01-01"}
    assert watermark.load(spark, f"{place}/last.txt") == "1970-01-01" and run.collection.read().count() == 1
    with pytest.raises(ValueError):
        ingest.run_batch(packages(spark, []), run, settings=Settings())


def test_collection(spark, place):
    """Base and deltas, merging, the latest of a key, a crash in the middle, a vector of another length."""
    c = Collection(spark, f"{place}/c", DIM, most_deltas=2)
    assert c.read().count() == 0 and c.version() == 0
    embed = models.hashed_embedder(DIM)
    put = lambda rows: c.upsert(points(embed(packages(spark, rows), "summary")))
    assert put([("a", "1", day(1)), ("b", "1", day(1)), ("a", "0", day(2)), ("a", "9", None)]) == 1
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{place}/c/version=2")
    _, where, fs = hadoop_fs(spark, f"{place}/c/version=2/_SUCCESS")
    fs.delete(where, False)
    state = lambda: {r["name"]: r["summary"] for r in c.read().select("payload.name", "payload.summary").collect()}
    assert state() == {"a": "0", "b": "1"}
    put([("b", "2", day(3))])
    assert state() == {"a": "0", "b": "2"} and put([("c", "3", day(3))]) == 4 and c._live() == [4]
    assert state() == {"a": "0", "b": "2", "c": "3"}
    bad = points(packages(spark, [("z", "z", day(1))]).withColumn("vector", F.array(F.lit(1.0)).cast("array<float>")))
    with pytest.raises(Exception):
        c.upsert(bad)
    assert state() == {"a": "0", "b": "2", "c": "3"} and put([("b", "5", day(4))]) == 5 and state()["b"] == "5"


def test_read_across_compactions(spark, place):
    """What was read before two compactions can still be evaluated; what no one may hold any more goes."""
    c = Collection(spark, f"{place}/c", DIM, most_deltas=2, buckets=3)
    embed = models.hashed_embedder(DIM)
    put = lambda rows: c.upsert(points(embed(packages(spark, rows), "summary")))
    state = lambda df: {r["name"]: r["summary"] for r in df.select("payload.name", "payload.summary").collect()}
    put([("a", "1", day(1)), ("b", "1", day(1))])
    put([("a", "2", day(1))])
    before = c.read()
    for i in range(3, 9):
        put([("a", str(i), day(1)), (f"n{i}", "x", day(2))])
    assert sum(base for _, base, _ in c._versions()) >= 3
    assert state(before) == {"a": "2", "b": "1"} and state(c.read()) == {"a": "8", "b": "1"} | {f"n{i}": "x" for i in range(3, 9)}
    # Another session's view of the folder: the same state and number of buckets, whatever is asked for.
    spark.sql(f"DROP TABLE {c.table}")
    other = Collection(spark, f"{place}/c", DIM, buckets=7)
    assert state(other.read()) == state(c.read()) and other.buckets == 3
    gone = c.vacuum(0)
    assert gone and 0 in gone and min(n for n, _, _ in c._versions()) == c._live()[0] and state(c.read())["a"] == "8"


def test_merging_does_not_shuffle(spark, place):
    """Base and versions are merged in their buckets; an upsert shuffles the rows that it is given, once."""
    c = Collection(spark, f"{place}/c", DIM, buckets=3)
    embed = models.hashed_embedder(DIM)
    for i in range(3):
        c.upsert(points(embed(packages(spark, [(f"n{k}", str(i), day(1)) for k in range(i, 20)]), "summary")))
    plan = c.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan and "SelectedBucketsCount: 3 out of 3" in plan
    assert c.read().groupBy("payload.summary").count().orderBy("summary").collect() == [("0", 1), ("1", 1), ("2", 18)]


def test_filters_reach_the_base(spark, place):
    c = Collection(spark, f"{place}/c", DIM)
    c.upsert(points(models.hashed_embedder(DIM)(packages(spark, [("a", "1", day(1))]), "summary")))
    c.compact()
    plan = c.read().where("payload.license = 'MIT'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(payload.license,MIT)" in plan and "Window" not in plan


def test_command_line(spark, place, capsys, monkeypatch, tmp_path):
    monkeypatch.setenv("EMBEDDING_DIM", str(DIM))
    monkeypatch.chdir(tmp_path)
    projects = [(i, "Pypi", f"Tool_{i}", f"a tool for task {i}", ["MIT"], "k", day(1 + i % 3)) for i in range(12)]
    cols = "repository_id long, platform string, name string, description string, licenses array<string>, keywords string, latest_release_publish_timestamp timestamp"
    p = spark.createDataFrame(projects, cols).withColumns({c: F.lit(None).cast("string") for c in ("homepage_url", "repository_url", "language", "sourcerank", "dependent_projects_count", "versions_count", "dependent_repositories_count")})
    p.createOrReplaceTempView("cli_projects")
    spark.createDataFrame([(1, 50)], "id long, stars_count long").createOrReplaceTempView("cli_repositories")
    assert cli.main(["ingest", "cli_projects", "cli_repositories", "--collection", f"{place}/c", "--watermark", f"{place}/last.txt", "--rows", "5"]) == 0
    assert json.loads(capsys.readouterr().out) == {"processed": 12, "watermark_before": "1970-01-01", "watermark_after": "2024-01-03"}
    assert cli.main(["search", "tool for task 3", "--collection", f"{place}/c", "-n", "3", "--rerank", "--json"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["total"] == 3 and out["reranked"] and set(out["timing_ms"]) == {"embed_ms", "search_ms", "rerank_ms", "blend_ms"} and out["results"][0]["name"] == "tool-3"
    assert cli.main(["search", "tool", "--collection", f"{place}/c"]) == 0
    shown = capsys.readouterr().out
    assert shown.startswith("5 hits for 'tool', semantic") and shown.count("score=") == 5
    assert cli.main(["search", "x" * 600, "--collection", f"{place}/c"]) == 1 and cli.main(["health"]) == 0
    corpus = cli.corpus_of(Collection(spark, f"{place}/c", DIM))
    frames = list(cli.answer(spark, corpus, "tool for task 3", lambda prompt: ['{"recommendations": [{"package": "Tool_3", "reason": "r", "cited_snippet": "task 3"}]}'], embed=models.hashed_embedder(DIM)))
    assert [f.split("\n")[0] for f in frames] == ["event: ranked_list", "event: llm_delta", "event: llm_done"] and '"tool-3"' in frames[2] and frames[0].count('"place"') == 8
    tool = lambda **a: a
    assert cli.call_tool("search_packages", {"query": "q", "limit": None}, tool, tool) == {"query": "q"} and cli.call_tool("health", {}, tool, tool) == {"status": "ok"}
    for name, arguments in (("other", {}), ("health", {"x": 1})):
        with pytest.raises(ValueError):
            cli.call_tool(name, arguments, tool, tool)
