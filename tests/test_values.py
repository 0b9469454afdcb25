"""Known values of documents, ids, the ranking algebra, lists and events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from semlode.config import Settings, api_url, billing_project, problems
from semlode.functions import ranking as R
from semlode.functions import text as X
from semlode.operators import documents, rag
from semlode.schemas import PACKAGE, check_request
from semlode.sources import sse, watermark
from semlode.sources.extract import to_packages


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_document_hash_and_ids(spark):
    row = ("requests", "Python HTTP for Humans.", ["http", "requests", "client"], ["urllib3", "certifi", "charset-normalizer", "idna"], ["Topic :: Internet :: WWW/HTTP"], *[None] * 18)
    got = documents.transform(spark.createDataFrame([row], PACKAGE)).first()
    assert got["content_hash"] == "dae867b8245f0981920f907c72e3b7de776811623eab3de8003ec8ea9457da4f"
    ids = {"requests": "c1c7716c-f3a3-5602-973d-e238ec5c036c", "httpx": "e27bf72d-c302-5ffa-92d9-e9176988d407", "foo-bar": "d3123bd4-6adf-5f2d-9e87-47b2ad06a433"}
    for name, want in ids.items():
        assert one(spark, X.point_id(F.lit(name))) == want


BLEND = [
    (0.8, 50000, None, None, None, 0, 0.841127804), (0.8, 1, None, None, None, 0, 0.709041050), (0.8, 100, None, None, None, 800, 0.661371587), (0.5, 0, None, None, None, None, 0.375),
    (0.5, 52000, 10**8, None, None, None, 0.525), (0.5, 1000, 0, None, None, None, 0.420057096), (0.5, 1000, None, 500, None, None, 0.461502982), (0.5, 1000, 10, 500, None, None, 0.435695544),
    (0.5, 1000, None, 500, 28, None, 0.455115722), (0.5, 1000, None, None, -3, None, 0.451597064), (0.5, 0, None, None, None, 180, 0.411787944), (0.5, 10**9, 10**9, None, None, -5, 0.625),
]


def test_blend(spark):
    now = datetime(2024, 7, 1)
    rows = [(i, float(rel), s, d, p, r, None if days is None else now - timedelta(days=days)) for i, (rel, s, d, p, r, days, _) in enumerate(BLEND)]
    df = spark.createDataFrame(rows, "i int, rel double, s long, d long, p long, r long, t timestamp")
    got = df.select("i", R.blend(F.col("rel"), R.popularity(F.col("s"), F.col("d"), F.col("p"), F.col("r")), R.recency(F.col("t"), F.lit(now))).alias("v")).collect()
    assert {r["i"]: r["v"] for r in got} == {i: pytest.approx(b[-1], abs=1e-8) for i, b in enumerate(BLEND)}


def test_lists_names_times(spark):
    assert one(spark, X.text_list(F.lit("a; b,,c "))) == ["a", "b", "c"] and one(spark, X.text_list(F.lit(None).cast("string"))) == []
    assert one(spark, X.normalize_name(F.lit("  Foo_Bar\x1c"))) == "foo-bar" and one(spark, X.normalize_name(F.lit("a.b"))) == "a.b"
    assert one(spark, X.parse_time(F.lit("2024"))) is None and one(spark, X.parse_time(F.lit("2024-01-02T03:04:05Z"))) == datetime(2024, 1, 2, 3, 4, 5)
    assert X.watermark_text(datetime(2024, 1, 15, 9)) == "2024-01-15" and X.watermark_text(" 2024-01-15 ") == "2024-01-15"
    raw = spark.createDataFrame([(" A_b ", "", "text", "x;y", 0, 7, ["MIT", " "])], "name string, description string, summary string, keywords string, repository_stars_count long, stars long, licenses array<string>")
    got = to_packages(raw).first()
    assert (got["name"], got["summary"], got["keywords"], got["stars"], got["license"], got["pypi_url"], got["platform"]) == ("a-b", "text", ["x", "y"], 7, "MIT", "https://pypi.org/project/a-b/", "Pypi")


def test_watermark_file_and_settings(spark, tmp_path):
    path = f"file://{tmp_path}/a/last.txt"
    assert watermark.load(spark, path) == "1970-01-01"
    watermark.save(spark, path, datetime(2024, 1, 3, 5))
    assert watermark.load(spark, path) == "2024-01-03" and (tmp_path / "a/last.txt").read_text() == "2024-01-03\n"
    assert len(problems(Settings(qdrant_url="", qdrant_collection=""))) == 4


HITS = [{"name": "httpx", "summary": "A next  generation client"}, {"name": "requests", "summary": "HTTP for Humans"}]
RAW = '```json\n{"recommendations": [{"package": "httpx", "reason": "r", "cited_snippet": "next generation"}, {"package": "ghost", "reason": "r", "cited_snippet": "x"}, {"package": "Requests", "reason": "r", "cited_snippet": "nope"}]}\n```'


def test_grounding_both_ways(spark):
    hits = spark.createDataFrame([(1, i + 1, h["name"], h["summary"]) for i, h in enumerate(HITS)], "qid long, place int, name string, summary string")
    judge = rag.judge_with(spark, hits)
    one_way = judge(RAW)
    got = rag.results(spark.createDataFrame([(1, RAW), (2, "not json")], "qid long, raw string"), hits).collect()
    first = next(r for r in got if r["qid"] == 1)
    assert [(r["package"], r["snippet_in_description"]) for r in first["recommendations"]] == [(r["package"], r["snippet_in_description"]) for r in one_way["recommendations"]] == [("httpx", True), ("requests", False)]
    assert first["dropped"] == one_way["dropped"] == ["ghost"]
    second = next(r for r in got if r["qid"] == 2)
    assert second["parse_error"] and second["recommendations"] == [] and second["dropped"] == [] and judge("not json")["parse_error"]


def kinds(frames):
    return [e for e, _ in sse.take_frames("".join(frames))[1]]


def test_events(spark):
    hits = spark.createDataFrame([(i + 1, h["name"], h["summary"]) for i, h in enumerate(HITS)], "place int, name string, summary string")
    judge = rag.judge_with(spark, hits)
    frames = "".join(rag.live({"results": HITS}, "p", lambda _: [RAW[:24], RAW[24:]], judge))
    left, got = sse.take_frames(frames + "event: x\ndata: 1")
    assert [e for e, _ in got] == ["ranked_list", "llm_delta", "llm_delta", "llm_done"] and left == "event: x\ndata: 1" and got[-1][1]["dropped"] == ["ghost"]
    assert kinds(rag.live({"results": []}, "p", None, judge)) == kinds(rag.live({"results": HITS}, "p", None, judge)) == ["ranked_list", "llm_error"]

    def broken(_):
        yield "a"
        raise OSError("gone")

    ticks = iter(range(0, 1000, 25))
    assert kinds(rag.live({"results": HITS}, "p", broken, judge)) == ["ranked_list", "llm_delta", "llm_error"]
    assert kinds(rag.live({"results": HITS}, "p", lambda _: "abcdef", judge, clock=lambda: next(ticks))) == ["ranked_list", "llm_delta", "llm_error"]
    with pytest.raises(RuntimeError):
        list(rag.FallbackModel([broken, lambda _: ["b"]]).stream("p"))
    assert list(rag.FallbackModel([lambda _: iter(()).__next__(), lambda _: ["b"]]).stream("p")) == ["b"]


def test_settings_from_file_and_environment(tmp_path):
    (tmp_path / ".env").write_text("# comment\nGCP_PROJECT_ID='mine'\nRANK_ALPHA=0.5\nUNKNOWN=1\nexport RERANK_ENABLED_DEFAULT=true\n\n")
    s = Settings.from_env({"RANK_ALPHA": "0.25"}, str(tmp_path / ".env"))
    assert (s.gcp_project_id, s.rank_alpha, s.rerank_enabled_default, s.search_top_k) == ("mine", 0.25, True, 50)
    assert Settings.from_env({}, str(tmp_path / "none")) == Settings()
    good = Settings(gcp_project_id="mine", qdrant_api_key="k")
    assert problems(good) == [] and len(problems(Settings(gcp_project_id="bigquery-public-data", qdrant_api_key="k"))) == 1
    with pytest.raises(ValueError):
        billing_project(Settings())


def test_requests():
    check_request(" ", 50)
    for query, limit in (("", 5), ("x" * 513, 5), ("x", 0), ("x", 51)):
        with pytest.raises(ValueError):
            check_request(query, limit)
    assert api_url("http://a/") == "http://a" and api_url(None, {"SEMLODE_API_URL": " http://b/ "}) == "http://b" and api_url(None, {}) == "http://localhost:8080"


def test_stripped_as_python_does(spark):
    """All that Python strips at the ends, and no more."""
    from pyspark.sql import functions as F
    from semlode.functions import text as X

    cases = [(chr(i) + "a" + chr(i) + "b" + chr(i),) for i in range(0x3100)] + [(None,), ("",), (" \n\x1c",), ("　 x\n\r\n",), ("\U0001f600 ",)]
    got = spark.createDataFrame(cases, "t string").select("t", X.strip(F.col("t")).alias("s")).collect()
    assert all(r["s"] == (None if r["t"] is None else r["t"].strip()) for r in got)


def test_an_answer_is_parsed_once(spark):
    """The plan strips a text once and parses it once for its fields and once for its validity."""
    from semlode.operators import rag

    raw = spark.range(3).selectExpr("id AS qid", "concat('x', id) AS raw")
    plan = rag.parse_answers(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") == 1
    assert plan.lower().count("parse_json") + plan.count("parseJson") == 1
