"""Command line and the service's shapes: search over a collection, ingest into one, and tools for agents."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import text as X
from .operators import models, rag
from .operators.search import blended, final_order, hits, nearest, payload_filter, rerank, slim
from .schemas import check_request
from .sources import extract
from .sources.store import Collection
from .streaming.ingest import Ingest, run_batch, start_watermark


def health() -> dict:
    return {"status": "ok"}


def corpus_of(collection: Collection) -> DataFrame:
    return collection.read().select(F.col("point_id").alias("id"), "vector", "payload.*")


class Stages:
    """Runs the stages of one request one by one and keeps the time of each; a stage has at most some dozen rows."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.ms = spark, {}

    def run(self, name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        rows = df.collect()
        self.ms[f"{name}_ms"] = round(1000 * (time.perf_counter() - began), 1)
        return self.spark.createDataFrame(rows, df.schema)


def respond(spark: SparkSession, corpus: DataFrame, query: str, *, limit: int = 10, use_rerank: bool | None = None, filters: dict | None = None, embed=None, scorer=models.overlap_scorer, as_of: datetime | None = None, k: tuple[int, int] | None = None, s: Settings = Settings()) -> dict:
    """One request to one response with the times of embed, search, rerank and blend; k: (retrieved, reranked)."""
    check_request(query, limit)
    use = s.rerank_enabled_default if use_rerank is None else use_rerank
    fetch, keep = k or (s.search_top_k, s.rerank_top_k)
    stages = Stages(spark)
    asked = stages.run("embed", (embed or models.hashed_embedder(s.embedding_dim))(spark.createDataFrame([(0, query)], "qid long, query string"), "query"))
    top = nearest(asked, corpus, max(fetch, limit), payload_filter(**filters) if filters else None)
    found = stages.run("search", top.join(corpus.drop("vector"), "id").join(asked.drop("vector"), "qid"))
    if use:
        found = stages.run("rerank", rerank(found, scorer, keep))
    else:
        found = found.withColumns({"relevance": F.col("score"), "reranked": F.lit(False)})
    ranked = final_order(blended(found, F.lit(as_of or datetime.now(UTC)), s), limit)
    shown = stages.run("blend", slim(hits(ranked, [c for c in corpus.columns if c not in ("id", "vector")])).orderBy("place"))
    rows = [r.asDict() for r in shown.orderBy("place").collect()]
    return {"query": query, "total": len(rows), "reranked": use and scorer is not None, "results": rows, "took_ms": round(sum(stages.ms.values()), 1), "timing_ms": stages.ms}


def answer(spark: SparkSession, corpus: DataFrame, query: str, model=None, *, use_rerank: bool | None = None, s: Settings = Settings(), **options):
    """The frames of a grounded answer: the list of 50 retrieved, 50 reranked and 8 kept, then the model's words."""
    ranked = respond(spark, corpus, query, limit=s.rag_context_k, use_rerank=True if use_rerank is None else use_rerank, k=(s.rag_retrieve_k, s.rag_rerank_k), s=s, **options)
    shown = spark.createDataFrame([(0, query, r["place"], r["name"], r["summary"]) for r in ranked["results"]], "qid long, query string, place int, name string, summary string")
    prompt = rag.prompts(shown.select("qid", "query").distinct(), shown).first() if ranked["results"] else None
    return rag.live(ranked, prompt["prompt"] if prompt else "", model, rag.judge_with(spark, shown), name=s.llm_model, timeout_s=s.rag_llm_timeout_s)


def result_text(shown: DataFrame) -> DataFrame:
    """(place, text): a hit as lines for a terminal, as built-in expressions.  Fixed: score to three decimals, 97 characters and dots."""
    head = F.format_string("%2d. %s  score=%.3f  \u2605%d", "place", "name", "score", "stars")
    more = F.filter(F.array(X.shortened(F.col("summary")), F.coalesce("pypi_url", F.lit(""))), lambda x: x != "")
    return shown.select("qid", "place", F.array_join(F.concat(F.array(head), F.transform(more, lambda x: F.concat(F.lit("    "), x))), "\n").alias("text"))


def heading(response: dict) -> str:
    how = "reranked" if response["reranked"] else "semantic"
    took = response.get("took_ms")
    return f"{response['total']} hits for {response['query']!r}, {how}, {'?' if took is None else round(took)} ms\n" + 72 * "-"


HIT = "qid long, place int, name string, summary string, score double, stars long, pypi_url string"


def ingest_tables(spark: SparkSession, projects: str, repositories: str, collection: Collection, watermark_path: str | None = None, argument: str | None = None, rows: int | None = None, embed=None, s: Settings = Settings()) -> dict:
    """Extract two catalogue tables since the watermark into a collection."""
    since = start_watermark(spark, argument, watermark_path, s)
    packages = extract.to_packages(extract.extract_tables(spark, projects, repositories, since))
    return run_batch(packages, Ingest(collection, embed or models.hashed_embedder(collection.dim), watermark_path), since, rows=rows)


#: Tools for agents: name to (what it is for, its parameters).
TOOLS = {
    "search_packages": ("Find packages by meaning.", {"query": "string", "limit": "integer", "use_rerank": "boolean", "filters": "object"}),
    "recommend_packages": ("Find packages and let the model choose among them.", {"query": "string", "use_rerank": "boolean"}),
    "health": ("Whether the service answers.", {}),
}


def call_tool(name: str, arguments: dict, search: Callable[..., dict], recommend: Callable[..., dict]) -> dict:
    """One call of a tool; parameters that are null are left out, unknown ones are an error."""
    if name not in TOOLS or (extra := set(arguments) - set(TOOLS[name][1])):
        raise ValueError(f"{name}: no such tool" if name not in TOOLS else f"{name}: unknown {sorted(extra)}")
    given = {k: v for k, v in arguments.items() if v is not None}
    return health() if name == "health" else (search if name == "search_packages" else recommend)(**given)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="semlode")
    sub = parser.add_subparsers(dest="command", required=True)
    find = sub.add_parser("search", help="search a collection")
    load = sub.add_parser("ingest", help="extract catalogue tables into a collection")
    sub.add_parser("health")
    for p in (find, load):
        p.add_argument("--collection", required=True, help="directory of the collection")
    find.add_argument("query")
    find.add_argument("-n", "--limit", type=int, default=5)
    for flag in ("--rerank", "--json"):
        find.add_argument(flag, action="store_true")
    load.add_argument("projects")
    load.add_argument("repositories")
    load.add_argument("--since", help="overrides the watermark file and the settings")
    load.add_argument("--watermark", help="path of the watermark file")
    load.add_argument("--rows", type=int, help="packages of a batch, about")
    args = parser.parse_args(argv)
    try:
        if args.command == "health":
            print(json.dumps(health()))
            return 0
        spark, s = SparkSession.builder.getOrCreate(), Settings.from_env(file=".env")
        collection = Collection(spark, args.collection, s.embedding_dim)
        if args.command == "ingest":
            print(json.dumps(ingest_tables(spark, args.projects, args.repositories, collection, args.watermark, args.since, args.rows, s=s)))
            return 0
        out = respond(spark, corpus_of(collection), args.query, limit=args.limit, use_rerank=args.rerank, s=s)
        if args.json:
            print(json.dumps(out, default=str, indent=2))
        else:
            shown = spark.createDataFrame([(0, *(r[c] for c in ("place", "name", "summary", "score", "stars", "pypi_url"))) for r in out["results"]], HIT)
            print("\n".join([heading(out), *[r["text"] for r in result_text(shown).orderBy("place").collect()]]))
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
