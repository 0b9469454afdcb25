"""Declared schemas (as DDL) and the constraints of requests."""

from __future__ import annotations

PACKAGE_FIELDS = {
    "name": "string", "summary": "string", "keywords": "array<string>", "dependencies": "array<string>", "classifiers": "array<string>", "stars": "bigint", "forks": "bigint",
    "downloads_30d": "bigint", "last_commit": "timestamp", "latest_release": "timestamp", "license": "string", "requires_python": "string", "repo_url": "string",
    "homepage_url": "string", "pypi_url": "string", "update_date": "timestamp", "content_hash": "string", "sourcerank": "bigint", "dependent_projects_count": "bigint",
    "versions_count": "bigint", "dependent_repositories_count": "bigint", "language": "string", "platform": "string",
}
PACKAGE = ", ".join(f"{k} {v}" for k, v in PACKAGE_FIELDS.items())
POINT = f"point_id string, vector array<float>, payload struct<{', '.join(f'{k}: {v}' for k, v in PACKAGE_FIELDS.items())}>"
QUERY = "qid bigint, query string, vector array<float>, limit int, rerank boolean, filters struct<min_stars: bigint, license: string, requires_python: string, active_within_days: int>"
LLM = "recommendations array<struct<package: string, reason: string, cited_snippet: string>>"
EVENT = "seq int, event string, data string"
LATENCY = "query string, ok boolean, rtt_ms double, took_ms double, embed_ms double, search_ms double"


def check_request(query: str, limit: int = 10) -> None:
    """A query has 1 to 512 characters (spaces alone will do), a limit is 1 to 50."""
    if not 1 <= len(query) <= 512:
        raise ValueError("query: 1 to 512 characters")
    if not 1 <= limit <= 50:
        raise ValueError("limit: 1 to 50")
