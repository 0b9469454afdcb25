"""The incremental extract: projects with their repositories' stars, newer than a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import PACKAGE_FIELDS

#: The extract as parameterised SQL, for catalogues: tables by name, the watermark and platform as values.
EXTRACT_SQL = """
SELECT p.platform, p.name, p.description, p.homepage_url, p.repository_url, p.licenses,
  try_cast(p.sourcerank AS BIGINT) AS sourcerank, try_cast(p.dependent_projects_count AS BIGINT) AS dependent_projects_count,
  try_cast(p.versions_count AS BIGINT) AS versions_count, try_cast(p.dependent_repositories_count AS BIGINT) AS dependent_repositories_count,
  p.language, p.latest_release_publish_timestamp, try_cast(coalesce(r.stars_count, 0) AS BIGINT) AS repository_stars_count, coalesce(p.keywords, '') AS keywords
FROM IDENTIFIER(:projects) AS p LEFT JOIN IDENTIFIER(:repositories) AS r ON p.repository_id = r.id
WHERE p.platform = :platform AND length(p.description) > 5 AND regexp_replace(p.description, '(?U)^[\\\\s\\\\x1c-\\\\x1f]+', '') <> ''
  AND p.latest_release_publish_timestamp > to_timestamp(:watermark)
"""


def eligible(watermark: str, platform: str = "Pypi") -> Column:
    """Of the platform, with a description of more than five characters (not only spaces), released after the watermark."""
    described = F.col("description").isNotNull() & (X.strip(F.col("description")) != "") & (F.length("description") > 5)
    return (F.col("platform") == platform) & described & (F.col("latest_release_publish_timestamp") > F.to_timestamp(F.lit(watermark)))


def extract(projects: DataFrame, repositories: DataFrame, watermark: str = "1970-01-01", platform: str = "Pypi") -> DataFrame:
    """Raw rows.  The filter is under the join and reaches the scan; projects without a repository have no stars."""
    p = projects.where(eligible(watermark, platform))
    r = repositories.select(F.col("id").alias("repository_id"), "stars_count")
    numbers = ["sourcerank", "dependent_projects_count", "versions_count", "dependent_repositories_count"]
    has = lambda c: F.col(c) if c in projects.columns else F.lit(None)
    return p.join(r, "repository_id", "left").select(
        "platform", "name", "description", *[has(c).cast("string").alias(c) for c in ("homepage_url", "repository_url")], "licenses", *[has(c).try_cast("bigint").alias(c) for c in numbers],
        has("language").cast("string").alias("language"), "latest_release_publish_timestamp", F.coalesce("stars_count", F.lit(0)).cast("bigint").alias("repository_stars_count"), F.coalesce("keywords", F.lit("")).alias("keywords"),
    )


def extract_tables(spark: SparkSession, projects: str, repositories: str, watermark: str = "1970-01-01", platform: str = "Pypi") -> DataFrame:
    """The same over catalogue tables, by bound parameters."""
    return spark.sql(EXTRACT_SQL, args={"projects": projects, "repositories": repositories, "watermark": watermark, "platform": platform})


def count_extract(projects: DataFrame, watermark: str = "1970-01-01", platform: str = "Pypi") -> DataFrame:
    """One row n: how many projects the extract reads; it has no join, so repeated repository ids don't count."""
    return projects.where(eligible(watermark, platform)).agg(F.count(F.lit(1)).alias("n"))


def to_packages(rows: DataFrame) -> DataFrame:
    """Raw rows to the package schema.

    The second of two names is read where the first is null, empty or 0; missing columns are null.
    """
    kinds = dict(rows.dtypes)

    def get(*names: str) -> Column:
        found = [F.col(n) for n in names if n in kinds]
        if not found:
            return F.lit(None)
        return X.or_else(*[f.cast("string") for f in found]) if all(kinds[n] == "string" for n in names if n in kinds) else F.coalesce(*found)

    def number(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n).try_cast("bigint"), F.lit(0)) for n in names if n in kinds], F.lit(0).cast("bigint"))

    def items(*names: str) -> Column:
        """Texts are split, arrays are not; an empty text falls through."""
        lists = []
        for n in (n for n in names if n in kinds):
            lists.append(F.when(F.col(n) != "", X.text_list(F.col(n))) if kinds[n] == "string" else F.when(F.size(n) > 0, X.array_list(F.col(n))))
        return F.coalesce(*lists, F.array().cast("array<string>"))

    def time(*names: str) -> Column:
        values = [X.parse_time(F.col(n)) if kinds[n] == "string" else F.col(n).cast("timestamp") for n in names if n in kinds]
        return F.coalesce(*values, F.lit(None).cast("timestamp"))

    name, release = X.normalize_name(F.col("name")), time("latest_release_publish_timestamp", "update_date")
    out = {
        "name": name, "summary": get("description", "summary"), "keywords": items("keywords"), "dependencies": items("dependencies"), "classifiers": items("classifiers"),
        "stars": number("repository_stars_count", "stars"), "forks": number("forks"), "downloads_30d": get("downloads_30d"), "last_commit": time("last_commit"), "latest_release": release,
        "license": X.license_text(items("licenses", "license")), "requires_python": F.col("requires_python") if "requires_python" in kinds else F.lit(None), "repo_url": get("repository_url", "repo_url"),
        "homepage_url": F.col("homepage_url") if "homepage_url" in kinds else F.lit(None), "pypi_url": X.project_url(name, get("pypi_url").cast("string")), "update_date": release, "content_hash": F.lit(None),
        "sourcerank": number("sourcerank"), "dependent_projects_count": number("dependent_projects_count"), "versions_count": number("versions_count"),
        "dependent_repositories_count": number("dependent_repositories_count"), "language": F.col("language") if "language" in kinds else F.lit(None), "platform": F.coalesce(get("platform").cast("string"), F.lit("Pypi")),
    }
    return rows.select(*[out[c].cast(kind).alias(c) for c, kind in PACKAGE_FIELDS.items()])
