"""The driver's tables seen as a package catalogue, in Spark and as SQL for the comparison.

part is the projects table, lineitem by part the repositories (stars: its lines) and releases (newest ship
date, number of orders as dependents), embeddings the vectors of parts; some descriptions are null or blank
and some parts are of another platform, so that every predicate has work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import transform
from ..operators.vector_index import VectorIndex
from ..sources.extract import extract, to_packages
from ..sources.shared import hadoop_fs, new_path

AS_OF = "2002-01-01 00:00:00"
SINCE = "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("stars_count"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").cast("timestamp").alias("latest_release_publish_timestamp"), F.countDistinct("l_orderkey").alias("dependent_projects_count"))
    key = F.col("p_partkey")
    described = F.when(key % 50 == 0, F.lit(None)).when(key % 51 == 0, F.lit("   ")).when(key % 53 == 0, F.lit("tiny")).otherwise(F.concat_ws(" ", "p_type", "p_name"))
    return table(spark, sf_dir, "part").join(released, "p_partkey", "left").select(
        key.alias("repository_id"), F.concat(F.lit(" Part_"), key.cast("string")).alias("name"), described.alias("description"), F.replace("p_name", F.lit(" "), F.lit(" ; ")).alias("keywords"),
        F.array(F.col("p_brand"), F.lit(" ")).alias("licenses"), F.col("p_size").alias("sourcerank"), F.when(key % 7 == 0, "Npm").otherwise("Pypi").alias("platform"), "latest_release_publish_timestamp", "dependent_projects_count",
    )


def packages(spark: SparkSession, sf_dir: str, watermark: str = SINCE) -> DataFrame:
    return transform(to_packages(extract(projects(spark, sf_dir), repositories(spark, sf_dir), watermark)))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector and the payload of each package with a vector."""
    p = packages(spark, sf_dir, "1970-01-01").withColumn("id", F.substring("name", 6, 20).cast("bigint"))
    return p.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")


def as_queries(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("qid"), F.concat(F.lit("part "), F.col("vec_id").cast("string")).alias("query"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20: their number grows with the table."""
    return as_queries(table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0))


_stored: dict[tuple, str] = {}


def _path_of(spark: SparkSession, sf_dir: str, kind: str, done: str) -> tuple[str, bool]:
    """Where what is made of the tables is kept for a session, and whether it is there.

    It is made again when the tables have changed since.
    """
    found = []
    for name in ("part", "lineitem", "embeddings"):
        _, where, fs = hadoop_fs(spark, f"{sf_dir}/{name}.parquet")
        status = fs.getFileStatus(where)
        found.append((status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, sf_dir, kind, *found)
    if key in _stored:
        _, where, fs = hadoop_fs(spark, f"{_stored[key]}/{done}")
        if fs.exists(where):
            return _stored[key], True
    _stored[key] = new_path(spark, kind)
    return _stored[key], False


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a written table, as a collection is before it is searched.

    Files are ranges of license and stars, so that a filter on these skips files and row groups by their statistics.
    """
    path, there = _path_of(spark, sf_dir, "corpus", "_SUCCESS")
    df = corpus(spark, sf_dir)
    if not there:
        files = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(files, "license", "stars").sortWithinPartitions("license", "stars").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of the corpus's vectors, as it is before it is searched."""
    path, there = _path_of(spark, sf_dir, "index", "index.json")
    return VectorIndex.open(spark, path) if there else VectorIndex.build(stored_corpus(spark, sf_dir).select("id", "vector"), path)


SQL = f"""
repo AS (SELECT l_partkey AS id, count(*) AS stars_count FROM lineitem GROUP BY 1),
rel AS (SELECT l_partkey AS k, max(l_shipdate) AS ts, count(DISTINCT l_orderkey) AS deps FROM lineitem GROUP BY 1),
projects AS (SELECT p_partkey AS key, ' Part_' || p_partkey AS raw_name,
  CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 51 = 0 THEN '   ' WHEN p_partkey % 53 = 0 THEN 'tiny' ELSE p_type || ' ' || p_name END AS description,
  replace(p_name, ' ', ' ; ') AS keywords, p_brand AS license, p_size AS sourcerank, CASE WHEN p_partkey % 7 = 0 THEN 'Npm' ELSE 'Pypi' END AS platform, ts, coalesce(deps, 0) AS deps
  FROM part LEFT JOIN rel ON k = p_partkey),
every AS (SELECT key, replace(lower(trim(raw_name)), '_', '-') AS name, description AS summary, keywords, license, CAST(sourcerank AS BIGINT) AS sourcerank, deps, ts, coalesce(stars_count, 0) AS stars
  FROM projects LEFT JOIN repo ON key = id WHERE platform = 'Pypi' AND description IS NOT NULL AND trim(description) <> '' AND length(description) > 5 AND ts IS NOT NULL),
pkg AS (SELECT * FROM every WHERE ts > TIMESTAMP '{SINCE}'),
doc AS (SELECT *, 'Package: ' || name || chr(10) || 'Summary: ' || trim(summary) || chr(10) || 'Keywords: ' || replace(keywords, ' ; ', ', ') AS document FROM pkg),
corpus AS (SELECT every.*, CAST(embedding AS DOUBLE[]) AS v FROM every JOIN embeddings ON vec_id = key),
queries AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
scored AS (SELECT qid, key, list_dot_product(v, q) AS score FROM corpus, queries),
knn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM scored),
algebra AS (SELECT key, least((0.85 * m + 0.15 * CASE WHEN sourcerank > 0 THEN ln(1 + sourcerank) ELSE 0 END) / 11.5, 1.0) AS pop, least(m / 11.5, 1.0) AS pop0, rec, sourcerank AS sr
  FROM (SELECT *, CASE WHEN deps <> 0 THEN 0.6 * ln(1 + stars) + 0.4 * ln(1 + deps) ELSE ln(1 + stars) END AS m,
    exp(-greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts), 0) / 86400000000.0 / 180.0) AS rec FROM every)),
blended AS (SELECT knn.*, 0.75 * score + 0.15 * CASE WHEN sr <> 0 THEN pop ELSE pop0 END + 0.10 * rec AS final FROM knn JOIN algebra USING (key) WHERE rank <= 50),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, rank) AS place FROM blended)
"""
