"""Incremental ingest: batches of packages are embedded and upserted, and the watermark follows each batch."""

from __future__ import annotations

from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, problems, watermark_source
from ..functions.text import watermark_text
from ..operators.documents import transform
from ..operators.models import Embedder
from ..sources import watermark
from ..sources.shared import discard, hadoop_fs, materialize
from ..sources.store import Collection, points


def progress(rows: DataFrame, time: str, *by: str) -> DataFrame:
    """n, how many rows there are, and newest, the latest of their times (nulls don't count)."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("newest"))


def observed(seen: Observation) -> dict:
    """What was observed; nothing where the rows are known to be none, of which no plan is left to observe."""
    try:
        return seen.get
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return {}


class Ingest:
    """Embeds and upserts batches; safe to repeat, as points are keyed by name."""

    def __init__(self, collection: Collection, embed: Embedder, watermark_path: str | None = None) -> None:
        self.collection, self.embed, self.path = collection, embed, watermark_path
        self.processed, self.newest = 0, None

    def batch(self, packages: DataFrame, _id: int = 0) -> None:
        """One batch, evaluated once: what is counted is observed while it is written.

        The count and newest date are taken, and the watermark moves, after the upsert succeeded.
        """
        seen = Observation()
        watched = packages.observe(seen, F.count(F.lit(1)).alias("n"), F.max("update_date").alias("newest"))
        self.collection.upsert(points(self.embed(transform(watched), "document")))
        got = observed(seen)
        self.took(got.get("n", 0), got.get("newest"))

    def took(self, n: int, newest: datetime | None) -> None:
        """Count rows and move the watermark on to the newest date, never back; that in the file counts after a restart too."""
        self.processed += n
        if newest is not None:
            self.newest = max(self.newest, newest) if self.newest else newest
            if self.path:
                stored = watermark.load(self.collection.spark, self.path, None)
                watermark.save(self.collection.spark, self.path, max(filter(None, (stored, watermark_text(self.newest)))))

    def stats(self, before: str) -> dict:
        return {"processed": self.processed, "watermark_before": before, "watermark_after": watermark_text(self.newest) if self.newest else before}


def start_watermark(spark: SparkSession, argument: str | None, path: str | None, s: Settings = Settings()) -> str:
    return watermark_source(argument, watermark.load(spark, path, None) if path else None, s)


def dated_batches(packages: DataFrame, rows: int) -> list[DataFrame]:
    """Batches of about `rows` packages in the order of update_date, those without a date first.

    Rows of one instant stay together, so the watermark after a batch never passes over some of them.
    """
    n, seconds = packages.count(), F.col("update_date").cast("double")
    parts = max(1, -(-n // rows))
    dated = packages.where(seconds.isNotNull()).select(seconds.alias("t"))
    bounds = sorted(set(dated.approxQuantile("t", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    edges = [None, *bounds, None]
    between = lambda a, b: (F.lit(True) if a is None else seconds > a) & (F.lit(True) if b is None else seconds <= b)
    return [packages.where(F.coalesce(between(a, b), F.lit(a is None))) for a, b in zip(edges, edges[1:])]


def run_batch(packages: DataFrame, ingest: Ingest, before: str = "1970-01-01", settings: Settings | None = None, rows: int | None = None) -> dict:
    """All packages, in one batch or in dated ones of about `rows`; settings are checked if they are given."""
    if settings is not None and (found := problems(settings)):
        raise ValueError("; ".join(found))
    ingest.collection.ensure()
    if not rows:
        ingest.batch(packages)
        return ingest.stats(before)
    # Written, so that what the packages are made of is read once and not again for each batch.
    stored = materialize(packages, "packages")
    for part in dated_batches(stored, rows):
        ingest.batch(part)
    discard(stored)
    return ingest.stats(before)


def newest_rows(packages: DataFrame) -> DataFrame:
    """A stream of packages to the state of each name: `row`, the newest of its rows, how many `times` it came, and `newest`.

    Rows without a date are older than all others; of one date, one of the rows is kept.
    """
    when = F.coalesce("update_date", F.lit("0001-01-01").cast("timestamp"))
    return packages.groupBy("name").agg(F.max_by(F.struct(*packages.columns), when).alias("row"), F.count(F.lit(1)).alias("times"), F.max("update_date").alias("newest"))


def totals(spark: SparkSession, checkpoint: str) -> tuple[int, datetime | None]:
    """Rows taken and their newest date, from the state that Spark keeps of a stream of newest_rows."""
    _, where, fs = hadoop_fs(spark, f"{checkpoint}/state")
    if not fs.exists(where):
        return 0, None
    got = spark.read.format("statestore").load(checkpoint).agg(F.sum("value.count").alias("n"), F.max("value.max").alias("newest")).first()
    return got["n"] or 0, got["newest"]


def run_stream(spark: SparkSession, path: str, schema: str, to_packages, ingest: Ingest, checkpoint: str, files_per_batch: int = 1, before: str = "1970-01-01") -> dict:
    """What has come to a directory since the last run, in micro-batches; returns the stats of all runs.

    Which files were read, the newest row of each name and how many there were are in the checkpoint, so a run
    that is broken off goes on where it was: a batch is upserted again, and counted once.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    each = lambda rows, _id: ingest.batch(rows.select("row.*"))
    run = newest_rows(to_packages(source)).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    ingest.processed, ingest.newest = totals(spark, checkpoint)
    return ingest.stats(before)
