"""A vector collection as bucketed Parquet: a base and the versions since; upsert by key, read the current rows.

A collection is one table, partitioned by version and bucketed by point_id: `version=N` is a folder with a file
a bucket, which counts once its _SUCCESS is there, so readers see the state before until it is whole.  Versions
from the newest base (marked by _BASE) on make up the current state, the newest row of a key wins.  As all
versions have the same buckets, they are read and merged without a shuffle; an upsert shuffles its own rows and
no others.  After MOST_DELTAS versions they are merged into a new base.

Nothing is overwritten or deleted while it may be read: what a base replaces is deleted only when that base is
HOLD seconds old and another one is made, or by `vacuum`.  One writer at a time.

Inside a bucket rows lie by license and stars, with bloom filters on license and requires_python, so that filters
on the payload skip row groups where there is no version since the base.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import point_id
from ..schemas import POINT
from .shared import hadoop_fs, remove

#: Versions since the base that a read looks at, at most; buckets of a new collection; seconds that replaced files are kept.
MOST_DELTAS, BUCKETS, HOLD = 16, 16, 3600


class Collection:
    def __init__(self, spark: SparkSession, path: str, dim: int = 384, most_deltas: int = MOST_DELTAS, buckets: int = BUCKETS, hold: float = HOLD) -> None:
        """A collection that exists keeps the number of buckets that it was made with."""
        self.spark, self.path, self.dim, self.most_deltas, self.buckets, self.hold = spark, path.rstrip("/"), dim, most_deltas, buckets, hold
        if "://" not in self.path:
            self.path = "file://" + self.path.removeprefix("file:")
        self.table = f"semlode_{hashlib.md5(self.path.encode()).hexdigest()[:20]}"

    def _versions(self) -> list[tuple[int, bool, int]]:
        """(number, whether it is a base, milliseconds of its end) of all whole versions in order."""
        Path, where, fs = hadoop_fs(self.spark, self.path)
        out = []
        for s in fs.listStatus(where) if fs.exists(where) else []:
            name = s.getPath().getName()
            if name.startswith("version="):
                inside = {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(s.getPath())}
                if "_SUCCESS" in inside:
                    out.append((int(name.partition("=")[2]), "_BASE" in inside, inside.get("_BASE", inside["_SUCCESS"])))
            elif name.startswith("_buckets-"):
                self.buckets = int(name.partition("-")[2])
        return sorted(out)

    def _live(self) -> list[int]:
        """The versions that make up the current state, the base first; none if there is no base."""
        found = self._versions()
        bases = [i for i, (_, base, _) in enumerate(found) if base]
        return [n for n, _, _ in found[bases[-1] :]] if bases else []

    def version(self) -> int:
        """The number of the newest version, or -1."""
        return max((n for n, _, _ in self._versions()), default=-1)

    def _mark(self, name: str) -> None:
        Path, _, fs = hadoop_fs(self.spark, self.path)
        fs.create(Path(f"{self.path}/{name}"), True).close()

    def _write(self, rows: DataFrame, version: int) -> None:
        """Rows of distinct keys as one version; what an attempt that failed has left there goes first."""
        remove(self.spark, place := f"{self.path}/version={version}")
        bucket = F.pmod(F.hash("point_id"), F.lit(self.buckets))
        dealt = rows.select("point_id", "vector", "payload").repartition(self.buckets, "point_id").sortWithinPartitions(bucket, "payload.license", "payload.stars")
        writer = dealt.write.format("parquet").bucketBy(self.buckets, "point_id").option("path", place)
        for column in ("license", "requires_python"):
            writer = writer.option(f"parquet.bloom.filter.enabled#payload.{column}", "true")
        # A name in the session's catalogue while it is written; the files stay.
        writer.saveAsTable(name := f"{self.table}_{uuid.uuid4().hex[:8]}")
        self.spark.sql(f"DROP TABLE {name}")

    def ensure(self) -> None:
        """Create the collection if there is none; one that exists is left alone."""
        if self.version() < 0:
            self._mark(f"_buckets-{self.buckets}")
            self._write(self.spark.createDataFrame([], POINT), 0)
            self._mark("version=0/_BASE")

    def _rows(self, versions: list[int]) -> DataFrame:
        """point_id, vector, payload, version of some versions, with their buckets known to the planner."""
        if not self.spark.catalog.tableExists(self.table):
            self.spark.sql(f"CREATE TABLE {self.table} ({POINT}, version INT) USING parquet PARTITIONED BY (version) CLUSTERED BY (point_id) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS " + " ".join(f"PARTITION (version={n})" for n in versions))
        return self.spark.table(self.table).where(F.col("version").isin(versions))

    def read(self) -> DataFrame:
        """point_id, vector, payload.  Without versions since the base, filters on the payload reach the scan."""
        self.ensure()
        live = self._live()
        rows = self._rows(live)
        return (rows if len(live) == 1 else last_wins(rows, ["point_id"], [F.desc("version")])).drop("version")

    def upsert(self, points: DataFrame) -> int:
        """Replace the rows of the keys given, the latest of a key first; returns the new version.

        The rows are evaluated once.  What an upsert that failed has left is written over.
        """
        self.ensure()
        now = self.version() + 1
        order = [F.col("payload.update_date").desc_nulls_last(), F.to_json("payload").desc()]
        fresh = last_wins(points.repartition(self.buckets, "point_id"), ["point_id"], order)
        bad = F.raise_error(F.concat(F.lit("vector of another length: "), F.col("point_id")))
        self._write(fresh.withColumn("vector", F.when(F.size("vector") == self.dim, F.col("vector")).otherwise(bad)), now)
        return self.compact() if len(self._live()) - 1 > self.most_deltas else now

    def compact(self) -> int:
        """Merge the current state into a new base; returns the new version.

        Until it is marked as a base it is a version like any other, with the rows that are current anyway.
        """
        now = self.version() + 1
        self._write(self.read(), now)
        self._mark(f"version={now}/_BASE")
        self.vacuum(self.hold)
        return now

    def vacuum(self, hold: float = HOLD) -> list[int]:
        """Delete versions that a base replaced `hold` seconds ago or more; returns their numbers."""
        found, now = self._versions(), time.time() * 1000
        old = [n for i, (n, _, _) in enumerate(found) if any(base and now - at >= hold * 1000 for _, base, at in found[i + 1 :])]
        for n in old:
            remove(self.spark, f"{self.path}/version={n}")
        return old


def points(packages: DataFrame) -> DataFrame:
    """Packages with a vector column as points."""
    payload = F.struct(*[c for c in packages.columns if c not in ("vector", "document")])
    return packages.select(point_id(F.col("name")).alias("point_id"), "vector", payload.alias("payload"))


def last_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of its own of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
