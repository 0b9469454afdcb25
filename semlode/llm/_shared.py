"""Tables and files in the folder that every executor can see."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder: spark.checkpoint.dir, or the folder given to setCheckpointDir.

    Where neither is set, a session with a local master (tests) gets a folder of its own; on a cluster that is
    an error, as executors would not see each other's files.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} is not set: executors need a folder that all of them see")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="semlode-")
        spark.conf.set(CHECKPOINT_KEY, found)
    if "://" not in found:
        found = "file://" + found.removeprefix("file:")
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/semlode/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it was running, not the stages before this
    table.  Values made from partition ids or sampling become fixed here.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(t.table_path)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def prefix_for(df: DataFrame, name: str) -> str:
    """A beginning for helper columns that no column of df has, whatever its case."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df by quoted names, for those with dots or other marks in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """df with plain names, for functions of Arrow batches, which Spark does not call on names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def join_heavy(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", share: int = 1_000) -> DataFrame:
    """rows with table (one row a key), where one key may hold any part of the rows.

    A key is heavy with more than 1 / share of the rows, so at most `share` of them are; what the table has for
    those is broadcast, and the others meet by a shuffle in which no key is large.  rows are read twice.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("heavy_n"))
    total = F.lit(rows.count() // share)
    heavy = materialize(counts.where((F.col("heavy_n") > total) & F.col(key).isNotNull()).select(key), "heavy")
    some, few = F.broadcast(heavy), F.broadcast(table.join(F.broadcast(heavy), key, "left_semi"))
    return rows.join(some, key, "left_semi").join(few, key, how).unionByName(rows.join(some, key, "left_anti").join(table, key, how))


def ranked(df: DataFrame, order: Column, tag: str) -> DataFrame:
    """df, written, with `place`: its number from 0 in one order over all rows; no task sees more than a range of them."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(ranges, order).withColumn("place_range", F.spark_partition_id()), tag)
    sizes = cut.groupBy("place_range").agg(F.count(F.lit(1)).alias("place_n"))
    # One short row a range: as many as there are partitions.
    before = sizes.select("place_range", F.coalesce(F.sum("place_n").over(Window.orderBy("place_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("place_before"))
    inside = F.row_number().over(Window.partitionBy("place_range").orderBy(order)) - 1
    return cut.withColumn("place_in", inside).join(F.broadcast(before), "place_range").withColumn("place", F.col("place_in") + F.col("place_before")).drop("place_range", "place_in", "place_before")


def open_fs(uri: str):
    """(file system, path) for a URI, on the driver or on an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, payload: bytes) -> None:
    """Write a whole file under a temporary name, then move it, so that readers never see half of one."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(payload)
    system.move(part, path)


def get_file(uri: str) -> bytes:
    system, path = open_fs(uri)
    with system.open_input_file(path) as src:
        return src.read()


def drop_file(uri: str) -> None:
    system, path = open_fs(uri)
    system.delete_file(path)


def pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=dtype)


def blocks_of(values: np.ndarray, rows: int):
    """(block number, packed block) of a fixed-size array, without blocks that hold only zeros."""
    for i in range(0, len(values), rows):
        part = values[i : i + rows]
        if part.any():
            yield i // rows, pack(part)


def merge_blocks(df: DataFrame, dtype: str, total: int, rows: int, how: str) -> np.ndarray:
    """Combine (block int, blob binary) rows from all tasks into one array of fixed size on the driver.

    df has one row for each task and block; the executors combine them (how: "sum" or "or"), so the
    driver gets total / rows blocks however many tasks there were.
    """

    def combine(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(rows, dtype=np.int64 if how == "sum" else dtype)
        for batch in batches:
            for blob in batch.column("blob"):
                part = unpack(blob.as_py(), dtype)
                if how == "sum":
                    out[: len(part)] += part
                else:
                    out[: len(part)] |= part
        out = np.minimum(out, np.iinfo(dtype).max).astype(dtype)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([pack(out)], pa.binary())})

    merged = df.select("block", "blob").groupBy("block").applyInArrow(combine, "block int, blob binary")
    out = np.zeros(total, dtype=dtype)
    # At most total / rows rows, together no larger than the array; an iterator would run a job for each partition.
    for row in merged.collect():
        part = unpack(bytes(row["blob"]), dtype)
        out[row["block"] * rows : row["block"] * rows + rows] = part[: max(0, total - row["block"] * rows)]
    return out


def tidy(run):
    """A function of Arrow batches that gives freed memory back when its task ends: workers stay for the next ones."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
                trim.malloc_trim(0)

    return whole


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results have been written.

    It does so when the driver's garbage collector finds their lineage unreachable, which with a quiet
    driver may be long after; an operator of many steps would keep the files of all of them until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
