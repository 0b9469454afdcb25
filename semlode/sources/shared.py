"""Tables and files in the folder that every executor can see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

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


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    _, where, fs = hadoop_fs(spark, path)
    fs.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.table_path)


def hadoop_fs(spark: SparkSession, uri: str):
    """(Path class, path, file system) of the JVM for a URI."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(uri)
    return jvm.org.apache.hadoop.fs.Path, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scanned(df: DataFrame) -> dict[str, int]:
    """Run a plan without shuffles and say what its scans read: files, and rows of the row groups that statistics left."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    leaves, out = qe.executedPlan().collectLeaves(), {"files": 0, "rows": 0}
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        for name, key in (("files", "numFiles"), ("rows", "numOutputRows")):
            if metrics.contains(key):
                out[name] += metrics.apply(key).value()
    return out


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
