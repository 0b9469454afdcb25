"""The watermark file, through Spark's file system so that any path will do."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import SparkSession

from ..functions.text import watermark_text
from .shared import hadoop_fs


def load(spark: SparkSession, path: str, default: str | None = "1970-01-01") -> str | None:
    _, where, fs = hadoop_fs(spark, path)
    if not fs.exists(where):
        return default
    return watermark_text("".join(r["value"] + "\n" for r in spark.read.text(path).collect()))


def save(spark: SparkSession, path: str, value: str | date | datetime) -> None:
    _, where, fs = hadoop_fs(spark, path)
    fs.mkdirs(where.getParent())
    with_end = bytearray((watermark_text(value) + "\n").encode())
    out = fs.create(where, True)
    try:
        out.write(with_end)
    finally:
        out.close()
