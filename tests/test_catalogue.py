"""The data source: filters that it takes over, slices of files, the billing project."""

import datetime

import pytest
from pyspark.sql import functions as F
from semlode.sources import catalogue


@pytest.fixture
def place(spark, tmp_path):
    spark.dataSource.register(catalogue.CatalogueSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    day = lambda i: datetime.datetime(2024, 1, 1 + i % 28, tzinfo=datetime.timezone.utc)
    rows = [(i, f"n{i}", ("Pypi", "Npm", None)[i % 3], day(i) if i % 5 else None, [f"k{i}"]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, platform string, released timestamp, tags array<string>")
    df.repartition(3).write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/t")
    return f"{tmp_path}/t"


def test_filters_and_slices(spark, place):
    plain = spark.read.parquet(place)
    for size in (1 << 26, 500):
        read = spark.read.format("semlode_catalogue").option("project", "p").option("slice", size).load(place)
        assert read.schema == plain.schema
        assert sorted(map(str, read.collect())) == sorted(map(str, plain.collect()))
        cases = [F.col("platform") == "Pypi", F.col("released") > F.lit("2024-01-10").cast("timestamp"), F.col("id").isin(3, 4, 299) & F.col("platform").isNotNull(), F.col("released").isNull(), F.size("tags") > 1, (F.col("id") < 20) | (F.col("id") >= 290), (F.col("id") <= 20) & F.col("name").startswith("n1")]
        for c in cases:
            assert sorted(map(str, read.where(c).collect())) == sorted(map(str, plain.where(c).collect()))
    shown = read.where((F.col("platform") == "Pypi") & (F.col("released") > F.lit("2024-01-10").cast("timestamp")))
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(shown._jdf.queryExecution(), "formatted")
    taken = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "platform" in taken and "released" in taken


def test_no_billing_project(spark, place):
    with pytest.raises(Exception, match="billing project"):
        spark.read.format("semlode_catalogue").load(place).count()


def test_empty(spark, tmp_path):
    spark.dataSource.register(catalogue.CatalogueSource)
    spark.createDataFrame([], "id long, name string").write.parquet(f"{tmp_path}/e")
    assert spark.read.format("semlode_catalogue").option("project", "p").schema("id long, name string").load(f"{tmp_path}/e").count() == 0
