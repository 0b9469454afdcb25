"""The text that is embedded for a package, its hash, and the payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import PACKAGE_FIELDS

#: Fixed numbers of list items in a document.
MOST = {"keywords": 20, "dependencies": 15, "classifiers": 10}


def search_document() -> Column:
    """Identity and summary first, then lists; sections without content are left out, popularity never appears."""
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(c, 1, MOST[c]), ", ")))
    return F.concat_ws(
        "\n", F.concat(F.lit("Package: "), F.col("name")), F.when(F.col("summary") != "", F.concat(F.lit("Summary: "), X.strip(F.col("summary")))), listed("Keywords", "keywords"), listed("Dependencies", "dependencies"), listed("Category", "classifiers")
    )


def content_hash(document: Column) -> Column:
    return F.sha2(document, 256)


def transform(packages: DataFrame) -> DataFrame:
    """Packages with `document`, and content_hash computed anew."""
    return packages.withColumn("document", search_document()).withColumn("content_hash", content_hash(F.col("document")))


def payload_json() -> Column:
    """The payload as JSON with all 23 keys, times as ISO text."""
    fields = [X.iso_time(F.col(c)).alias(c) if kind == "timestamp" else F.col(c) for c, kind in PACKAGE_FIELDS.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """New packages whose document differs from the stored one (an option; by default all are embedded)."""
    return new.join(old.select("name", "content_hash"), ["name", "content_hash"], "left_anti")
