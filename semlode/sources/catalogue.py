"""A package catalogue as a Spark data source: Parquet files that are opened for a billing project.

    spark.dataSource.register(CatalogueSource)
    spark.read.format("semlode_catalogue").option("project", "mine").load(path)

Opening fails without a billing project, as a source client does.  A file is read in slices of SLICE bytes, each
by a task of its own, which looks at the file's footer and takes the row groups of its slice.  Comparisons of
columns with values are taken over from Spark (where spark.sql.python.filterPushdown.enabled is true), leave out
row groups by their statistics, and are shown in the plan; all others stay with Spark.

Defined cases: an empty folder or file has no rows; nulls never meet a comparison; columns are those of the first
file, or of the schema given.  The API of such sources has no pruning of columns.
"""

from __future__ import annotations

import datetime
import operator
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Settings, billing_project
from .shared import open_fs

#: Bytes of a file that a task reads, about.
SLICE = 64 << 20
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "semlode_catalogue"

    def schema(self) -> StructType:
        import pyarrow.dataset as ds

        system, path = open_fs(self._path())
        return from_arrow_schema(ds.dataset(path, filesystem=system, format="parquet").schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        billing_project(Settings(gcp_project_id=self.options.get("project", "")))
        return CatalogueReader(self._path(), schema, int(self.options.get("slice", SLICE)))

    def _path(self) -> str:
        path = self.options["path"]
        return path if "://" in path else "file://" + path.removeprefix("file:")


class Slice(InputPartition):
    def __init__(self, path: str, nth: int, of: int) -> None:
        self.path, self.nth, self.of = path, nth, of


class CatalogueReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType, size: int) -> None:
        self.uri, self.schema, self.size, self.taken = uri, schema, size, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take the comparisons of whole columns with values; give the others back."""
        for f in filters:
            if isinstance(f, (*_COMPARE, In, IsNotNull)) and len(f.attribute) == 1:
                self.taken.append(f)
            else:
                yield f

    def partitions(self) -> list[Slice]:
        """The files, in slices by their sizes; no footer is read on the driver."""
        from pyarrow import fs

        system, path = open_fs(self.uri)
        every = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        files = [f for f in every if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        return [Slice(f.path, i, n) for f in files for n in [-(-f.size // self.size)] for i in range(n)]

    def _expression(self, schema):
        """What was taken over, as an expression of the file's own types."""
        import pyarrow as pa
        import pyarrow.dataset as ds

        def scalar(value, kind):
            if isinstance(value, datetime.datetime) and value.tzinfo and pa.types.is_timestamp(kind) and not kind.tz:
                value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
            return pa.scalar(value).cast(kind)

        def one(f):
            column, kind = ds.field(f.attribute[0]), schema.field(f.attribute[0]).type
            if isinstance(f, IsNotNull):
                return column.is_valid()
            if isinstance(f, In):
                return column.isin([scalar(v, kind) for v in f.value if v is not None])
            return _COMPARE[type(f)](column, scalar(f.value, kind))

        return reduce(operator.and_, map(one, self.taken)) if self.taken else None

    def read(self, partition: Slice) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds

        system, _ = open_fs(self.uri)
        whole = ds.ParquetFileFormat().make_fragment(partition.path, system)
        groups = whole.metadata.num_row_groups
        own = range(groups * partition.nth // partition.of, groups * (partition.nth + 1) // partition.of)
        if not own:
            return
        condition, kinds = self._expression(whole.physical_schema), to_arrow_schema(self.schema)
        part = ds.ParquetFileFormat().make_fragment(partition.path, system, row_groups=list(own))
        for batch in part.to_batches(filter=condition, columns=kinds.names):
            yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(batch.columns, kinds)], schema=kinds)
