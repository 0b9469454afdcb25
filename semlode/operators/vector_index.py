"""A stored index of vectors: lists as Parquet partitions with short codes, whole vectors in files beside them.

Building.  Centres of a bounded sample cut the space into lists.  A vector is stored three times over, coarse to
fine: as the list whose centre is nearest, as eight bits for each coordinate of its difference from the centre
(two columns of four bits, so that a search may read the first alone), and as it is, in a file of fixed records
whose name and row the code has.  With each code goes the length of what it leaves out, rounded up.

Searching.  Queries are written in blocks.  A task reads codes, never vectors, and compares them with the blocks
by matrix products of a bounded size:

- `exact`: all lists and all eight bits.  A product with the code is wrong by no more than the length of the
  query times what the code leaves out, so a vector whose upper bound is below the k-th lower bound of its query
  can't be among the k nearest; only the others are compared in full.  The answer is that of `search.nearest`.
- `approximate`: the `probes` nearest lists (other partitions are not read), four bits, and then full products
  for the `short` best codes of a query.  State recall with the shares that `work` gives.

Full products read the records asked for out of the files, each file of at most ROWS rows by itself, so no vector
is shuffled.

Defined cases: rows without an id or a vector, of another length than the sample's or with a null, NaN or infinity
in them are not in the index, and such queries are not answered; of equal vectors a search looks at the k first by
id in each file; equal scores are in the order of ids; an empty table gives an index without lists and no
answers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import get_file, materialize, open_fs, put_file
from .search import MATRIX, coarse_lists, held_block, query_blocks, searchable, vectors_of

#: Rows of a file of vectors, at most; records that a read skips rather than begin anew.
ROWS, GAP = 1 << 16, 64


def _nibbles(x: np.ndarray) -> np.ndarray:
    if x.shape[1] % 2:
        x = np.pad(x, ((0, 0), (0, 1)))
    return x[:, ::2] << 4 | x[:, 1::2]


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(len(column), -1)[:, :dim]


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(high, low) of each coordinate, reach of the codes, and the length of what four and eight bits leave out, rounded up."""
    rest = x - centre
    reach = np.nextafter(np.abs(rest).max(axis=1, initial=0).astype(np.float32), np.float32(np.inf))
    code = np.clip(np.floor((rest + reach[:, None]) * (128 / reach.astype(np.float64))[:, None]), 0, 255).astype(np.uint8)
    high, low = code >> 4, code & 15
    off = [np.nextafter((np.linalg.norm(x - decode(centre, reach, high, part), axis=1) * (1 + 1e-9)).astype(np.float32), np.float32(np.inf)) for part in (None, low)]
    return high, low, reach, *off


def decode(centre: np.ndarray, reach: np.ndarray, high: np.ndarray, low: np.ndarray | None) -> np.ndarray:
    """The vectors that codes stand for: the middle of what four bits, or eight, leave open."""
    wide = high * 16.0 + (8.0 if low is None else low + 0.5)
    return centre + (wide / 128 - 1) * reach.astype(np.float64)[:, None]


class VectorIndex:
    """An index at a path; build() makes one, open() finds one that was made before."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, dtype: str) -> None:
        self.spark, self.path, self.centres, self.dtype = spark, path, centres, dtype

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        head = json.loads(get_file(f"{path}/index.json"))
        return cls(spark, path, np.frombuffer(get_file(f"{path}/centres.f64")).reshape(head["lists"], head["dim"]), head["dtype"])

    @classmethod
    def build(cls, corpus: DataFrame, path: str, lists: int = 64, sample: int = 50_000, rows: int = ROWS) -> VectorIndex:
        """Index every row of corpus (id, vector); the centres come from `sample` rows at most."""
        spark, pool = corpus.sparkSession, searchable(corpus, None).select("id", "vector")
        centres = coarse_lists(pool, lists, sample)
        dtype = "<f8" if pool.schema["vector"].dataType.elementType == T.DoubleType() else "<f4"
        id_type = pool.schema["id"].dataType
        near = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("same", T.LongType()), T.StructField("id", id_type), pool.schema["vector"]])
        coded = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("nth", T.IntegerType()), T.StructField("id", id_type), T.StructField("high", T.BinaryType()), T.StructField("low", T.BinaryType()), *[T.StructField(c, T.FloatType()) for c in ("reach", "off_high", "off_low")]])
        kinds = to_arrow_schema(coded)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, (at, x) in vectors_of(batch.column(1)).items():
                    if size == centres.shape[1] and len(at):
                        part = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(nearest_lists(x, centres, 1)[:, 0]), pa.array(_hashes(x, dtype)), part.column(0), part.column(1)], ["list", "same", "id", "vector"])

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def flush() -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                name = int(table.column("list")[0].as_py())
                x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
                file = f"vectors/{name}-{uuid.uuid4().hex[:16]}"
                put_file(f"{path}/{file}", np.ascontiguousarray(x, dtype=dtype).tobytes())
                high, low, reach, *off = encode(x.astype(np.float64), centres[name])
                # Equal vectors stand next to each other, in the order of ids.
                new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
                nth = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
                rest = [pa.array([r.tobytes() for r in _nibbles(c)], pa.binary()) for c in (high, low)]
                columns = [table.column("list").combine_chunks(), pa.array([file] * len(x)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(nth.astype(np.int32)), table.column("id").combine_chunks(), *rest, *map(pa.array, (reach, *off))]
                return pa.RecordBatch.from_arrays(columns, schema=kinds)

            for batch in batches:
                names = batch.column(0).to_numpy()
                edges = [0, *np.flatnonzero(np.diff(names) != 0) + 1, len(names)]
                for a, b in zip(edges, edges[1:]):
                    while a < b:
                        if held and (held[0].column(0)[0].as_py() != names[a] or sum(h.num_rows for h in held) >= rows):
                            yield flush()
                        end = min(b, a + rows - sum(h.num_rows for h in held))
                        held.append(batch.slice(a, end - a))
                        a = end
            if held:
                yield flush()

        put_file(f"{path}/centres.f64", np.ascontiguousarray(centres, dtype=np.float64).tobytes())
        placed = pool.mapInArrow(assign, near).repartitionByRange("list", "same", "id").sortWithinPartitions("list", "same", "id")
        placed.mapInArrow(store, coded).write.partitionBy("list").mode("overwrite").parquet(f"{path}/codes")
        if not centres.size:
            spark.createDataFrame([], coded).write.mode("overwrite").parquet(f"{path}/codes")
        put_file(f"{path}/index.json", json.dumps({"lists": len(centres), "dim": centres.shape[1], "dtype": dtype}).encode())
        return cls(spark, path, centres, dtype)

    def codes(self, lists: list[int] | None = None) -> DataFrame:
        """The rows of the index; of some lists, only their partitions are read."""
        every = self.spark.read.option("basePath", f"{self.path}/codes").parquet(f"{self.path}/codes")
        return every if lists is None else every.where(F.col("list").isin(lists))

    def exact(self, queries: DataFrame, k: int = 50) -> DataFrame:
        """qid, id, score, rank of the k nearest, as search.nearest has them."""
        found = self.candidates(queries, k, None, None)
        return self.ranked(self.products(*found), k)

    def approximate(self, queries: DataFrame, k: int = 50, probes: int = 8, short: int = 200) -> DataFrame:
        """qid, id, score, rank of the k best of the `short` best codes in the `probes` nearest lists."""
        found = self.candidates(queries, k, probes, max(short, k))
        return self.ranked(self.products(*found), k)

    def candidates(self, queries: DataFrame, k: int, probes: int | None, short: int | None) -> tuple[DataFrame, list[tuple]]:
        """(qid, block, row, file, place, id) that are to be compared in full, written; and the blocks of queries.

        Without probes and short these are all that may be among the k nearest.
        """
        centres, dim = self.centres, self.centres.shape[1]
        blocks = [b for b in query_blocks(queries.where(F.col("vector").isNotNull()), centres, probes or 0) if b[1] == dim and dim]
        lists = sorted({x for b in blocks for x in b[2]}) if probes else None
        codes = self.codes(lists).where(F.col("nth") < k).select("list", "file", "place", "id", "high", "reach", *([F.col("off_high").alias("off")] if short else [F.col("off_low").alias("off"), "low"]))
        fields = [T.StructField("qid", queries.schema["qid"].dataType), *[T.StructField(c, T.IntegerType()) for c in ("block", "row")], T.StructField("file", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("id", codes.schema["id"].dataType), *[T.StructField(c, T.DoubleType()) for c in ("under", "over")]]
        kinds, most = to_arrow_schema(T.StructType(fields)), short or k
        slack = (dim + 16) * 2.0**-22  # of products in single precision

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floor: dict[int, np.ndarray] = {}
            for batch in batches:
                names = batch.column(0).to_numpy()
                reach, off = (batch.column(c).to_numpy().astype(np.float64) for c in ("reach", "off"))
                low = None if short else _unpacked(batch.column("low"), dim)
                x = decode(centres[names], reach, _unpacked(batch.column("high"), dim), low)
                length = np.linalg.norm(x, axis=1)
                x = x.astype(np.float32)
                for b, (path, _, _) in enumerate(blocks):
                    qid, q, near = held_block(path)
                    size, asks = np.linalg.norm(q, axis=1), None
                    floor.setdefault(b, np.full(len(q), -np.inf))
                    if probes:
                        asks = np.zeros((len(q), len(centres)), dtype=bool)
                        asks[np.repeat(np.arange(len(q)), [len(n) for n in near]), np.concatenate(near)] = True
                    step = max(1, MATRIX // (16 * len(q)))
                    for at in range(0, len(x), step):
                        part = slice(at, at + step)
                        s = (q.astype(np.float32) @ x[part].T).astype(np.float64)
                        wide = 0.0 if short else size[:, None] * (off[part] + slack * length[part])[None, :]
                        under = s - wide
                        if asks is not None:
                            under[~asks[:, names[part]]] = -np.inf
                        if under.shape[1] >= most:
                            kth = np.partition(under, under.shape[1] - most, axis=1)[:, under.shape[1] - most]
                            np.maximum(floor[b], kth, out=floor[b])
                        who, row = np.nonzero((under + 2 * wide >= floor[b][:, None]) & (under > -np.inf))
                        if len(who):
                            spot = pa.array(row + at)
                            bounds = under[who, row], (under + 2 * wide)[who, row]
                            columns = [qid.take(pa.array(who)), pa.array(np.full(len(who), b, np.int32)), pa.array(who.astype(np.int32)), batch.column("file").take(spot), batch.column("place").take(spot), batch.column("id").take(spot), *map(pa.array, bounds)]
                            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], schema=kinds)

        found = codes.mapInArrow(run, T.StructType(fields))
        order = Window.partitionBy("block", "row").orderBy(F.desc("under"), "id")
        placed = found.withColumn("nth", F.row_number().over(order))
        if short:
            kept = placed.where(F.col("nth") <= short)
        else:
            bound = F.max(F.when(F.col("nth") == k, F.col("under"))).over(Window.partitionBy("block", "row"))
            kept = placed.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("over") >= F.col("bound")))
        return materialize(kept.select("qid", "block", "row", "file", "place", "id"), "candidates"), blocks

    def products(self, found: DataFrame, blocks: list[tuple]) -> DataFrame:
        """qid, id, score of candidates, in double precision, from the files of vectors."""
        path, dtype, dim = self.path, self.dtype, self.centres.shape[1]
        schema = T.StructType([found.schema["qid"], found.schema["id"], T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                file, block, row, place = batch.column("file").to_pylist(), *(batch.column(c).to_numpy() for c in ("block", "row", "place"))
                edges = [i for i in range(1, len(file)) if file[i] != file[i - 1]]
                for a, b in zip([0, *edges], [*edges, len(file)]):
                    if a == b:
                        continue
                    wanted, at = np.unique(place[a:b], return_inverse=True)
                    x, score = _records(f"{path}/{file[a]}", wanted, dim, dtype)[at], np.empty(b - a)
                    for name in np.unique(block[a:b]):
                        own = np.flatnonzero(block[a:b] == name)
                        q = held_block(blocks[name][0])[1]
                        score[own] = (q[row[a:b][own]] * x[own]).sum(axis=1)
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([part.column("qid"), part.column("id"), pa.array(score)], ["qid", "id", "score"])

        return found.repartition("file", "block").sortWithinPartitions("file", "block", "place").mapInArrow(run, schema)

    @staticmethod
    def ranked(scored: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def work(self, queries: DataFrame, found: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """For each query: coded (codes that it is compared with), products (full ones), rows (of the index)."""
        centres = self.centres

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, (at, x) in vectors_of(batch.column(1)).items():
                    if size == centres.shape[1] and len(at):
                        near = nearest_lists(x, centres, probes or len(centres))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, near.shape[1]))), pa.array(near.ravel())], ["qid", "list"])

        asked = queries.select("qid", "vector").mapInArrow(probe, T.StructType([queries.schema["qid"], T.StructField("list", T.IntegerType())]))
        sizes = self.codes().groupBy("list").agg(F.count_if(F.col("nth") < k).alias("n"), F.count(F.lit(1)).alias("whole"))
        total = sizes.agg(F.sum("whole").alias("rows"))
        coded = asked.join(F.broadcast(sizes), "list").groupBy("qid").agg(F.sum("n").alias("coded"))
        full = found.groupBy("qid").agg(F.count(F.lit(1)).alias("products"))
        return coded.join(full, "qid", "left").join(F.broadcast(total)).select("qid", "coded", F.coalesce("products", F.lit(0)).alias("products"), "rows")


def nearest_lists(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)


def _hashes(x: np.ndarray, dtype: str) -> np.ndarray:
    """A number for each vector, the same for equal ones."""
    raw = np.ascontiguousarray(x, dtype=dtype) + 0.0  # -0.0 and 0.0 are equal
    words = raw.view(np.uint32).astype(np.uint64).reshape(len(x), -1)
    out = np.zeros(len(x), dtype=np.uint64)
    for column in words.T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _records(uri: str, wanted: np.ndarray, dim: int, dtype: str) -> np.ndarray:
    """Rows of a file of vectors; those near each other are read at once."""
    system, path = open_fs(uri)
    size = dim * np.dtype(dtype).itemsize
    with system.open_input_file(path) as file:
        starts = np.append(0, np.flatnonzero(np.diff(wanted) > GAP) + 1)
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(wanted))):
            first, last = int(wanted[a]), int(wanted[b - 1])
            raw = file.read_at((last - first + 1) * size, first * size)
            out.append(np.frombuffer(raw, dtype=dtype).reshape(-1, dim)[wanted[a:b] - first])
    return np.concatenate(out).astype(np.float64)
