"""Search: filtered nearest neighbours, reranking, blending, hits.  A table of queries is the unit of work."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Settings
from ..functions import ranking as R
from ..functions import text as X
from ..sources.shared import get_file, materialize, new_path, put_file

#: Queries of a block, and bytes of vectors that a task compares with the blocks at a time.
BLOCK, CHUNK = 2_000, 8 << 20
#: Bytes of the scores of one block that a task has at a time (SCORES: of the exact search, MATRIX: of the index), and of query blocks that a worker keeps.
SCORES, MATRIX, KEPT = 8 << 20, 32 << 20, 16 << 20
#: Pairs of a query and a row whose scores are summed before the best of them are chosen.
CANDIDATES = 200_000

#: (query, document) pairs to a table with a column rerank_score.
Reranker = Callable[[DataFrame], DataFrame]


def payload_filter(min_stars: int | None = None, license: str | None = None, requires_python: str | None = None, active_within_days: int | None = None, as_of: Column | None = None) -> Column:
    """For where(): what is given must hold, and a missing field holds nothing; empty text is not given, 0 stars is.

    active_within_days is accepted and ignored, unless as_of is given too.  All are plain comparisons of columns,
    which reach the statistics of the files that are read; of a missing field they are null, which where() drops.
    """
    given = []
    if min_stars is not None:
        given.append(F.col("stars") >= min_stars)
    given += [F.col(c) == v for c, v in (("license", license), ("requires_python", requires_python)) if v]
    if active_within_days is not None and as_of is not None:
        given.append(F.col("last_commit") >= as_of - F.make_dt_interval(F.lit(active_within_days)))
    return reduce(lambda a, b: a & b, given, F.lit(True))


def searchable(corpus: DataFrame, where: Column | None) -> DataFrame:
    pool = corpus if where is None else corpus.where(where)
    return pool.where(F.col("id").isNotNull() & F.col("vector").isNotNull())


def vectors_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length; those with a null, NaN or infinity in them are left out."""
    sizes, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first, out = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = flat.reshape(len(rows), int(size)) if len(rows) == len(sizes) else flat[first[rows][:, None] + np.arange(int(size))]
        whole = np.isfinite(x).all(axis=1)
        out[int(size)] = (rows, x) if whole.all() else (rows[whole], x[whole])
    return out


def query_blocks(queries: DataFrame, centres: np.ndarray | None = None, probes: int = 0, block: int = BLOCK) -> list[tuple[str, int, list[int]]]:
    """Write the queries to the shared folder, `block` of one length at most to a file; (path, length, lists) of each.

    The executors write; a short row a block comes back.  With centres, each query's nearest lists are written
    too, and `lists` are those of all its queries.
    """
    spark = queries.sparkSession
    n, root = queries.count(), new_path(spark, "queries")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def put(size: int) -> pa.RecordBatch:
            ids, x = pa.concat_arrays([i for i, _ in held[size]]), np.concatenate([v for _, v in held.pop(size)])
            table, near = {"qid": ids, "vector": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), size) if size else pa.nulls(len(x))}, np.zeros((0, 0), np.int32)
            if centres is not None:
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32) if size == centres.shape[1] else np.zeros((len(x), 0), np.int32)
                table["lists"] = pa.array(list(near), pa.list_(pa.int32()))
            out, path = pa.BufferOutputStream(), f"{root}/{uuid.uuid4().hex}.arrow"
            batch = pa.RecordBatch.from_pydict(table)
            with pa.ipc.new_file(out, batch.schema) as file:
                file.write_batch(batch)
            put_file(path, out.getvalue().to_pybytes())
            return pa.RecordBatch.from_pydict({"path": pa.array([path]), "size": pa.array([size], pa.int64()), "lists": pa.array([np.unique(near).tolist()], pa.list_(pa.int32()))})

        for batch in batches:
            for size, (rows, x) in vectors_of(batch.column(1)).items():
                for at in range(0, len(rows), block):
                    part = slice(at, at + block)
                    if size in held and sum(len(v) for _, v in held[size]) + len(x[part]) > block:
                        yield put(size)
                    held.setdefault(size, []).append((batch.column(0).take(pa.array(rows[part])), x[part]))
        for size in list(held):
            yield put(size)

    spread = queries.select("qid", "vector").repartition(max(1, -(-n // block)))
    return [(r["path"], r["size"], r["lists"]) for r in spread.mapInArrow(write, "path string, size long, lists array<int>").collect()]


_held: OrderedDict[str, tuple] = OrderedDict()


def held_block(path: str) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Names, vectors and lists of a block of queries; a worker keeps those used last, up to KEPT bytes."""
    if path not in _held:
        table = pa.ipc.open_file(get_file(path)).read_all().combine_chunks()
        vector = table.column("vector").combine_chunks()
        x = vector.flatten().to_numpy(zero_copy_only=False).reshape(len(vector), -1)
        lists = [np.array(v) for v in table.column("lists").to_pylist()] if "lists" in table.column_names else []
        while _held and sum(b[1].nbytes for b in _held.values()) + x.nbytes > KEPT:
            _held.popitem(last=False)
        _held[path] = table.column("qid").combine_chunks(), x, lists
    _held.move_to_end(path)
    return _held[path]


def _first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that k equal rows stand before."""
    _, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.argsort(which, kind="stable")
    starts = np.flatnonzero(np.diff(which[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.sort(order[place < k])


def _first(who: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query; of equal scores the first row goes first."""
    order = np.lexsort((row, -score, who))
    who, row, score = who[order], row[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    return who[place < k], row[place < k], score[place < k]


def _best(q: np.ndarray, x: np.ndarray, k: int, matrix: int, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of x for each query, with `matrix` bytes of scores at a time.

    The matrix product only chooses candidates; their scores are summed alike for all pairs, so that equal
    vectors have equal scores wherever they stand.  `low` has a score that k rows seen before have reached, for
    each query: rows below it are left out, and it is raised.  Of candidates, CANDIDATES (or those of one
    query and slice) are looked at together, as any number of rows may have one score.
    """
    step = max(1, matrix // (8 * max(1, len(q))))
    low = np.full(len(q), -np.inf) if low is None else low
    # A row below the k-th best is not among the k best, but for the rounding of products.
    slack = 1e-9 * np.linalg.norm(q, axis=1) * (np.linalg.norm(x, axis=1).max() if len(x) else 0.0)
    floor, whole = low - slack, np.zeros(len(q), dtype=bool)
    out, fresh, n = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = _first(*[np.concatenate(c) for c in zip(out, *fresh)], k)
        count = np.bincount(best[0], minlength=len(q))
        np.equal(count, k, out=whole)
        low[whole] = np.maximum(low[whole], best[2][np.cumsum(count)[whole] - 1])
        np.maximum(floor, low - slack, out=floor)
        return best

    for at in range(0, len(x), step):
        part = x[at : at + step]
        s = q @ part.T
        if len(part) > k and not whole.all():
            few = np.flatnonzero(~whole)
            floor[few] = np.maximum(floor[few], np.partition(s[few], len(part) - k, axis=1)[:, len(part) - k] - slack[few])
        near = s >= floor[:, None]
        group = np.cumsum(np.count_nonzero(near, axis=1)) // CANDIDATES
        for g in np.unique(group):
            i, j = np.searchsorted(group, g), np.searchsorted(group, g, "right")
            who, row = np.nonzero(near[i:j])
            who += i
            score = np.concatenate([np.zeros(0), *[(q[who[m : m + 10_000]] * part[row[m : m + 10_000]]).sum(axis=1) for m in range(0, len(who), 10_000)]])
            # Rows come in their order, so one that only equals the last of k rows held stands behind it.
            kept = np.where(whole[who], score > low[who], score >= low[who])
            fresh.append((who[kept], row[kept] + at, score[kept]))
            n += len(fresh[-1][0])
            if n > CANDIDATES:
                out, fresh, n = merged(), [], 0
        if at == 0:
            out, fresh, n = merged(), [], 0
    return merged()


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 50, where: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Cosine top k: queries (qid, vector), corpus (id, vector), of unit length, to qid, id, score, rank.

    One way for any number of queries: their distinct vectors are written in blocks, and each task compares its
    vectors, a bounded chunk at a time, with one block after the other by matrix products and passes on k rows a
    vector and chunk at most, none below what k rows of its chunks before have reached; queries get the rows
    of their vectors by a join.  The corpus is read once and never shuffled, nor sent anywhere.  The filter is
    applied before the search.  A task holds CHUNK bytes of vectors, SCORES bytes of scores, KEPT bytes of blocks
    and a number for each distinct vector of the queries.

    Rows without an id or a vector, and vectors with a null, NaN or infinity in them, are not searched; queries
    without such a vector are not answered; vectors of different lengths are never compared.  All sums are in double
    precision; equal scores are in the order of ids; rows that repeat an id are ranked each.
    """
    queries = queries.where(F.col("vector").isNotNull())
    pool = searchable(corpus, where).select("id", "vector")
    # Numbers made from partition ids are fixed by writing them.
    asked = materialize(queries.select("vector").distinct().withColumn("qid", F.monotonically_increasing_id()), "asked")
    schema = T.StructType([T.StructField("asked", T.LongType()), T.StructField("id", pool.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    kinds = to_arrow_schema(schema)
    blocks, matrix = query_blocks(asked, block=block), SCORES

    def compare(ids: pa.Array, column: pa.Array, lows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = pc.sort_indices(ids)
        ids, column = ids.take(order), column.take(order)
        for size, (rows, x) in vectors_of(column).items():
            kept = _first_copies(x, k) if size and len(x) else np.arange(0)
            if len(kept) < len(rows):
                rows, x = rows[kept], x[kept]
            if not len(rows):
                continue
            for path, length, _ in blocks:
                if length == size:
                    names, q, _ = held_block(path)
                    who, row, score = _best(q, x, k, matrix, lows.setdefault(path, np.full(len(q), -np.inf)))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(who)).cast(kinds.field(0).type), ids.take(pa.array(rows[row])).cast(kinds.field(1).type), pa.array(score)], kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, lows = [], 0, {}
        for batch in batches:
            held.append(batch)
            size += 8 * len(batch.column(1).flatten())
            if size >= CHUNK:
                yield from compare(pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held]), lows)
                held, size = [], 0
        if held:
            yield from compare(pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held]), lows)

    best = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    found = best(pool.mapInArrow(run, schema), "asked").drop("rank")
    named = queries.select("qid", "vector").join(asked.withColumnRenamed("qid", "asked"), "vector").select("qid", "asked")
    # Rows that share a qid are one query.
    return best(named.join(found, "asked").select("qid", "id", "score"), "qid")


def coarse_lists(corpus: DataFrame, lists: int = 64, sample: int = 50_000, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of a bounded sample of unit vectors, for an index; none for an empty table.

    Vectors of another length than the first of the sample's are not in the sample.
    """
    rows = searchable(corpus, None).select("id", "vector").orderBy(F.xxhash64("id")).limit(sample).toPandas()
    same = [v for v in rows["vector"] if len(v) == len(rows["vector"].iloc[0]) and np.isfinite(np.asarray(v, dtype=float)).all()]
    if not same:
        return np.zeros((0, 0))
    x = np.stack(same).astype(np.float64)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def candidate_text(name: Column, summary: Column) -> Column:
    return X.strip(F.concat(F.coalesce(name, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit(""))))


def rerank(candidates: DataFrame, scorer: Reranker | None, keep: int = 20) -> DataFrame:
    """Candidates (qid, query, rank, score, name, summary, …) cut to `keep`, with relevance and reranked.

    The scorer sees at most keep rows a query.  Without one, candidates stay cut and keep their scores.
    """
    cut = candidates.where(F.col("rank") <= keep)
    if scorer is None:
        return cut.withColumns({"relevance": F.col("score"), "reranked": F.lit(False)})
    scored = scorer(cut.withColumn("document", candidate_text(F.col("name"), F.col("summary"))))
    return scored.withColumns({"relevance": R.min_max(F.col("rerank_score"), "qid"), "reranked": F.lit(True)}).drop("rerank_score", "document")


def blended(candidates: DataFrame, as_of: Column, s: Settings = Settings()) -> DataFrame:
    """With `final`: relevance, popularity and recency."""
    has = lambda c: F.col(c) if c in candidates.columns else F.lit(None).cast("bigint")
    times = [F.col(c).cast("timestamp") for c in ("last_commit", "latest_release") if c in candidates.columns]
    popular = R.popularity(has("stars"), has("downloads_30d"), has("dependent_projects_count"), has("sourcerank"))
    recent = R.recency(F.coalesce(*times), as_of) if times else F.lit(0.0)
    return candidates.withColumn("final", R.blend(F.col("relevance"), popular, recent, s.rank_alpha, s.rank_beta, s.rank_delta))


def search(queries: DataFrame, corpus: DataFrame, as_of: Column, *, limit: int = 10, use_rerank: bool | None = None, scorer: Reranker | None = None, where: Column | None = None, retrieve_k: int | None = None, rerank_k: int | None = None, s: Settings = Settings()) -> DataFrame:
    """The whole query: retrieve, rerank if asked, blend all candidates, then take `limit` of each query.

    queries (qid, query, vector), corpus (id, vector, payload columns).  Payloads join after the top k.
    """
    use = s.rerank_enabled_default if use_rerank is None else use_rerank
    k = max(retrieve_k if retrieve_k is not None else s.search_top_k, limit)
    top = nearest(queries, corpus, k, where)
    found = top.join(corpus.drop("vector"), "id").join(queries.drop("vector"), "qid")
    chosen = rerank(found, scorer, rerank_k if rerank_k is not None else s.rerank_top_k) if use else found.withColumns({"relevance": F.col("score"), "reranked": F.lit(False)})
    return final_order(blended(chosen, as_of, s), limit)


def final_order(blended_rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of each query by the blend, equal ones in the order of retrieval, with `place`."""
    order = Window.partitionBy("qid").orderBy(F.desc("final"), "rank")
    return blended_rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def retrieve_for_answer(queries: DataFrame, corpus: DataFrame, as_of: Column, *, use_rerank: bool | None = True, scorer: Reranker | None = None, where: Column | None = None, s: Settings = Settings()) -> DataFrame:
    """The retrieval before generation: more is reranked, and less kept."""
    return search(queries, corpus, as_of, limit=s.rag_context_k, use_rerank=True if use_rerank is None else use_rerank, scorer=scorer, where=where, retrieve_k=s.rag_retrieve_k, rerank_k=s.rag_rerank_k, s=s)


#: Fixed columns of a hit; all others are metadata.
HIT = ["name", "summary", "stars", "forks", "last_commit", "repo_url", "pypi_url"]


def hits(found: DataFrame, payload: list[str]) -> DataFrame:
    """qid, place, name, summary, score, stars, forks, times and links, metadata map, total (rows returned)."""
    have = lambda c: F.col(c) if c in found.columns else F.lit(None)
    rest = [c for c in payload if c not in HIT]
    metadata = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]).cast("array<string>"), F.array(*[F.col(c).cast("string") for c in rest]).cast("array<string>"))
    return found.select(
        "qid", "place", F.coalesce(F.nullif(have("name").cast("string"), F.lit("")), F.col("id").cast("string")).alias("name"), have("summary").cast("string").alias("summary"), F.col("final").alias("score"),
        F.coalesce(have("stars").cast("bigint"), F.lit(0)).alias("stars"), F.coalesce(have("forks").cast("bigint"), F.lit(0)).alias("forks"), have("last_commit").cast("timestamp").alias("last_commit"),
        have("repo_url").cast("string").alias("repo_url"), have("pypi_url").cast("string").alias("pypi_url"), metadata.alias("metadata"), F.count(F.lit(1)).over(Window.partitionBy("qid")).alias("total"),
    )


def slim(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.select("qid", "place", "name", "summary", "score", "stars", "pypi_url")
