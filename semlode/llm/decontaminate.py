"""Benchmark decontamination (operator 10): a prefix-filtered set join with exact verification.

An item's windows are its runs of 13 words (a shorter item is one window); equal windows of several items
are one.  A window is a set of shingles; to contain it a document must contain all of them, so one shingle
is a sufficient prefix, and the rarest gives the fewest candidates.  Rarity is counted over all documents in
one pass, into a table of fixed size by hash.  In a second pass a document joins the prefix shingles by hash;
the position of the shingle in its window gives where the window would have to start, the length bound drops
starts outside the document, and the words there are compared one by one, each by a 64-bit hash.

The items are taken in blocks of a bounded number of windows, which the driver writes to the shared
folder one at a time; a task holds one block and at most some megabytes of text, or one longer text, and
loads each block once for those.  No document text is shuffled.

Defined cases: null or empty texts have no words and no windows; null item ids are never reported but
their windows count as hits; item ids may be of any type and are reported as text; items that repeat under
one id are one item; documents that repeat have equal results; of a very long text every word is looked at;
empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import blocks_of, drop_file, get_file, merge_blocks, new_path, numbered, put_file, tidy
from ._text import ALNUM, buffers, chunks, mix, sequence_hash, words_of

WINDOW, SHINGLE = 13, 3
#: Size of the table of rarities, texts that meet a block together (parts of about a megabyte), candidates compared at a time.
RARITY_BITS, RARITY_ROWS, PARTS, CANDIDATES = 20, 1 << 14, 8, 1 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    data, offsets = buffers(pa.array(texts, pa.string()))
    words = words_of(data, offsets, ALNUM)
    cut = np.searchsorted(words.doc, np.arange(len(texts) + 1))
    return [words.hash[cut[i] : cut[i + 1]] for i in range(len(texts))]


def _windows(rows: list[tuple]) -> dict[str, np.ndarray]:
    """The distinct windows of some items: words, length, and the items that have them (first, then a run of `of`; -1: null id)."""
    names = sorted({str(item) for item, _ in rows if item is not None})
    number = {n: i for i, n in enumerate(names)}
    runs, items = [np.zeros((0, WINDOW + 1), np.uint64)], [np.zeros(0, np.int64)]
    for (item, _), w in zip(rows, _item_words([r[1] for r in rows])):
        size = min(WINDOW, len(w))
        if size:
            found = np.lib.stride_tricks.sliding_window_view(w, size)
            run = np.zeros((len(found), WINDOW + 1), dtype=np.uint64)
            run[:, :size], run[:, WINDOW] = found, size
            runs.append(run)
            items.append(np.full(len(found), -1 if item is None else number[str(item)], dtype=np.int64))
    distinct, which = np.unique(np.concatenate(runs), axis=0, return_inverse=True)
    pair = np.unique(np.stack([which.ravel(), np.concatenate(items)]), axis=1)
    return {"words": distinct[:, :WINDOW], "length": distinct[:, WINDOW].astype(np.int64), "first": np.searchsorted(pair[0], np.arange(len(distinct) + 1)), "of": pair[1], "names": np.array(names, dtype=str)}


def _window_shingles(block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, whether there is such a shingle) of each window; one of fewer words is its own shingle."""
    n = len(block["length"])
    out, real = np.zeros((n, WINDOW - SHINGLE + 1), dtype=np.uint64), np.zeros((n, WINDOW - SHINGLE + 1), dtype=bool)
    for size in np.unique(block["length"]):
        rows = np.flatnonzero(block["length"] == size)
        k = min(SHINGLE, size)
        for at in range(size - k + 1):
            # Runs of k words stand one after the other: the hash of each is at every k-th place.
            out[rows, at] = sequence_hash(block["words"][rows, at : at + k].ravel(), int(k))[::k]
            real[rows, at] = True
    return out, real


def _doc_shingles(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the runs of k words that stay in one document."""
    h = sequence_hash(words.hash, k)
    place = np.flatnonzero(words.doc[: len(h)] == words.doc[k - 1 : k - 1 + len(h)])
    return place, h[place]


def _store(path: str, arrays: dict[str, np.ndarray]) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    put_file(path, out.getvalue())


@lru_cache(maxsize=1)
def _load(path: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(get_file(path))) as z:
        return {k: z[k] for k in z.files}


def _batches_of(benchmark: DataFrame, most: int) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of at most `most` windows, and one item more."""
    rows, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        held += len(r["text"] or "") // 2 + 1
        if held >= most:
            yield _windows(rows)
            rows, held = [], 0
    yield _windows(rows)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _rarity(docs: DataFrame, sizes: list[int]) -> np.ndarray:
    """How often shingles of these numbers of words occur in all documents, by bucket: one pass for all blocks."""
    total = 1 << RARITY_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(total, dtype=np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in chunks(offsets):
                words = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                for k in sizes:
                    counts += np.bincount(_bucket(_doc_shingles(words, k)[1]), minlength=total)
        for block, blob in blocks_of(counts.clip(0, 2**32 - 1).astype(np.uint32), RARITY_ROWS):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "blob": pa.array([blob], pa.binary())})

    return merge_blocks(docs.select("text").mapInArrow(tidy(run), "block int, blob binary"), "uint32", total, RARITY_ROWS, "sum")


def build_index(docs: DataFrame, benchmark: DataFrame, most_windows: int = 500_000) -> list[str]:
    """Write the blocks of windows with their prefix shingles; the paths in the shared folder."""
    spark, plain, sizes = docs.sparkSession, [], set()
    for block in _batches_of(benchmark, most_windows):
        if len(block["length"]):
            plain.append(new_path(spark, "windows-plain"))
            _store(plain[-1], block)
            sizes |= set(np.minimum(block["length"], SHINGLE).tolist())
    if not plain:
        return []
    rarity, paths = _rarity(docs, sorted(sizes)), []
    for path in plain:
        block = _load(path)
        shingles, real = _window_shingles(block)
        rank = np.where(real, rarity[_bucket(shingles)].astype(np.int64), np.iinfo(np.int64).max)
        offset = rank.argmin(axis=1)
        prefix = shingles[np.arange(len(offset)), offset]
        order = np.argsort(prefix, kind="stable")
        lengths = np.diff(block["first"])[order]
        first = np.concatenate([[0], np.cumsum(lengths)])
        of = block["of"][np.repeat(block["first"][:-1][order] - first[:-1], lengths) + np.arange(first[-1])]
        paths.append(new_path(spark, "windows"))
        _store(paths[-1], {"words": block["words"][order], "length": block["length"][order], "first": first, "of": of, "names": block["names"], "prefix": prefix[order], "offset": offset[order], "sizes": np.unique(np.minimum(block["length"], SHINGLE))})
        drop_file(path)
    return paths


def _slices(many: np.ndarray) -> Iterator[slice]:
    """Runs of hits with about CANDIDATES candidates together."""
    ends, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
        yield slice(at, to)
        at = to


def find_windows(words, n_docs: int, block: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, window) of every occurrence of a block's windows in some documents."""
    edge = np.searchsorted(words.doc, np.arange(n_docs + 1))
    for k in block["sizes"]:
        place, h = _doc_shingles(words, int(k))
        low, high = np.searchsorted(block["prefix"], h, "left"), np.searchsorted(block["prefix"], h, "right")
        hit = np.flatnonzero(high > low)
        for part in _slices((high - low)[hit]):
            here = hit[part]
            many = (high - low)[here]
            window = np.repeat(low[here] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            first = np.repeat(place[here], many) - block["offset"][window]
            length, doc = block["length"][window], np.repeat(words.doc[place[here]], many)
            ok = (np.minimum(length, SHINGLE) == k) & (first >= edge[doc]) & (first + length <= edge[doc + 1])
            window, first, length = window[ok], first[ok], length[ok]
            for w in range(WINDOW):
                same = (w >= length) | (words.hash[np.minimum(first + w, len(words.hash) - 1)] == block["words"][window, w])
                window, first, length = window[same], first[same], length[same]
            yield first, window


def _judge(parts: list[tuple[np.ndarray, np.ndarray]], paths: list[str]) -> list[list[pa.Array]]:
    """The columns of RESULT but the id, for each (bytes, offsets) of some texts."""
    state = []
    for data, offsets in parts:
        words = words_of(data, offsets, ALNUM)
        state.append((len(offsets) - 1, words._replace(sums=np.zeros(0, np.uint64)), np.zeros(len(words.doc) + 1, dtype=np.int64), [set() for _ in range(len(offsets) - 1)]))
    for path in paths:
        block = _load(path)
        for n, words, cover, items in state:
            for first, window in find_windows(words, n, block):
                np.add.at(cover, first, 1)
                np.add.at(cover, first + block["length"][window], -1)
                doc, which = np.unique(np.stack([words.doc[first], window]), axis=1)
                for d, w in zip(doc.tolist(), which.tolist()):
                    items[d].update(x for x in block["of"][block["first"][w] : block["first"][w + 1]].tolist() if x >= 0)
        # Numbers become names before the next block, whose numbers are others.
        for _, _, _, items in state:
            for d, x in enumerate(items):
                if x:
                    items[d] = {v if isinstance(v, str) else str(block["names"][v]) for v in x}
    out = []
    for n, words, cover, items in state:
        hit = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
        total = np.bincount(words.doc, minlength=n)
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        out.append([pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array((hit > 0) & (20 * hit >= total))])
    return out


def _judged(batch: pa.RecordBatch, text: int, paths: list[str]) -> Iterator[tuple[int, int, list[pa.Array]]]:
    data, offsets = buffers(batch.column(text))
    spans = list(chunks(offsets))
    together = PARTS if len(paths) > 1 else 1  # a single block stays loaded
    for at in range(0, len(spans), together):
        some = spans[at : at + together]
        yield from ((i, j, got) for (i, j), got in zip(some, _judge([(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in some], paths)))


def contamination(docs: DataFrame, benchmark: DataFrame, most_windows: int = 500_000) -> DataFrame:
    """(doc_id, text) and (item_id, text) to doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    paths = build_index(docs, benchmark, most_windows)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, got in _judged(batch, 1, paths):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), *got], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, most_windows: int = 500_000) -> DataFrame:
    """The documents that are not contaminated, with the columns of docs, in one pass over them."""
    paths = build_index(docs, benchmark, most_windows)
    names, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, got in _judged(batch, text, paths):
                kept = batch.slice(i, j - i).take(pa.array(np.flatnonzero(~np.asarray(got[-1]))))
                yield pa.RecordBatch.from_arrays(kept.columns, names)

    return numbered(docs).mapInArrow(tidy(run), docs.schema)


#: The contract in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, least(13, len(w)) AS size, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS pos FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, size, w[pos:pos + size - 1] AS win FROM i),
s AS (SELECT DISTINCT size FROM v),
p AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS pos FROM d, s WHERE len(w) >= size),
o AS (SELECT doc_id, size, pos, w[pos:pos + size - 1] AS win FROM p),
f AS (SELECT o.doc_id, o.pos, o.size, v.item_id FROM o JOIN v ON o.size = v.size AND o.win = v.win),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS x FROM f) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM f WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
