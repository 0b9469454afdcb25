"""Cross-tokenizer alignment (operator 12) by segments that are tokenised once.

Two tokenizers cut the same bytes (a space and the text): A byte-level BPE, B a SentencePiece BPE with byte
fallback.  Where a token of both ends at the same byte is a cut; the tokens between two cuts are a group, and
each A token of a group is linked to each of its B tokens.

1. A text is split before white space that follows something else, at those characters for which no entry of
   either vocabulary reaches across (`Pair.splits`): no merge can, so both tokenizers cut there too, and the
   tokens of the whole are those of its segments.  Texts are taken in chunks of some CHUNK bytes; a chunk goes
   to a file as numbers of segments, and each of its distinct segments is one row.
2. Rows of the same segment meet; it is tokenised and aligned once and the alignment goes back to each chunk that
   has it.  A chunk has a segment once, so even the most common one has few rows.
3. Each chunk counts for each linked pair of ids how many of its documents have it; the sums over chunks, and
   the highest of each A id (as many rows as A has ids, so they are broadcast), are joined back to the chunks.
4. A chunk's documents are composed of what is known of its segments.

A document one of whose segments is not given back by both tokenizers has no tokens, like an empty one.

Defined cases: null and empty texts have no tokens; of very long texts all is aligned (memory grows with one
text, and with one segment of a text without spaces); rows that repeat, or whose id repeats or is null, are
documents of their own, and count as such; ties for the highest count are all highest; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, get_file, materialize, new_path, put_file, release, tidy

#: Bytes of text of a chunk, about; characters before which texts may be split.
CHUNK, PLACES = 12 << 20, " \n\t"
#: A group of more links than this is taken by its distinct ids; segments of documents that are tallied at a time.
LARGE, TALLIED = 256, 1 << 17


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their entries, and where texts may be split."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        of = _byte_level()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(map(of.__getitem__, n)) if all(c in of for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.prefixed = self.b.encode("a", out_type=str)[0].startswith("▁")
        self.splits = "".join(c for c in PLACES if self._apart(c, pieces))
        if " " not in self.splits:
            self.splits = ""
        inside = re.escape(self.splits)
        self.pattern = re.compile(rf"[{inside}]\s*\S*(?:[^\S{inside}]\s*\S*)*") if self.splits else re.compile(r".+", re.S)

    def _apart(self, c: str, pieces: list[str]) -> bool:
        """Whether no entry of a vocabulary has c after something that is not white space.

        A has to be a byte-level tokenizer that begins a piece at white space; B has to put a space before a
        text, which must not merge with c where a segment that begins with c is taken by itself.
        """
        made = json.loads(self.a.to_str())
        known = made.get("normalizer") is None and made.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        shown = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i)]
        across = re.compile(r"\S" + re.escape(c))
        free = not any(across.search(x) for t in ((e.decode(errors="replace") for e in self.bytes_a), shown) for x in t)
        return known and self.prefixed and free and (c == " " or not any(f" {c}" in p for p in shown))

    def segments(self, text: str) -> list[str]:
        return self.pattern.findall(" " + text) if text else []

    def _b(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments; B itself puts a space before what it is given."""
        if not self.prefixed:
            return self.b.encode(segments, num_threads=1)
        got = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        # Of another beginning, the space that was put before is not the segment's.
        return [(ids or [self.space]) if s[0] == " " else ids[1:] if ids[0] == self.space else [] for s, ids in zip(segments, got)]

    def align(self, segments: list[str]) -> list[str | None]:
        """For each segment its groups, as `a1,a2|b1;a3|b2,b3`, or None where its bytes are not given back."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        ids_b, raw = self._b(segments), [s.encode() for s in segments]
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        good = [i for i, r in enumerate(raw) if b"".join(map(of_a, ids_a[i])) == r == b"".join(map(of_b, ids_b[i]))]
        out: list[str | None] = [None] * len(segments)
        if not good:
            return out
        a, b = ([x for i in good for x in ids[i]] for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        upto_a, upto_b = (np.searchsorted(e, cuts, side="right").tolist() for e in (end_a, end_b))
        a, b = list(map(str, a)), list(map(str, b))
        groups = [",".join(a[i:j]) + "|" + ",".join(b[k:m]) for i, j, k, m in zip([0, *upto_a], upto_a, [0, *upto_b], upto_b)]
        ends = np.searchsorted(cuts, np.cumsum([len(raw[i]) for i in good]), side="right").tolist()
        for i, x, y in zip(good, [0, *ends], ends):
            out[i] = ";".join(groups[x:y])
        return out


@lru_cache(maxsize=1)
def worker_pair(path_a: str, path_b: str) -> Pair:
    """One pair for all tasks of a Python worker."""
    return Pair(path_a, path_b)


class Linked:
    """The links of a list of aligned segments (null: none): sizes, and distinct pairs of ids with how often each has them."""

    def __init__(self, groups: list[str | None]) -> None:
        n, has = len(groups), np.array([g is not None for g in groups], dtype=bool)
        self.good, of = has, np.flatnonzero(has)
        line = "".join(g + "\n" for g in groups if g is not None).encode()
        signs = np.frombuffer(line, dtype=np.uint8)
        after = signs[(signs < 0x30) | (signs > 0x39)]  # the sign after each number
        ids = np.fromstring(line.translate(bytes.maketrans(b",|;\n", b"    ")).decode(), dtype=np.int64, sep=" ")
        closes, bars = np.isin(after, (0x3B, 0x0A)), after == 0x7C
        group = np.cumsum(closes, dtype=np.int32) - closes
        is_b = np.cumsum(bars, dtype=np.int32) - bars > group
        owner = of[np.cumsum(after == 0x0A)[closes] - (after == 0x0A)[closes]]
        total = len(owner)
        self.counts = {"n_a": np.bincount(owner[group[~is_b]], minlength=n), "n_b": np.bincount(owner[group[is_b]], minlength=n), "n_groups": np.bincount(owner, minlength=n)}
        size_a, size_b = np.bincount(group[~is_b], minlength=total), np.bincount(group[is_b], minlength=total)
        self.counts["n_links"] = np.bincount(owner, weights=size_a * size_b, minlength=n).astype(np.int64)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        a, b, group_a = ids[~is_b], ids[is_b], group[~is_b]
        small = size_a * size_b <= LARGE
        left = np.flatnonzero(small[group_a])
        many = size_b[group_a[left]]
        begins = np.repeat(np.cumsum(many) - many, many)
        right = np.repeat(first_b[group_a[left]], many) + np.arange(len(begins)) - begins
        keys, owners, weights = [np.repeat(a[left], many) << 32 | b[right]], [np.repeat(owner[group_a[left]], many)], [np.ones(len(right), np.int64)]
        for g in np.flatnonzero(~small).tolist():
            (x, n_x), (y, n_y) = (np.unique(v[f[g] : f[g] + s[g]], return_counts=True) for v, f, s in ((a, first_a, size_a), (b, first_b, size_b)))
            keys.append((x[:, None] << 32 | y[None, :]).ravel())
            owners.append(np.full(len(keys[-1]), owner[g]))
            weights.append((n_x[:, None] * n_y[None, :]).ravel())
        del line, signs, after, closes, bars, group, is_b, left, many, begins, right, ids
        keys, owners, weights = np.concatenate(keys), np.concatenate(owners), np.concatenate(weights)
        #: Distinct pairs; of each segment (`first` to the next) which of them it has, and how often.
        self.keys, at = np.unique(keys, return_inverse=True)
        own = owners * max(1, len(self.keys)) + at
        del keys, owners, at
        own, back = np.unique(own, return_inverse=True)
        self.weight = np.bincount(back, weights=weights, minlength=len(own)).astype(np.int64)
        self.pair = own % max(1, len(self.keys))
        self.first = np.searchsorted(own // max(1, len(self.keys)), np.arange(n + 1))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the values of each part, from first[i] to first[i + 1]."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[first[1:]] - upto[first[:-1]]


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of ranges that begin at `first` and have these sizes, one range after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _save(columns: dict[str, np.ndarray | pa.Array], path: str) -> None:
    """Columns of any lengths, each a row of one file."""
    out = pa.BufferOutputStream()
    for values in columns.values():
        batch = pa.RecordBatch.from_arrays([values if isinstance(values, pa.Array) else pa.array(values)], ["v"])
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
    put_file(path, out.getvalue().to_pybytes())


def _load(path: str) -> Iterator[pa.Array]:
    source = pa.BufferReader(get_file(path))
    while source.tell() < source.size():
        yield pa.ipc.open_stream(source).read_all().column(0).combine_chunks()


def cut(docs: DataFrame, paths: tuple[str, str], folder: str, chunk: int = CHUNK) -> DataFrame:
    """(chunk, place, segment): the distinct segments of each chunk from 0; at place -1 the file of its documents.

    An attempt that is repeated cuts the same chunks and writes files of its own.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, name = worker_pair(*paths), TaskContext.get().partitionId() << 32
        index: defaultdict[str, int] = defaultdict(count().__next__)
        ids, held, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal index, ids, held, size, name
            path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}.docs"
            _save({"doc_id": pa.array(ids, pa.int64()), "size": np.array([len(h) for h in held], np.int64), "segment": np.concatenate(held)}, path)
            rows = [path, *index]
            for at in range(0, len(rows), 10_000):
                part = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(np.arange(at, at + len(part)) - 1), pa.array(part, pa.string())], ["chunk", "place", "segment"])
            index = defaultdict(count().__next__)
            ids, held, size, name = [], [], 0, name + 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                found = pair.segments(text)
                ids.append(doc_id.as_py())
                held.append(np.fromiter(map(index.__getitem__, found), dtype=np.int32, count=len(found)))
                size += len(text)
                if size >= chunk:
                    yield from flush()
        if ids:
            yield from flush()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(tidy(read), "chunk long, place long, segment string")


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[pa.RecordBatch]]]:
    """(chunk, its file, its other rows) of rows in the order of chunk and place; the last column has the file at place -1."""
    name, path, rows = None, "", []
    for batch in batches:
        chunk, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *np.flatnonzero(np.diff(chunk) != 0) + 1, batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if chunk[a] != name:
                if name is not None:
                    yield name, path, rows
                if place[a] != -1:
                    raise ValueError("a chunk without its file")
                name, path, rows = int(chunk[a]), batch.column(batch.num_columns - 1)[int(a)].as_py(), []
                a += 1
            if b > a:
                rows.append(batch.slice(a, b - a))
    if name is not None:
        yield name, path, rows


def joined(docs: DataFrame, paths: tuple[str, str], folder: str, chunk: int = CHUNK) -> DataFrame:
    """(chunk, place, groups) in the order of both within partitions of whole chunks; the files at place -1."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, last = worker_pair(*paths), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                own = pc.greater_equal(part.column(1), 0)
                segments = part.filter(own).column(2).dictionary_encode()
                names = segments.dictionary.to_pylist()
                new = [n for n in names if n not in last]
                found = last | dict(zip(new, pair.align(new)))
                last = {names[-1]: found[names[-1]]} if names else last  # the next rows may have it too
                groups = pa.array([found[n] for n in names], pa.string()).take(segments.indices)
                files = part.filter(pc.invert(own))
                for rows, column in ((part.filter(own), groups), (files, files.column(2))):
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), column], ["chunk", "place", "groups"])

    met = cut(docs, paths, folder, chunk).repartition("segment").sortWithinPartitions("segment")
    return met.mapInArrow(tidy(read), "chunk long, place long, groups string").repartition("chunk").sortWithinPartitions("chunk", "place")


def _chunk_of(path: str, rows: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str | None]]:
    """Ids, first segment of each document (and the end), numbers of segments, groups of each number."""
    ids, size, segment = _load(path)
    groups = [g for r in rows for g in r.column(2).to_pylist()]
    segment = segment.to_numpy()
    if len(groups) != int(segment.max(initial=-1)) + 1:
        raise ValueError("segments of a chunk are missing")
    return ids, np.concatenate([[0], np.cumsum(size.to_numpy())]).astype(np.int64), segment, groups


def group_texts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text) to doc_id, groups: the whole alignment as `a1,a2|b1;a3|b2,b3`, empty without tokens."""
    paths, folder = tokenizers(path_a, path_b), new_path(docs.sparkSession, "align")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path, rows in _by_chunk(batches):
            ids, first, segment, groups = _chunk_of(path, rows)
            for d, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
                own = [groups[s] for s in segment[a:b].tolist()]
                yield pa.RecordBatch.from_arrays([ids.slice(d, 1), pa.array(["" if None in own else ";".join(own)])], ["doc_id", "groups"])

    return joined(docs, paths, folder, chunk).mapInArrow(tidy(compose), "doc_id long, groups string")


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text) to one row a document: the columns of RESULT."""
    spark = docs.sparkSession
    paths, folder = tokenizers(path_a, path_b), new_path(spark, "align")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of each chunk with their documents; what is known of documents and segments goes to a file."""
        for name, path, rows in _by_chunk(batches):
            ids, first, segment, groups = _chunk_of(path, rows)
            links, size = Linked(groups), np.diff(first)
            tokens = size > 0
            tokens[np.searchsorted(first, np.flatnonzero(~links.good[segment]), side="right") - 1] = False
            segment = segment[np.repeat(tokens, size)]
            first = np.concatenate([[0], np.cumsum(np.where(tokens, size, 0))])
            hashed = [hashlib.sha256(";".join([groups[s] for s in segment[a:b].tolist()]).encode()).hexdigest() if b > a else "" for a, b in zip(first.tolist(), first[1:].tolist())]
            # Each document's distinct segments, then its distinct pairs, some documents at a time.
            seen, width, own_links = np.zeros(len(links.keys), dtype=np.int64), max(1, len(groups)), np.diff(links.first)
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(first, first[at] + TALLIED, side="right")) - 1)
                part = np.unique(np.repeat(np.arange(to - at), np.diff(first[at : to + 1])) * width + segment[first[at] : first[to]])
                doc, part = part // width, part % width
                pairs = np.repeat(doc, own_links[part]) * max(1, len(seen)) + links.pair[spans(links.first[part], own_links[part])]
                seen += np.bincount(np.unique(pairs) % max(1, len(seen)), minlength=len(seen))
                at = to
            out = f"{folder}/{name}-{uuid.uuid4().hex[:8]}.links"
            known = {c: sums(links.counts[c][segment], first) for c in COUNTS}
            _save({"sha": pa.array(hashed, pa.string()), **known, "tokens": tokens, "pair": links.pair.astype(np.int32), "weight": links.weight, "links": links.first}, out)
            kept = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([f"{path}\n{out}"])], ["chunk", "place", "pair", "docs", "path"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), name)), pa.array(kept), pa.array(links.keys[kept]), pa.array(seen[kept]), pa.nulls(len(kept), pa.string())], ["chunk", "place", "pair", "docs", "path"])

    every = joined(docs, paths, folder, chunk)
    counted = materialize(every.mapInArrow(tidy(tally), "chunk long, place long, pair long, docs long, path string"), "align-pairs")
    release(spark)
    own = counted.where("place >= 0").select("chunk", "place", "pair", "docs")
    totals = materialize(own.groupBy("pair").agg(F.sum("docs").alias("total")), "align-totals")
    highest = totals.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("total").alias("most"))
    marked = totals.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("a")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = own.join(marked, "pair").select("chunk", "place", "total", "best", F.lit(None).cast("string").alias("path"))
    files = counted.where("place < 0").select("chunk", "place", F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("best"), "path")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path, rows in _by_chunk(batches):
            path_docs, path_links = path.split("\n")
            ids, size, segment = _load(path_docs)
            sha, *numbers, tokens, pair, weight, links = _load(path_links)
            size, segment, pair, weight, links, tokens = (x.to_numpy(zero_copy_only=False) for x in (size, segment, pair, weight, links, tokens))
            first = np.concatenate([[0], np.cumsum(size)])
            total, best = np.zeros(int(pair.max(initial=-1)) + 1, np.int64), np.zeros(int(pair.max(initial=-1)) + 1, np.int64)
            for r in rows:
                place = r.column(1).to_numpy()
                total[place], best[place] = r.column(2).to_numpy(), r.column(3).to_numpy(zero_copy_only=False)
            of = [np.where(tokens, sums(sums(weight * x[pair], links)[segment], first), 0) for x in (best, total)]
            yield pa.RecordBatch.from_arrays([ids, *numbers, *map(pa.array, of), sha], [x.split()[0] for x in RESULT.split(", ")])

    done = back.unionByName(files).repartition("chunk").sortWithinPartitions("chunk", "place").mapInArrow(tidy(finish), RESULT)
    result = materialize(done, "align-result")
    discard(counted, totals)
    _drop(spark, folder)
    release(spark)
    return result


def _drop(spark, folder: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tokenizers(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    """The paths given, or those of the public files."""
    import public_tokenizers

    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
