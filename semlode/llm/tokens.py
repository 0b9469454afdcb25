"""Token-ID output (operator 5): shards of raw ids with a minimal perfect hash index.

Documents are range-partitioned by id, encoded, and written in that order as shard files to the shared
folder.  A shard is a header (JSON), the index and the raw little-endian ids.  The index maps a document
key to its row in constant time: levels of bit vectors, each holding the keys that met no other key
there, with ranks; the row stores a fingerprint of the key, so a key that is not in the shard is refused
(but for one in 2^32), and then the offset and length of its ids.  Keyed access (`lookup`) finds the shard
by bisection in a directory file of fixed records, and then reads a few words of the index and the ids
asked for, never a whole shard or directory.

Defined cases: a null text is empty and has the end id alone; documents with a null id come last, by
text, and are in no index; their ranges are cut by the first NULL_ID_CHARS characters of the text (those that begin
alike are in one range); documents that share an id are next to each other and the index leads to the first; empty
tables give no shards; of a very long text all is encoded; other columns are ignored.  A task holds one
shard (`shard_ids` ids, or one longer document) at a time.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import get_file, materialize, new_path, open_fs, put_file
from ._text import buffers, chunks, mix

MAGIC = b"SLTOKEN2"
END_ID = 2
_GOLD = 0x9E3779B97F4A7C15
#: A space in white space that the tokenizer may give to the piece before it.
_RUN = re.compile(r"\s (?:\s|\Z)")


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: 0..n-1, each once."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])
            self.ranks.append(counts[:-1] + base)
            base += int(counts[-1])
        self.n = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(keys + np.uint64(_GOLD * (level + 1) % (1 << 64))) % np.uint64(words * 64)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            words = max(1, int(-(-len(left) * room // 64)))
            at = cls._place(left, len(levels), words)
            alone = np.bincount(at, minlength=words * 64)[at] == 1
            bits = np.zeros(words, dtype=np.uint64)
            np.bitwise_or.at(bits, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            levels.append(bits)
            left = left[~alone]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1; a key that was not built in may get any number."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._place(keys[open_], level, len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = self.ranks[level][at[hit] >> 6] + below[hit]
            open_ = open_[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def write_shard(keys: list[int | None], lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """One shard of documents in order; keys: None has no index entry."""
    named = np.array([k for k in keys if k is not None], dtype=np.int64)
    distinct, first = np.unique(named, return_index=True)
    table = PerfectHash.build(distinct)
    slot = table.find(distinct)
    prints, rows = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    prints[slot], rows[slot] = fingerprint(distinct), first
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
    arrays = [*[x for level, rank in zip(table.levels, table.ranks) for x in (level, rank)], prints, rows, offsets, named]
    head = json.dumps({"levels": [len(x) for x in table.levels], "keys": len(distinct), "docs": len(keys), "named": len(named), "width": width}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *[x.tobytes() for x in arrays], ids])


class Shard:
    """A shard read back; `get` is the keyed access."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack("<I", raw[8:12])
        head, at = json.loads(raw[12 : 12 + n]), 12 + n

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(raw, dtype=dtype, count=count, offset=at)
            at += out.nbytes
            return out

        self.table = PerfectHash([(take("<u8", k), take("<i8", k))[0] for k in head["levels"]])
        self.prints, self.rows = take("<u4", head["keys"]), take("<u4", head["keys"])
        self.offsets, self.named = take("<u8", head["docs"] + 1).astype(np.int64), take("<i8", head["named"])
        self.docs, self.width = head["docs"], head["width"]
        self.ids = np.frombuffer(raw, dtype=f"<u{self.width}", offset=at)

    def row_of(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, or -1 where the fingerprint says that it is not here."""
        slot = self.table.find(keys)
        safe = np.maximum(slot, 0)
        if not len(self.prints):
            return np.full(len(keys), -1, dtype=np.int64)
        return np.where((slot >= 0) & (self.prints[safe] == fingerprint(keys)), self.rows[safe].astype(np.int64), -1)

    def ids_of(self, row: int) -> np.ndarray:
        return self.ids[self.offsets[row] : self.offsets[row + 1]].astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        row = int(self.row_of(np.array([key], dtype=np.int64))[0])
        return None if row < 0 else self.ids_of(row)


class ShardFile:
    """Keyed access to a shard in place: each step reads some bytes at a known offset."""

    def __init__(self, file) -> None:
        self.file = file
        start = file.read_at(12, 0)
        if start[:8] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack("<I", start[8:])
        head, at = json.loads(file.read_at(n, 12)), 12 + n
        self.levels, self.width = [], head["width"]
        for k in head["levels"]:
            self.levels.append((k, at))
            at += 16 * k
        self.prints, self.rows = at, at + 4 * head["keys"]
        self.offsets = self.rows + 4 * head["keys"]
        self.ids = self.offsets + 8 * (head["docs"] + 1) + 8 * head["named"]

    def _read(self, dtype: str, at: int, count: int = 1) -> np.ndarray:
        return np.frombuffer(self.file.read_at(count * np.dtype(dtype).itemsize, at), dtype=dtype)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document with the key, or None where its fingerprint is not here."""
        name = np.array([key], dtype=np.int64).astype(np.uint64)
        for level, (words, at) in enumerate(self.levels):
            place = int(PerfectHash._place(name, level, words)[0])
            word = int(self._read("<u8", at + 8 * (place >> 6))[0])
            if word >> (place & 63) & 1:
                slot = int(self._read("<i8", at + 8 * words + 8 * (place >> 6))[0]) + (word & (1 << (place & 63)) - 1).bit_count()
                if self._read("<u4", self.prints + 4 * slot)[0] != fingerprint(name)[0]:
                    return None
                row = int(self._read("<u4", self.rows + 4 * slot)[0])
                a, b = self._read("<u8", self.offsets + 8 * row, 2).tolist()
                return self._read(f"<u{self.width}", self.ids + a * self.width, b - a).astype("<u4")
        return None


class Encoder:
    """A byte-level BPE tokenizer, with the ids of pieces of text remembered.

    This kind of tokenizer starts a new piece at every single space, unless other white space stands
    before it and white space or the end after it.  A text without such places, double spaces and special
    tokens is the concatenation of its pieces.  Pieces without white space at their ends can be joined
    again in any order: new ones of several texts are encoded by the library as one text and cut before
    the ids that begin with a space, the rest one by one.  Other texts go to the library whole.
    """

    def __init__(self, path: str, most: int = 700_000) -> None:
        # Spark gives each worker one core; the library's own threads would only contend for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and self.tokenizer.normalizer is None
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {"": b""}
        self.tails: dict[str, bytes] = {}  # pieces that end in white space: never in known, so that encode_many looks at their texts
        self.marks = {c: self._library(c).tobytes() for c in ",."}
        self.most = most

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")

    def _learn(self, pieces: list[str]) -> None:
        """Remember pieces that follow a space; when full, the half that came first (the most common) stays."""
        known = self.known
        if len(known) > self.most:
            self.known = known = dict(islice(known.items(), self.most // 2))
        alone = [p for p in pieces if p != p.strip()] + [""] * ("" in pieces)
        if alone:
            if len(self.tails) > self.most // 4:
                self.tails = {}
            found = self.tokenizer.encode_batch_fast([" " + p for p in alone], add_special_tokens=False)
            for p, e in zip(alone, found):
                (self.tails if p[-1:].isspace() else known)[p] = np.array(e.ids, dtype=f"<u{self.width}").tobytes()
            pieces = [p for p in pieces if p and p == p.strip()]
        # A letter and a comma or full stop after it never share an id, so a known word gives its marked form.
        stems = {p: known.get(p[:-1]) for p in pieces if p[-1:] in self.marks and p[-2:-1].isalpha()}
        known.update((p, ids + self.marks[p[-1]]) for p, ids in stems.items() if ids is not None)
        rest = [p for p in pieces if stems.get(p) is None and p not in known]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            ids = self._library(" " + " ".join(part))
            ends = (np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * self.width).tolist()
            raw = ids.tobytes()
            if len(ends) == len(part) + 1:
                known.update(zip(part, [raw[a:b] for a, b in zip(ends, ends[1:])]))
            else:  # the cuts are not those between pieces: each by itself
                known.update((p, self._library(" " + p).tobytes()) for p in part)

    def _first(self, pieces: list[str]) -> None:
        """Remember pieces that begin a text."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.heads]
        if len(self.heads) > self.most // 4:
            self.heads, new = {"": b""}, list(dict.fromkeys(pieces))
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.heads.update((p, np.array(e.ids, dtype=f"<u{self.width}").tobytes()) for p, e in zip(new, found))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        work: list[tuple | None] = []
        get, new = self.known.get, []
        for t in texts:
            if not self.plain or "  " in t or any(s in t for s in self.special):
                work.append(None)
                continue
            head, *pieces = t.split(" ")
            got = list(map(get, pieces))
            open_ = [i for i, g in enumerate(got) if g is None] if None in got else []
            new += [pieces[i] for i in open_]
            work.append((head, pieces, got, open_))
        new = list(dict.fromkeys(new))
        ends = {p for p in new if p[-1:].isspace()}
        for k, w in enumerate(work):
            if w and (w[0][-1:].isspace() or (ends and any(w[1][i] in ends for i in w[3]))) and _RUN.search(texts[k]):
                work[k] = None
        if new:
            self._learn(new)
        self._first([w[0] for w in work if w])
        out, known = [], self.known
        for t, w in zip(texts, work):
            if w is None:
                out.append(self._library(t).tobytes())
                continue
            head, pieces, got, open_ = w
            for i in open_:
                got[i] = known.get(pieces[i]) or self.tails[pieces[i]]
            out.append(self.heads[head] + b"".join(got))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


#: How much of a text orders the ranges of documents without an id; what a range partitioner samples goes to the driver.
NULL_ID_CHARS = 256
MANIFEST = "path string, part int, seq int, docs long, ids long, bytes long, first_id long, last_id long"


def _ranges(docs: DataFrame, most_bytes: int = 64 << 20) -> int:
    """Partitions for an ordered pass: as the session has, and more where the stored input is larger."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    stored = size if size < 1 << 60 else 0  # a leaf of unknown size counts as 2^63
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored // most_bytes))


def write(docs: DataFrame, tokenizer_path: str, *, partitions: int | None = None, shard_ids: int = 4 << 20, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to shard files; returns their manifest, which also is a table in the shared folder.

    The manifest has a row for each finished shard with the ids of all shards before it (`start`).  A
    retried task writes files of its own; those that no manifest row names are left unused.
    """
    spark = docs.sparkSession
    root = new_path(spark, "tokens")
    n = partitions or _ranges(docs)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Many documents may have no id; the beginnings of texts are in the order of the texts.
    ranged = ranged.repartitionByRange(n, F.col("doc_id").asc_nulls_last(), F.when(F.col("doc_id").isNull(), F.substring("text", 1, NULL_ID_CHARS)))
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        keys: list = []
        parts: list[bytes] = []
        held, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, held, seq
            lengths = np.array([len(p) // encoder.width for p in parts], dtype=np.int64)
            blob = write_shard(keys, lengths, b"".join(parts), encoder.width)
            path = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex[:8]}.tok"
            put_file(path, blob)
            row = [path, part, seq, len(keys), int(lengths.sum()), len(blob), keys[0], keys[-1]]
            keys, parts, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5])], names)

        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets, 1 << 16):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                for key, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), encoder.encode_many(texts)):
                    ids += end
                    if keys and held + len(ids) > shard_ids * encoder.width:
                        yield flush()
                    keys.append(key)
                    parts.append(ids)
                    held += len(ids)
        if keys:
            yield flush()

    manifest = materialize(ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text").mapInArrow(run, MANIFEST), "token-manifest")
    # Ids before a range of shards, one short row a range, and then within the range.
    ranges = manifest.groupBy("part").agg(F.sum("ids").alias("all_ids"))
    upto = lambda column, w: F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = ranges.select("part", upto("all_ids", Window.orderBy("part")).alias("range_start"))
    inside = upto("ids", Window.partitionBy("part").orderBy("seq"))
    return manifest.withColumn("inside", inside).join(F.broadcast(earlier), "part").select(*manifest.columns, (F.col("range_start") + F.col("inside")).alias("start"))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame) -> DataFrame:
    """Per document from the shard files: doc_id, start, n_tokens, ids_crc32 (ids as unsigned 32-bit, little-endian)."""
    shards = manifest.count()
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(get_file(path))
                row = np.arange(shard.docs)
                named = len(shard.named)
                found = shard.row_of(shard.named)
                first = np.searchsorted(shard.named, shard.named)
                if not np.array_equal(found, first):
                    raise ValueError(f"{path}: the index does not lead to its documents")
                row[:named] = found + (np.arange(named) - first)
                lengths = np.diff(shard.offsets)[row]
                wide, ends = memoryview(shard.ids.astype("<u4")).cast("B"), (shard.offsets * 4).tolist()
                crc = [zlib.crc32(wide[ends[r] : ends[r + 1]]) for r in row.tolist()]
                keys = pa.array([*shard.named.tolist(), *[None] * (shard.docs - named)], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + shard.offsets[:-1][row]), pa.array(lengths), pa.array(crc, pa.int64())], names)

    spread = manifest.select("path", "start").repartition(max(1, min(shards, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), shards // 64))
    return spread.mapInArrow(run, READ)


#: A record of the directory: the last and first id of a shard and the name of its file.
RECORD, RECORD_SIZE = "<qq48s", 64


def directory(manifest: DataFrame) -> str:
    """Write the shards in order as fixed records next to them; the URI, or '' without shards.

    One record at a time passes the driver.
    """
    rows = manifest.where("first_id IS NOT NULL").orderBy("part", "seq").select("path", "first_id", "last_id")
    out = uri = None
    for r in rows.toLocalIterator():
        root, name = r["path"].rsplit("/", 1)
        if out is None:
            uri = f"{root}/directory-{uuid.uuid4().hex}"
            system, path = open_fs(uri)
            out = system.open_output_stream(path)
        last = r["last_id"] if r["last_id"] is not None else (1 << 63) - 1
        out.write(struct.pack(RECORD, last, r["first_id"], name.encode()))
    if out is not None:
        out.close()
    return uri or ""


def _shard_of(file, count: int, key: int, seen: dict[int, tuple]) -> tuple | None:
    """The record of the first shard whose ids may include the key, by bisection."""

    def at(i: int) -> tuple:
        if i not in seen:
            seen[i] = struct.unpack(RECORD, file.read_at(RECORD_SIZE, i * RECORD_SIZE))
        return seen[i]

    low, high = 0, count
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if at(middle)[0] < key else (low, middle)
    return at(low) if low < count and at(low)[1] <= key else None


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access: keys (doc_id) to (doc_id, ids array<long>), a row for each key that a shard has.

    No join: each task looks its keys up in the shared folder, so any number may ask for one shard.
    """
    uri = directory(manifest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not uri:
            return
        system, path = open_fs(uri)
        root, seen = path.rsplit("/", 1)[0], {}
        with system.open_input_file(path) as names:
            count, held, shard = names.size() // RECORD_SIZE, None, None
            for batch in batches:
                if len(seen) > 1 << 16:
                    seen = {}
                keys, ids = [], []
                for key in sorted(k for k in batch.column(0).to_pylist() if k is not None):
                    record = _shard_of(names, count, key, seen)
                    if record is None:
                        continue
                    if record[2] != held:
                        held, shard = record[2], ShardFile(system.open_input_file(f"{root}/{record[2].rstrip(bytes(1)).decode()}"))
                    found = shard.get(key)
                    if found is not None:
                        keys.append(key)
                        ids.append(found.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return keys.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_and_read(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    return read(write(docs, tokenizer_path or default_tokenizer()))
