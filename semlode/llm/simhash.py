"""SimHash near-duplicates (operator 11) with a Gray-order hierarchical index.

A fingerprint has a bit for each of the 64 bits of its text's shingle hashes, set where over half of them
have it set.  Fingerprints link where at most RADIUS bits differ; the join is exact:

1. One pass over the texts gives the fingerprints; equal ones become one node, so copies are never paired.
2. The upper nodes of the index are masked bit patterns.  The bits are cut into RADIUS + a blocks; two
   fingerprints that link agree in at least a of them, so they meet under one of the masks of a blocks.  The
   number a follows from the number of fingerprints (`masks`), so that a node has some thousand at most.
3. Under its upper node the fingerprints lie in the order of their Gray ranks, where neighbours differ little.
   Each FAN of them are a node with the bits that all share, each FAN nodes are one above.  A search goes down
   from the upper node, adds up the differences in the bits that a node adds to those of its parent, and
   leaves out whole groups beyond the radius, and groups that are already in the component of the searcher.
4. An upper node with more than TILE fingerprints, as copies with small changes make it, is dealt as tiles
   along the Gray order to any number of tasks: each is joined with itself, and with those others whose shared
   bits allow a link.
5. A task sends a tree of links for what it has found connected, never all pairs; components over these links
   are found by rounds of label exchange on written tables.

Defined cases: null and empty texts, and those of white space, have the fingerprint zero and link like any other;
fewer than SHINGLE words are one shingle; of very long texts all shingles count, some ten thousand in memory
at a time; repeated rows and ids are rows of their own; a null id takes part and counts as no id in
component_id (null if no other is reachable); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, join_heavy, materialize, release, tidy
from .jaccard import components

#: Fixed values of the contract: words of a shingle, seed of the hash, bits that may differ.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Children of a node, fingerprints of a tile, fingerprints that search at a time, shingles hashed at a time.
FAN, TILE, SLICE, HASHED = 16, 4096, 512, 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(k, len(words))
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - k + 1], ends[k - 1 :]
    hash_of, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), HASHED):
        spans = zip(starts[at : at + HASHED].tolist(), ends[at : at + HASHED].tolist())
        h = np.array([hash_of(line[a:b], seed) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    for step in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(step))
    return x


def masks(n: int, radius: int = RADIUS, tile: int = TILE) -> list[int]:
    """Masks, one of which two codes of at most `radius` differing bits agree under, for n codes.

    More blocks have to agree where there are more codes, until an upper node has `tile` of n random ones at most.
    """
    for agree in range(1, 5):
        cuts = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
        blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
        found = [sum(chosen) for chosen in combinations(blocks, agree)]
        if n >> min(m.bit_count() for m in found) <= tile:
            break
    return found


class Levels:
    """The nodes over codes that lie in groups, each in Gray order: from single codes up to one root a group."""

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        n = len(codes)
        self.low, self.high, self.first = [codes], [codes], [np.arange(n + 1)]
        while (np.diff(group) == 0).any():
            start = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
            heads = np.flatnonzero(place % FAN == 0)
            self.low.append(np.bitwise_and.reduceat(self.low[-1], heads))
            self.high.append(np.bitwise_or.reduceat(self.high[-1], heads))
            self.first.append(np.append(heads, len(group)))
            group = group[heads]
        self.groups = group
        self.shared = [~(a ^ b) for a, b in zip(self.low, self.high)]
        # The bits that a node adds to its parent's; at the top all that it has.
        self.added = [self.shared[-1]]
        for level in range(len(self.low) - 2, -1, -1):
            parent = np.repeat(np.arange(len(self.low[level + 1])), np.diff(self.first[level + 1]))
            self.added.insert(0, self.shared[level] & ~self.shared[level + 1][parent])
        self.last = [np.arange(n)]
        for first in self.first[1:]:
            self.last.append(self.last[-1][first[1:] - 1])

    def spread(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level the label that all codes under a node have, or -1."""
        out = [label]
        for first in self.first[1:]:
            low, high = np.minimum.reduceat(out[-1], first[:-1]), np.maximum.reduceat(out[-1], first[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def find(self, codes: np.ndarray, roots: np.ndarray, own: np.ndarray, label: np.ndarray, radius: int, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(searcher, code) of differences up to the radius between searchers and the codes under their roots.

        Left out are nodes whose codes all have the searcher's own label, and those up to `after`, if given.
        """
        whole = self.spread(label)
        who, node, spent = np.arange(len(codes)), roots, np.zeros(len(codes), dtype=np.uint8)
        for level in range(len(self.low) - 1, -1, -1):
            spent = spent + np.bitwise_count((codes[who] ^ self.low[level][node]) & self.added[level][node])
            keep = (spent <= radius) & (whole[level][node] != own[who])
            if after is not None:
                keep &= self.last[level][node] > after[who]
            who, node, spent = who[keep], node[keep], spent[keep]
            if level:
                first = self.first[level]
                size = first[node + 1] - first[node]
                ends = np.cumsum(size)
                child = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first[node], size)
                who, node, spent = np.repeat(who, size), child, np.repeat(spent, size)
        return who, node


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give what x and y link one label, the smallest; label leads every entry to itself or to such a one."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def within(codes: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """A label for each code, equal where links inside its group connect them; groups are runs in Gray order."""
    label, tree = np.arange(len(codes)), Levels(codes, group)
    root = np.searchsorted(tree.groups, group)
    for at in range(0, len(codes), SLICE):
        part = slice(at, at + SLICE)
        who, found = tree.find(codes[part], root[part], label[part], label, radius, np.arange(len(codes))[part])
        unite(label, who + at, found)
    return label


def across(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The same for two tiles of one group, by links from one to the other: labels of a, then of b."""
    label, tree = np.arange(len(a) + len(b)), Levels(b, np.zeros(len(b), dtype=np.int64))
    for at in range(0, len(a), SLICE):
        part = a[at : at + SLICE]
        who, found = tree.find(part, np.zeros(len(part), dtype=np.int64), label[at : at + len(part)], label[len(a) :], radius, None)
        unite(label, who + at, found + len(a))
    return label


def _tree_links(codes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return codes[label[moved]].view(np.int64), codes[moved].view(np.int64)


FOUND = "a long, b long, mask int, pattern long, tile long, low long, high long, codes binary"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _KINDS)], _NAMES)


def links(fingerprints: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE, hold: int = 1 << 16) -> DataFrame:
    """(fp), n distinct ones, to written links (a, b) whose components are those of all links."""
    chosen = np.array(masks(n, radius, tile), dtype=np.uint64)

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            rank = gray_rank(fp)
            for j, mask in enumerate(chosen):
                columns = [np.full(len(fp), j, np.int32), (fp & mask).view(np.int64), rank.view(np.int64), fp.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mask", "pattern", "rank", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups are joined as they pass, cut at each tile; a tile whose group may lie in other tiles too is also sent on."""
        tiles, edge, held, size = TaskContext.get().partitionId() << 32, None, [], 0

        def work(mask, pattern, fp, last: bool) -> tuple[list[pa.RecordBatch], int]:
            """What is found in the rows up to the last group, or to the last whole tile of the only one; their number."""
            nonlocal tiles, edge
            key = lambda i: (int(mask[i]), int(pattern[i]))
            start = np.concatenate([[0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(pattern) != 0)) + 1, [len(fp)]])
            whole = len(fp) if last else int(start[-2]) or len(fp) // tile * tile
            if not whole:
                return [], 0
            edge = edge or key(0)
            cut = np.unique(np.concatenate([start[start < whole], *[np.arange(a, min(b, whole), tile) for a, b in zip(start, start[1:]) if b - a > tile], [whole]]))
            label = within(fp[:whole], np.repeat(np.arange(len(cut) - 1), np.diff(cut)), radius)
            a, b = _tree_links(fp[:whole], label)
            out, of, sizes = [_rows(len(a), a=a, b=b)], np.searchsorted(start, cut[:-1], side="right") - 1, np.diff(start)
            # Large groups, the first and the last of the partition, and the rest of one whose first tiles have gone.
            for i in np.flatnonzero((sizes[of] > tile) | (of == 0) | (of == len(start) - 2)).tolist():
                a, b = int(cut[i]), int(cut[i + 1])
                if sizes[of[i]] > tile or key(a) == edge or (last and of[i] == len(start) - 2):
                    low, high = (np.array([f.reduce(fp[a:b])]).view(np.int64) for f in (np.bitwise_and, np.bitwise_or))
                    out.append(_rows(1, mask=[mask[a]], pattern=[pattern[a]], tile=[tiles], low=low, high=high, codes=[fp[a:b].tobytes()]))
                    tiles += 1
            if len(start) == 2 and not last:
                edge = key(0)
            return out, whole

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy().view(np.uint64)))
            size += batch.num_rows
            if size >= hold:
                columns = [np.concatenate(c) for c in zip(*held)]
                out, done = work(*columns, False)
                yield from out
                held, size = [tuple(c[done:] for c in columns)], size - done
        if size:
            yield from work(*[np.concatenate(c) for c in zip(*held)], True)[0]

    ranged = fingerprints.mapInArrow(under, "mask int, pattern long, rank long, fp long").repartitionByRange("mask", "pattern", "rank").sortWithinPartitions("mask", "pattern", "rank")
    found = materialize(ranged.mapInArrow(tidy(search), FOUND), "simhash-found")
    tiles = found.where("codes IS NOT NULL")
    sides = [tiles.select("mask", "pattern", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "low", "high")]) for s in "xy"]
    shared = lambda s: F.bitwise_not(F.col(f"low_{s}").bitwiseXOR(F.col(f"high_{s}")))
    apart = F.bit_count(F.col("low_x").bitwiseXOR(F.col("low_y")).bitwiseAND(shared("x")).bitwiseAND(shared("y")))
    pairs = sides[0].join(sides[1], ["mask", "pattern"]).where((F.col("tile_x") < F.col("tile_y")) & (apart <= radius)).select("tile_x", "tile_y")
    codes = lambda s: tiles.select(F.col("tile").alias(f"tile_{s}"), F.col("codes").alias(f"codes_{s}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                a, b = _tree_links(np.concatenate([x, y]), across(x, y, radius))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = materialize(pairs, "simhash-pairs").join(codes("x"), "tile_x").join(codes("y"), "tile_y").select("codes_x", "codes_y")
    return materialize(found.where("a IS NOT NULL").select("a", "b").unionByName(met.mapInArrow(tidy(compare), "a long, b long")).distinct(), "simhash-links")


def join(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, text) to doc_id, fp (long), component_id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), k) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(chosen.mapInArrow(tidy(read), "doc_id long, fp long"), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-nodes")
    found = links(nodes.select("fp"), nodes.count(), radius, tile)
    comps = components(nodes, found).select(F.col("node").alias("fp"), "comp")
    smallest = nodes.join(comps, "fp").groupBy("comp").agg(F.min("doc").alias("least"))
    labels = materialize(nodes.join(comps, "fp", "left"), "simhash-labels")
    linked = join_heavy(labels.where("comp IS NOT NULL"), smallest, "comp").select("fp", F.col("least").alias("component_id"))
    own = materialize(linked.unionByName(labels.where("comp IS NULL").select("fp", F.col("doc").alias("component_id"))), "simhash-own")
    discard(found, nodes, labels)
    release(docs.sparkSession)
    return join_heavy(rows, own, "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return join(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
