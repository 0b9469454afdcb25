"""N-gram Jaccard join (operator 3) with set-relation skipping.

A document's set is its distinct 3-word shingles; documents link where the Jaccard coefficient is at least
90 % (both are parameters, the pipeline has others).  The join is exact (up to collisions of 64-bit hashes):

1. One pass over the texts gives each set's size and 128-bit signature, and a fixed-size table of how often
   shingles occur, by bucket.  Equal sets become one node, so copies are never paired.
2. The shingles of a set are ordered from rare to common buckets (any fixed order is correct, this one
   keeps lists short).  Sets that link share one of the first n - ceil(0.9 n) + 1: an index list for each.
   Of lists with the same sets (by length, sum of sizes and 128 bits of hashes) only the first is kept.
3. In each list every set meets one hub only.  These pairs are verified, and what is linked is one component.
4. Lists that still have several components are cut into blocks by size and by position.  A probe skips
   whole blocks by the length and positional bounds, or where all of a block is in its own component, and
   derives bounds for its overlap with an entry from the overlaps that both have with the same hub
   (answers of a highly similar set); what the bounds do not decide is verified.

Before it is verified, a pair must pass a bound from the parities of shingles by bucket, about a bit a
shingle.  Verification reads only the texts of candidates again; a fixed-size bit table picks them out.
No key that a hub or a component has in common is a key of an aggregation: what is known of a hub travels
with its lists, long lists are dealt by parts, and joins on such keys are followed by another exchange, so
that adaptive execution may split them.

Defined cases: null and empty texts have n_shingles 0 and are linked with nothing, themselves in their own
component; rows with one id and different texts are sets of their own, and each row is returned; a null id
takes part, and counts as no id in component_id (null if nothing else is reachable); empty tables give
empty results; other columns are ignored.  Memory grows with one text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import blocks_of, discard, materialize, merge_blocks, prefix_for, release, tidy
from ._text import NOT_SPACE, buffers, chunks, mix, sequence_hash, words_of

#: Fixed bounds of the contract, as num / den.
NUM, DEN, SHINGLE = 90, 100, 3
#: Entries of a block of an index list, blocks of a part of a long list, and sets of a group that meet one set, about.
BLOCK, PART, GROUP = 64, 64, 128
#: Sizes of the tables that are broadcast, whatever the input.
SKETCH_BITS, SKETCH_ROWS = 20, 1 << 14
PICK_BITS, PICK_ROWS = 26, 1 << 17


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    n = len(offsets) - 1
    words = words_of(data, offsets, NOT_SPACE)
    edge = np.searchsorted(words.doc, np.arange(n + 1))
    runs = sequence_hash(words.hash, k)
    out = []
    for d in range(n):
        a, b = int(edge[d]), int(edge[d + 1])
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(sequence_hash(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def parity(shingles: np.ndarray) -> bytes:
    """One bit a bucket, as many buckets as a power of two from the size: whether it holds an odd number of shingles.

    Two sets differ in at least as many shingles as their parities have different bits.
    """
    size = max(64, 1 << int(len(shingles) - 1).bit_length())
    at = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1).tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = buffers(texts)
    for i, j in chunks(offsets):
        for d, s in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)):
            yield i + d, s


def survey(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, sig) of every row, and the counts of all shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(1 << SKETCH_BITS, dtype=np.int64), []
        for batch in batches:
            sizes, signs = [], []
            for _, s in _sets(batch.column(1), k):
                sizes.append(len(s))
                signs.append(signature(s) if len(s) else None)
                held.append(bucket(s))
                if len(held) >= 4096:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held = []
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "n", "sig", "block", "blob"])
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        for b, blob in blocks_of(counts.clip(0, 2**32 - 1).astype(np.uint32), SKETCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["doc_id", "n", "sig", "block", "blob"])

    seen = materialize(docs.mapInArrow(tidy(run), "doc_id long, n long, sig binary, block int, blob binary"), "jaccard-survey")
    counts = merge_blocks(seen.where("block IS NOT NULL"), "uint32", 1 << SKETCH_BITS, SKETCH_ROWS, "sum")
    return seen.where("block IS NULL").select("doc_id", "n", "sig"), counts


def index_nodes(docs: DataFrame, counts: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """One row a distinct set: node, sig, doc (the smallest id that has it), n, prefix (binary, rare shingles first), parity."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 4 MB at any size of input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in batches:
            ids, sizes, signs, prefixes, odd = [], [], [], [], []
            for d, s in _sets(batch.column(1), k):
                if len(s):
                    take = prefix_length(len(s), num, den)
                    order = np.lexsort((s, rare[bucket(s)]))[:take]
                    ids.append(d)
                    sizes.append(len(s))
                    signs.append(signature(s))
                    prefixes.append(s[order].tobytes())
                    odd.append(parity(s))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (signs, prefixes, odd)]], ["doc", "n", "sig", "prefix", "parity"])

    each = docs.mapInArrow(tidy(run), "doc long, n long, sig binary, prefix binary, parity binary")
    nodes = each.groupBy("sig").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", "prefix", "parity")])
    return materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")


def postings(nodes: DataFrame, only=None) -> DataFrame:
    """(token, node, n, pos) for every prefix shingle; only: a broadcast bit table of the tokens to give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 200_000 * batch.num_rows // max(1, batch.column(2).nbytes // 8))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                runs = [np.frombuffer(p.as_py(), dtype=np.int64) for p in part.column(2)]
                size = np.array([len(r) for r in runs])
                ends = np.cumsum(size)
                token = np.concatenate(runs)
                columns = [token, np.repeat(part.column(0).to_numpy(), size), np.repeat(part.column(1).to_numpy(), size), (np.arange(ends[-1]) - np.repeat(ends - size, size)).astype(np.int64)]
                if only is not None:
                    h = pick_hash(token)
                    keep = only.value[h >> 3] >> (h & 7).astype(np.uint8) & 1 > 0
                    columns = [c[keep] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "pos"])

    return nodes.select("node", "n", "prefix").mapInArrow(tidy(run), "token long, node long, n long, pos long")


def pick_hash(values: np.ndarray) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PICK_BITS)).astype(np.int64)


def _longs(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def bit_table(values: DataFrame):
    """A broadcast table of 2^PICK_BITS bits (8 MB at any size) with those of one column of longs set.

    It only saves work: what it lets through by chance is dropped by a join.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (PICK_BITS - 3), dtype=np.uint8)
        for batch in batches:
            h = pick_hash(_longs(batch.column(0)))
            np.bitwise_or.at(bits, h >> 3, np.uint8(1) << (h & 7).astype(np.uint8))
        for b, blob in blocks_of(bits, PICK_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["block", "blob"])

    return values.sparkSession.sparkContext.broadcast(merge_blocks(values.mapInArrow(tidy(mark), "block int, blob binary"), "uint8", 1 << (PICK_BITS - 3), PICK_ROWS, "or"))


def index_lists(nodes: DataFrame) -> DataFrame:
    """(token, node, n, pos, hub, hub_pos, n_hub) of the lists that are needed.

    A list of one node has no pairs.  Of lists with the same nodes, the one that comes first in the order
    of shingles is enough: the first shingle that two sets share is the first of its class.  Lists are
    compared by length, sum of sizes and the exclusive or of two hashes of nodes.  The hub of a list is the set
    that has the shingle earliest (positions from 1023 on count alike), so with the fewest rarer shingles of its own.
    """
    rank = F.shiftleft(F.least("pos", F.lit(1023)).cast("long"), 53).bitwiseOR(F.col("node"))
    best = postings(nodes).groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(rank).alias("rank"), F.bit_xor(F.xxhash64("node")).alias("members"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("others"), F.sum("n").alias("sizes"), F.sum("pos").alias("places")).where("c > 1")
    one = best.groupBy("c", "members", "others", "sizes").agg(F.min(F.struct("places", "token", "rank")).alias("first")).select("first.token", "first.rank")
    one = one.select("token", F.col("rank").bitwiseAND((1 << 53) - 1).alias("hub"), F.shiftrightunsigned("rank", 53).alias("hub_pos"))
    # A set is the hub of no more lists than it has shingles in its prefix.
    one = materialize(one.join(nodes.select(F.col("node").alias("hub"), F.col("n").alias("n_hub")), "hub"), "jaccard-tokens")
    release(nodes.sparkSession)
    found = postings(nodes, bit_table(one.select("token"))).join(one, "token")
    lists = materialize(found.select("token", "node", "n", "pos", "hub", "hub_pos", "n_hub"), "jaccard-lists")
    discard(one)
    return lists


def likely(nodes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose parities allow a link, with n, sig and doc of both."""
    of = nodes.select("node", F.struct("n", "sig", "doc", "parity").alias("of"))
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).join(of, "node")
    both = ends.groupBy("a", "b").agg(F.max(F.when(F.col("node") == F.col("a"), F.col("of"))).alias("x"), F.max(F.when(F.col("node") == F.col("b"), F.col("of"))).alias("y"))
    flat = both.select("a", "b", *[F.col(f"{s}.{c}").alias(f"{c}_{t}") for s, t in (("x", "a"), ("y", "b")) for c in ("n", "sig", "doc", "parity")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c) for c in ("parity_a", "parity_b", "n_a", "n_b"))
            keep = [(num + den) * parity_distance(x.as_py(), y.as_py()) <= (den - num) * (m + n) for x, y, m, n in zip(a, b, n_a.to_pylist(), n_b.to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return materialize(flat.mapInArrow(tidy(run), flat.schema).drop("parity_a", "parity_b"), "jaccard-likely")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) to (a, b, n_a, n_b, overlap, linked), from the whole sets of both where their parities allow a link.

    The sets of candidates are read from the texts, and each is sent to those a that it is compared with.
    An a with many is sent to several groups of at most about GROUP.  In its group the set of a comes first
    and the others pass by, so a task holds two sets at a time.
    """
    pairs = likely(nodes, pairs, num, den)
    # Written, so that in the joins with it a set with many pairs may be split.
    groups = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")), "jaccard-groups")
    member = pairs.join(groups, "a").select(F.col("sig_b").alias("sig"), F.col("doc_b").alias("doc"), F.struct("a", F.pmod(F.xxhash64("b"), "groups").alias("part"), F.lit(1).alias("role"), F.col("b").alias("node"), F.col("n_b").alias("n")).alias("to"))
    asked = pairs.groupBy("a").agg(F.first("sig_a").alias("sig"), F.first("doc_a").alias("doc"), F.first("n_a").alias("n")).join(groups, "a")
    asked = asked.select("sig", "doc", "a", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part")).select("sig", "doc", F.struct("a", "part", F.lit(0).alias("role"), F.col("a").alias("node"), "n").alias("to"))
    routes = materialize(member.unionByName(asked), "jaccard-routes")
    picked = bit_table(routes.select("doc"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = picked.value
        for batch in batches:
            h = pick_hash(_longs(batch.column(0)))
            keep = np.flatnonzero(bits[h >> 3] >> (h & 7).astype(np.uint8) & 1)
            if not len(keep):
                continue
            part = batch.take(pa.array(keep))
            where, signs, blobs = [], [], []
            for d, s in _sets(part.column(1), k):
                if len(s):
                    where.append(d)
                    signs.append(signature(s))
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where, pa.int64())), pa.array(signs, pa.binary()), pa.array(blobs, pa.binary())], ["d", "s", "shingles"])

    sets = docs.mapInArrow(tidy(read), "d long, s binary, shingles binary").join(routes, (F.col("s") == F.col("sig")) & F.col("d").eqNullSafe(F.col("doc")))
    sent = sets.select("to.*", "shingles").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n_a, hub = None, 0, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, part, role, node, n, blob in zip(*[c.to_pylist() for c in batch.columns[:5]], batch.column(5)):
                shingles = np.frombuffer(blob.as_py(), np.uint64)
                if role == 0:
                    place, n_a, hub = (a, part), n, shingles
                elif place != (a, part):
                    raise ValueError("a set to compare with is missing")
                else:
                    out.append((a, node, n_a, n, len(np.intersect1d(hub, shingles, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], ["a", "b", "n_a", "n_b", "overlap"])

    done = sent.mapInArrow(tidy(compare), "a long, b long, n_a long, n_b long, overlap long").distinct()
    out = materialize(done.withColumn("linked", linked(F.col("overlap"), F.col("n_a"), F.col("n_b"), num, den)), "jaccard-verified")
    discard(pairs, routes, groups)
    release(docs.sparkSession)
    return out


def linked(overlap, n_a, n_b, num: int, den: int):
    return den * overlap >= num * (n_a + n_b - overlap)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node) and (a, b) to (node, comp), written: the smallest node reachable, for nodes that have links.

    Every round a node takes the smallest label around it and then its label's label; each round is a
    table in the shared folder, and the driver sees only whether anything changed.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        # Written, so that the join on the label that most of a large component has may be split.
        met = materialize(labels.join(near, "node").select("node", F.least("comp", "other").alias("next"), F.col("comp").alias("was")), "cc-met")
        jump = met.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = materialize(met.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("comp"), "was"), "cc-labels")
        discard(labels, met)
        labels = moved
        if moved.where("comp <> was").isEmpty():
            discard(edges)
            return labels


def remaining_pairs(lists: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates between components: (a, b), with a < b, that no bound of step 4 decides."""
    entries = lists.join(info, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    every = entries = materialize(entries.select("token", "node", "n", "pos", "comp", "via", "shared"), "jaccard-entries")
    open_lists = entries.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("length")).where("low <> high").select("token", "length")
    open_lists = materialize(open_lists, "jaccard-lengths")
    entries = materialize(entries.join(open_lists, "token"), "jaccard-open")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("length") / BLOCK))
    size_block = lambda n: F.floor(F.log2(n) * 4)
    blocks = entries.groupBy("token", F.floor(chunk / PART).alias("part"), size_block(F.col("n")).alias("size_block"), F.floor(F.log2(F.col("pos") + 1)).alias("pos_block"), chunk.alias("chunk")).agg(
        F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.min("pos").alias("pos_low"), F.max(F.col("n") - F.col("pos")).alias("rest_high"), F.min("comp").alias("c_low"), F.max("comp").alias("c_high"),
        F.collect_list(F.struct("node", "n", "pos", "comp", "via", "shared")).alias("rows"),
    )
    # Probes p (the larger set, or the later node of equal sets) against blocks: an upper bound of the overlap must reach num / (num + den) of both sizes.
    p = {c: F.col(f"p_{c}") for c in ("node", "n", "pos", "comp", "via", "shared")}
    # A probe looks at the blocks of sizes that a link allows, in every part of its list: a task has one part.
    sizes = F.sequence(size_block(F.col("n") * (num / den - 1e-9)), size_block(F.col("n")))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.ceil(F.col("length") / BLOCK) - 1) / PART))
    probe = entries.select("token", F.explode(parts).alias("part"), sizes.alias("sizes"), *[F.col(c).alias(f"p_{c}") for c in p])
    probe = probe.withColumn("size_block", F.explode("sizes")).drop("sizes")
    block_ok = (
        (F.col("n_high") * den >= p["n"] * num)
        & (F.col("n_low") <= p["n"])
        & ((den + num) * F.least(p["n"] - p["pos"], F.col("rest_high")) >= num * (p["n"] + F.col("n_low")))
        & ((F.col("c_low") != p["comp"]) | (F.col("c_high") != p["comp"]))
    )

    def entry_ok(e):
        need = num * (p["n"] + e["n"])
        same_hub = e["via"] == p["via"]
        derived = F.least(p["shared"], e["shared"]) + F.least(p["n"] - p["shared"], e["n"] - e["shared"])
        return (
            (e["comp"] != p["comp"])
            & ((e["n"] < p["n"]) | ((e["n"] == p["n"]) & (e["node"] < p["node"])))
            & (e["n"] * den >= p["n"] * num)
            & ((den + num) * F.least(p["n"] - p["pos"], e["n"] - e["pos"]) >= need)
            & F.coalesce(~same_hub | ((den + num) * derived >= need), F.lit(True))
        )

    met = probe.join(blocks, ["token", "part", "size_block"]).where(block_ok).select(F.col("p_node").alias("x"), F.filter("rows", entry_ok).alias("rows")).where(F.size("rows") > 0)
    found = met.select("x", F.explode("rows.node").alias("y"))
    rest = materialize(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "jaccard-rest")
    discard(every, entries, open_lists)
    return rest


def join(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id, n_links (verified links of its set to other sets that were needed)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, counts = survey(docs, k)
    nodes = index_nodes(docs, counts, k, num, den)
    release(docs.sparkSession)
    lists = index_lists(nodes)
    met = lists.where("node <> hub")
    both = F.col("n") + F.col("n_hub")
    met = met.where((num + den) * F.least(F.col("n") - F.col("pos"), F.col("n_hub") - F.col("hub_pos"), "n", "n_hub") >= num * both)
    star = met.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("votes")).groupBy("node").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub"))
    star = materialize(star.select(F.col("hub").alias("a"), F.col("node").alias("b")), "jaccard-star")
    first = verify(docs, nodes, star, k, num, den)
    comps = components(nodes, first.where("linked"))
    near = comps.select("node", "comp")
    known = first.select(F.col("b").alias("node"), F.col("a").alias("via"), F.col("overlap").alias("shared"))
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = remaining_pairs(lists, known.join(near, "node", "full"), num, den)
    discard(lists, star)
    second = verify(docs, nodes, rest.join(tested, ["a", "b"], "left_anti"), k, num, den)
    links = first.where("linked").select("a", "b").unionByName(second.where("linked").select("a", "b")).distinct()
    links = materialize(links, "jaccard-links")
    discard(first, second, comps)
    comps = components(nodes, links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    full = nodes.select("node", "sig", "doc").join(comps.select("node", "comp"), "node", "left").join(degree, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = full.groupBy("comp").agg(F.min("doc").alias("component_id"))
    answer = materialize(full.join(smallest, "comp").select("sig", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "jaccard-answer")
    discard(nodes, links, comps)
    joined = rows.join(answer, "sig", "left")
    own = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One document of each group stays: that with the least id; rows without words or id stay.

    Rows are told apart by a 64-bit hash of id and text: rows of one id with other texts go or stay with
    their own groups, and of rows with the same id and text one stays.
    """
    p = prefix_for(docs, "group")
    key, of = F.xxhash64(F.col("doc_id").cast("long"), "text"), F.col(f"{p}_key")
    ids = docs.where("doc_id IS NOT NULL").select(key.alias("key"), F.col("doc_id").cast("long").alias("id")).groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    groups = join(docs.select(key.alias("doc_id"), "text"), k, num, den).where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct()
    members = materialize(ids.join(groups, "key"), "jaccard-members")
    first = members.groupBy("group").agg(F.min(F.struct("id", "key")).alias("first")).select(F.col("first.key").alias(f"{p}_key"))
    members = members.select(F.col("key").alias(f"{p}_key"), "rows")
    gone = members.join(first, f"{p}_key", "left_anti").select(f"{p}_key")
    again = members.where("rows > 1").select(f"{p}_key")
    if again.isEmpty():
        return docs.join(gone, key == of, "left_anti")
    once = docs.join(again.join(first, f"{p}_key", "left_semi"), key == of).dropDuplicates([f"{p}_key"]).drop(f"{p}_key")
    return docs.join(gone.unionByName(again).distinct(), key == of, "left_anti").unionByName(once)


#: The contract's 3 words and 90 % in DuckDB's SQL, for tables of some thousand documents: it names every linked pair.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)),
r AS (SELECT x, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, coalesce(min(root), doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = doc_id GROUP BY doc_id"""
