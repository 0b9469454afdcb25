"""Periodic run detection (operator 13): blocks of powers of two, matched by an automaton over word numbers.

A run is a stretch of words with smallest period q, at least max(LEAST, EXPONENT * q) long, that cannot be
extended with that period.  For each text, from small to large scales B (powers of two), periods B <= q < 2B
are looked for:

1. In such a run every word but the first q has the same word at most q places before.  Stretches of 3B words
   whose nearest earlier copies are all less than 2B away are the only places where it can be; most texts have
   none.  Those inside a run that is known already have no other.
2. The aligned blocks of B words there are the keys, as sequences of word numbers, of an Aho-Corasick
   automaton, which runs over the same words.  A run has a whole aligned block near its beginning, and finds
   it again q later; at each occurrence there is one aligned block at a distance between B and 2B.
3. Such a pair is extended word by word to both sides.  The stretch is a run if it is long enough and no
   divisor of q is a period; pairs inside a known run or stretch of that period give nothing new.

Each step is exact, and a text takes about its length times the logarithm of its length.

Defined cases: null and empty texts and those of white space have no words and no runs; of very long texts
all words are searched (memory grows with one text; an automaton has a window of some 65,000 words or eight
blocks); rows that repeat are rows of their own, with or without an id; ties of the longest run go to the first
start, then the smaller period; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import tidy
from ._text import buffers, chunks

#: Fixed bounds of the contract: words of a run at least, and periods.
LEAST, EXPONENT = 6, 4
#: Words of an automaton, at least.
WINDOW = 1 << 16


def extent(words: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest stretch around words[at], which equals words[at + q], with period q."""

    def steps(ahead: bool) -> int:
        """How many further pairs are equal on one side."""
        size, gone = 64, 0
        while True:
            if ahead:
                a, b = words[at + gone : at + gone + size], words[at + q + gone : at + q + gone + size]
                a = a[: len(b)]
            else:
                end = at - gone
                begin = max(0, end - size)
                a, b = words[begin:end][::-1], words[begin + q : end + q][::-1]
            other = np.flatnonzero(a != b)
            if len(other):
                return gone + int(other[0])
            gone += len(a)
            if len(a) < size:
                return gone
            size = min(2 * size, 1 << 16)

    return at - steps(False), at + q + steps(True)


def _primes(q: int) -> Iterator[int]:
    p = 2
    while p * p <= q:
        if q % p == 0:
            yield p
            while q % p == 0:
                q //= p
        p += 1
    if q > 1:
        yield q


def primitive(words: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of q is a period of the stretch from start, which has period q and is two of them long."""
    root = words[start : start + q]
    return not any(np.array_equal(root[q // p :], root[: q - q // p]) for p in _primes(q))


def seeds(words: np.ndarray, low: int, high: int, block: int, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(place of an aligned block, place of its copy) between low and high, block to 2 * block - 1 apart."""
    window = max(window, 8 * block)
    for begin in range(low, high, window - 3 * block):
        end = min(begin + window, high)
        keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        line, kind, names = tuple(words[begin:end].tolist()), {}, {}
        for at in range(-(-begin // block) * block, end - block + 1, block):
            key = line[at - begin : at - begin + block]
            kind[at] = names.setdefault(key, len(names))
        for key, name in names.items():
            keys.add_word(key, name)
        if not names:
            continue
        keys.make_automaton()
        get = kind.get
        for last, name in keys.iter(line):
            place = begin + last - block + 1
            at = (place - block) // block * block
            if get(at) == name:
                yield at, place
        if end == high:
            return


def find_runs(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one text, given as numbers of words, by start and period."""
    n = len(words)
    if n < least:
        return []
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    back = np.full(n, n, dtype=np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    out: set[tuple[int, int, int]] = set()
    cover = None  # of each place the last end of a run over it
    far, block = np.arange(n), 1
    while exponent * block <= n:
        far = far[back[far] >= 2 * block]
        for i in np.flatnonzero(np.diff(far, append=n) > (exponent - 1) * block).tolist():
            first, high = int(far[i]) + 1, int(far[i + 1]) if i + 1 < len(far) else n
            if cover is not None and cover[first] >= high:
                continue
            tried: dict[int, int] = {}
            for at, place in seeds(words, max(0, first - 2 * block + 1), high, block, window):
                q, end = place - at, place + block
                if (cover is not None and end <= cover[at]) or end <= tried.get(q, -1):
                    continue
                start, stop = extent(words, at, q)
                tried[q] = stop
                if stop - start >= max(least, exponent * q) and primitive(words, start, q):
                    out.add((start, stop - start, q))
                    cover = np.zeros(n, dtype=np.int64) if cover is None else cover
                    cover[start:stop] = np.maximum(cover[start:stop], stop)
        block *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def may_repeat(words: np.ndarray, edges: np.ndarray, exponent: int = EXPONENT) -> np.ndarray:
    """Of texts whose words (numbers, other ones in each text) follow each other: whether step 1 leaves a place."""
    n, out = len(words), np.zeros(len(edges) - 1, dtype=bool)
    order = np.argsort(words, kind="stable")
    back = np.full(n, n + 1, dtype=np.int64)
    same = words[order[1:]] == words[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    far, block = np.arange(n), 1
    while exponent * block <= n and len(far):
        far = far[back[far] >= 2 * block]
        found = far[np.diff(far, append=n) > (exponent - 1) * block]
        out[np.searchsorted(edges, found, side="right") - 1] = True
        block *= 2
    return out


#: (id, words) to the words that are looked at instead.
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def runs(docs: DataFrame, rewrite: Rewrite | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, text) to doc_id, runs array<struct<start, length, period>>, collapsed: the words that are kept.

    A word goes if a run has it after its first period.
    """
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets, 1 << 19):
                ids, found, kept, texts, numbers, base = batch.column(0).slice(i, j - i), [], [], [], [], 0
                for doc_id, text in zip(ids.to_pylist(), batch.column(1).slice(i, j - i).to_pylist()):
                    words = (text or "").encode().split()
                    words = rewrite(doc_id, words) if rewrite else words
                    index = {w: base + k for k, w in enumerate(dict.fromkeys(words))}
                    base += len(index)
                    texts.append(words)
                    numbers.append(np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)))
                edges = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
                maybe = may_repeat(np.concatenate(numbers), edges, exponent)
                for words, own, look in zip(texts, numbers, maybe.tolist()):
                    got = find_runs(own, least, exponent) if look else []
                    if got:
                        keep = np.ones(len(words), dtype=bool)
                        for start, length, q in got:
                            keep[start + q : start + length] = False
                        words = [words[k] for k in np.flatnonzero(keep).tolist()]
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(tidy(read), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change: one text in ten, by the CRC of its id, repeats a part of itself to its end."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def longest(found: Column) -> Column:
    """The run with the greatest length, of ties the first, then that with the smallest period."""
    return F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns, digests of the runs and texts that `runs` gives."""
    best = longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = runs(docs, looped).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.less")
    return found.select("doc_id", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
