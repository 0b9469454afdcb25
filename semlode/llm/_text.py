"""Words and their 64-bit hashes for many texts at once, with numpy over Arrow's buffers."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words without space, tab and the other ASCII line and page breaks.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words of digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.full(max(n, 1 << 20), _P if kind == "up" else _P_INV, dtype=np.uint64)
        base[0] = 1
        _powers[kind] = have = np.multiply.accumulate(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sums: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges of texts of at most `limit` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> Words:
    """The words of texts that follow each other in data; ASCII letters are lower-cased."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return Words(z, z, z, np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.uint64))
    low = LOWER[data]
    inside = keep[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[0] = inside[0]
    edge[n] = inside[-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    starts_at, ends_at = edge[:n] & inside, np.zeros(n + 1, dtype=bool)
    ends_at[1:] = edge[1:] & inside
    starts_at[cut] = inside[cut]
    ends_at[cut] = inside[cut - 1]
    start, end = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    doc = np.searchsorted(offsets, start, side="right") - 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * _power("up", n), out=sums[1:])
    return Words(doc, start, end, span_hash(sums, start, end), sums)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, the same wherever they stand."""
    raw = (sums[end] - sums[start]) * _power("down", len(sums))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sequence_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words, by its first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, length * 0x632BE59BD9B4E019 & _MASK, dtype=np.uint64)
    for k in range(length):
        out = mix(out + words[k : k + n])
    return out


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of given lower-case words, as words_of has them."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    raw = [w.encode("utf-8") for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * _power("up", len(data)), out=sums[1:])
    return span_hash(sums, offsets[:-1], offsets[1:])
