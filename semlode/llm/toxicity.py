"""Toxicity (operator 6): a linear-chain conditional random field.

Labels are given for documents, so the tokens of the sample are labelled first, each from the documents of
the other half of the sample: a token of a toxic document is toxic where its word occurs in far more toxic
than clean documents of the other half.  The field (two states; word, beginnings, shape with beginning, and
the words before and after) is fitted to these token labels by its exact likelihood.  Forward-backward
marginals tag spans, and a logistic regression of their sums gives the document's score.

Training reads a bounded sample of labelled rows (`max_rows`, by a hash of the id), whole texts of them, on
the executors; the driver gets counts of features and the places of known ones.  Scoring reads whole texts:
tokens without any known feature all look alike, so a run of them is one matrix power, and messages are
passed between the others only.

Defined cases: null and empty texts have the score of no evidence; null labels are not learned from; without
labels of both kinds the score is constant; documents that repeat have equal scores, and of those that share
an id the first text is learned from; labels that repeat count as often as they repeat; equal evidence keeps
all features that have it; empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize
from ._text import ALNUM, buffers, chunks, mix, span_hash, words_of
from .quality import held_out, sample_labels

#: Lengths in bytes of the beginnings of words that are features; 0 is the whole word.
BEGINNINGS = (0, 3, 4, 5, 6, 7, 8)
#: Kinds of features: the beginnings, the shape with the first three bytes, and the words before and after.
KINDS = len(BEGINNINGS) + 3
#: A feature speaks for toxic documents with so many of them, so many times the clean ones, and this z of its log-odds.
LEAST, TIMES, EVIDENCE = 3, 4, 2.5


class Field(NamedTuple):
    """Weights of a two-state chain and of the document score."""

    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # log-odds of "toxic" that each adds
    bias: float
    trans: np.ndarray  # 2 x 2 log weights
    doc: np.ndarray  # bias, then weights of DOC_STATS


DOC_STATS = 4


def token_features(words) -> np.ndarray:
    """One hash for each token and kind of feature; 0 where a token has none of it."""
    n = len(words.start)
    out = np.zeros((n, KINDS), dtype=np.uint64)
    size = words.end - words.start

    def put(kind: int, h: np.ndarray, has: np.ndarray) -> None:
        out[:, kind] = np.where(has, (h << np.uint64(4)) | np.uint64(kind + 1), 0)

    for k, length in enumerate(BEGINNINGS):
        put(k, words.hash if length == 0 else span_hash(words.sums, words.start, np.minimum(words.start + length, words.end)), (length == 0) | (size > length))
    beginning = span_hash(words.sums, words.start, np.minimum(words.start + 3, words.end))
    put(KINDS - 3, mix(beginning + np.minimum(size, 15).astype(np.uint64)), size > 3)
    if n > 1:
        beside, none = words.doc[1:] == words.doc[:-1], np.zeros(1, dtype=bool)
        put(KINDS - 2, np.concatenate([words.hash[:1], words.hash[:-1]]), np.concatenate([none, beside]))
        put(KINDS - 1, np.concatenate([words.hash[1:], words.hash[:1]]), np.concatenate([beside, none]))
    return out


def matrices(field: Field, emission: np.ndarray) -> np.ndarray:
    """For each token the 2 x 2 step: exp(transition) times exp(emission of the state entered)."""
    step = np.exp(field.trans)[None, :, :].repeat(len(emission), axis=0)
    step[:, :, 1] *= np.exp(emission)[:, None]
    return step


def marginals(field: Field, emission: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """P(toxic) of the active tokens of one text.

    gaps[i]: background tokens before active token i; gaps[-1]: those after the last.  The background is
    passed by powers of one matrix, so this is forward-backward over the whole text.
    """
    n = len(emission)
    plain = matrices(field, np.array([field.bias]))[0]
    value, vectors = np.linalg.eig(plain)
    inverse = np.linalg.inv(vectors)
    top = np.abs(value).max()

    def power(k: int) -> np.ndarray:
        return ((vectors * (value / top) ** k) @ inverse).real

    steps = matrices(field, emission)
    forward = np.zeros((n, 2))
    state = np.array([1.0, 0.0])
    for i in range(n):
        state = state @ power(gaps[i]) @ steps[i]
        state = np.maximum(state, 0) / max(state.sum(), 1e-300)
        forward[i] = state
    out, back = np.zeros(n), power(gaps[n]) @ np.ones(2)
    for i in range(n - 1, -1, -1):
        back = back / max(back.sum(), 1e-300)
        joint = np.maximum(forward[i] * back, 0)
        out[i] = joint[1] / max(joint.sum(), 1e-300)
        back = power(gaps[i]) @ (steps[i] @ back)
    return out


def _active(field: Field, words, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, emission) of the tokens with any known feature."""
    if not len(field.features) or not len(features):
        return np.zeros(0, np.int64), np.zeros(0)
    known, at = _found(field.features, features)
    place = np.flatnonzero(known.any(axis=1))
    return place, field.bias + np.where(known[place], field.weights[at[place]], 0.0).sum(axis=1)


def tag(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """(start, end, P(toxic)) in bytes of the active tokens of each text."""
    n = len(offsets) - 1
    words = words_of(data, offsets, ALNUM)
    place, emission = _active(field, words, token_features(words))
    first = np.searchsorted(words.doc, np.arange(n + 1))
    edge = np.searchsorted(place, first)
    out = []
    for d in range(n):
        here = place[edge[d] : edge[d + 1]]
        if not len(here):
            out.append([])
            continue
        gaps = np.diff(np.concatenate([[first[d] - 1], here, [first[d + 1]]])) - 1
        p = marginals(field, emission[edge[d] : edge[d + 1]], gaps)
        out.append(list(zip((words.start[here] - offsets[d]).tolist(), (words.end[here] - offsets[d]).tolist(), p.tolist())))
    return out


def document_stats(spans: list[tuple[int, int, float]]) -> list[float]:
    p = np.array([s[2] for s in spans])
    if not len(p):
        return [0.0] * DOC_STATS
    return [float(np.log1p(p.sum())), float(p.max()), float(p.max() > 0.5), float(min((p > 0.5).sum(), 3)) / 3]


class Run(NamedTuple):
    """Tokens that follow each other in a document: (token, feature) pairs of the known features, labels, and how often it counts."""

    pairs: np.ndarray
    labels: np.ndarray
    weight: float


def runs_of(places: np.ndarray, pairs: np.ndarray, labels: np.ndarray, n: int, apart: int = 20) -> tuple[list[Run], int]:
    """The runs of one document of n tokens around its active tokens, and how many tokens are in none.

    Background of more than `apart` tokens ends a run, half of it on either side stays with the runs.
    """
    out, used = [], 0
    cuts = np.flatnonzero(np.diff(places) > apart) + 1
    for part in np.split(np.arange(len(places)), cuts):
        if not len(part):
            continue
        low, high = max(0, places[part[0]] - apart // 2), min(n, places[part[-1]] + apart // 2 + 1)
        mine = pairs[np.searchsorted(pairs[:, 0], part[0]) : np.searchsorted(pairs[:, 0], part[-1], side="right")]
        said = np.zeros(high - low, dtype=np.int8)
        said[places[part] - low] = labels[part]
        out.append(Run(np.stack([places[mine[:, 0]] - low, mine[:, 1]], axis=1), said, 1.0))
        used += high - low
    return out, n - used


class _Group:
    """Runs of similar length, side by side."""

    def __init__(self, runs: list[Run]) -> None:
        n, length = len(runs), max(len(r.labels) for r in runs)
        self.y = np.zeros((length, n), dtype=np.int8)
        self.on = np.zeros((length, n), dtype=bool)
        for i, r in enumerate(runs):
            self.y[: len(r.labels), i], self.on[: len(r.labels), i] = r.labels, True
        self.weight = np.array([r.weight for r in runs])
        self.token = np.concatenate([r.pairs[:, 0] * n + i for i, r in enumerate(runs)]).astype(np.int64)
        self.feature = np.concatenate([r.pairs[:, 1] for r in runs]).astype(np.int64)
        before = np.vstack([np.zeros((1, n), dtype=np.int8), self.y[:-1]])
        self.seen = np.array([[(((before == a) & (self.y == b) & self.on) * self.weight).sum() for b in (0, 1)] for a in (0, 1)])

    def gradient(self, w: np.ndarray, bias: float, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Labels less expectations, from scaled forward-backward over all runs at once, position by position."""
        length, n = self.y.shape
        e = np.exp(np.clip(np.bincount(self.token, weights=w[self.feature], minlength=length * n).reshape(length, n) + bias, -30, 30))
        t, alpha = np.exp(trans), np.zeros((length + 1, n, 2))
        alpha[0, :, 0] = 1
        for i in range(length):
            new = alpha[i] @ t
            new[:, 1] *= e[i]
            new /= new.sum(axis=1, keepdims=True)
            alpha[i + 1] = np.where(self.on[i][:, None], new, alpha[i])
        state, pair, p1 = np.ones((n, 2)), np.zeros((2, 2)), np.zeros((length, n))
        for i in range(length - 1, -1, -1):
            joint = alpha[i + 1] * state
            p1[i] = joint[:, 1] / joint.sum(axis=1)
            into = state.copy()
            into[:, 1] *= e[i]
            both = alpha[i][:, :, None] * t[None] * into[:, None, :]
            both *= (self.weight * self.on[i] / both.sum(axis=(1, 2)))[:, None, None]
            pair += both.sum(axis=0)
            new = into @ t.T
            new /= new.sum(axis=1, keepdims=True)
            state = np.where(self.on[i][:, None], new, state)
        error = np.where(self.on, self.y - p1, 0.0) * self.weight
        return np.bincount(self.feature, weights=error.ravel()[self.token], minlength=len(w)), float(error.sum()), self.seen - pair


def _fit_chain(runs: list[Run], k: int, steps: int = 60, side_by_side: int = 4_000) -> tuple[np.ndarray, float, np.ndarray]:
    """The likelihood of token labels under the chain, by gradient steps over all runs."""
    runs = sorted(runs, key=lambda r: len(r.labels))
    groups = [_Group(runs[i : i + side_by_side]) for i in range(0, len(runs), side_by_side)]
    total = sum(float((g.on * g.weight).sum()) for g in groups)
    now = [np.zeros(k), -4.0, np.zeros((2, 2))]
    m, v = [np.zeros(k), 0.0, np.zeros((2, 2))], [np.zeros(k), 0.0, np.zeros((2, 2))]
    for step in range(1, steps + 1):
        found = [g.gradient(*now) for g in groups]
        grads = [sum(f[0] for f in found) - 0.02 * now[0], sum(f[1] for f in found), sum(f[2] for f in found) - 0.02 * now[2]]
        for j in range(3):
            m[j] = 0.9 * m[j] + 0.1 * grads[j]
            v[j] = 0.99 * v[j] + 0.01 * np.square(grads[j])
            now[j] = now[j] + 0.25 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8 * total)
        now = [now[0], float(now[1]), now[2] - now[2][0, 0]]
    return now[0], now[1], now[2]


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, features of its tokens) of each text of a batch."""
    data, offsets = buffers(batch.column(text))
    for i, j in chunks(offsets):
        words = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
        edge, features = np.searchsorted(words.doc, np.arange(j - i + 1)), token_features(words)
        for d in range(j - i):
            yield i + d, features[edge[d] : edge[d + 1]]


def _evidence(sample: DataFrame) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(features that speak for toxic documents, and of the words those that do in each half of the sample), sorted.

    sample (half, y, text).  Features are counted on the executors; only those with evidence come back.
    """

    def counted(found: list[np.ndarray], side: list[int]) -> pa.RecordBatch:
        names, code = np.unique(np.concatenate(found), return_inverse=True)
        column = np.repeat(side, [len(f) for f in found])
        counts = [np.bincount(code[column == c], minlength=len(names)) for c in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *map(pa.array, counts)], ["feature", "clean0", "toxic0", "clean1", "toxic1"])

    def count(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (2 * batch.column(0).to_numpy() + batch.column(1).to_numpy()).astype(np.int64)
            found, side, held = [], [], 0
            for d, f in _parts(batch, 2):
                found.append(np.unique(f[f > 0]))
                side.append(sides[d])
                held += len(found[-1])
                if held > most:
                    yield counted(found, side)
                    found, side, held = [], [], 0
            if found:
                yield counted(found, side)

    sides = {(r["half"], r["y"]): r["n"] for r in sample.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda y, *halves: float(sum(sides.get((h, y), 0) for h in halves))
    sums = sample.mapInArrow(count, "feature long, clean0 long, toxic0 long, clean1 long, toxic1 long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("clean0", "toxic0", "clean1", "toxic1")])

    def speaks(pos: Column, neg: Column, n1: float, n0: float) -> Column:
        odds = F.log((pos + 0.5) / (n1 - pos + 0.5)) - F.log((neg + 0.5) / (n0 - neg + 0.5))
        return (pos >= LEAST) & (pos >= TIMES * neg) & (odds / F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) > EVIDENCE)

    col, word = F.col, F.col("feature").bitwiseAND(15) == 1
    flags = {"whole": speaks(col("toxic0") + col("toxic1"), col("clean0") + col("clean1"), size(1, 0, 1), size(0, 0, 1))}
    flags |= {f"half{h}": word & speaks(col(f"toxic{h}"), col(f"clean{h}"), size(1, h), size(0, h)) for h in (0, 1)}
    rows = sums.select("feature", *[c.alias(n) for n, c in flags.items()]).where("whole OR half0 OR half1").toPandas()
    of = lambda name: np.sort(rows["feature"].to_numpy(np.int64)[rows[name].to_numpy(bool)].view(np.uint64))
    return of("whole"), {h: of(f"half{h}") for h in (0, 1)}


def _found(known: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each feature is known, its number)."""
    if not len(known):
        return np.zeros(features.shape, dtype=bool), np.zeros(features.shape, dtype=np.int64)
    at = np.searchsorted(known, features)
    at[at == len(known)] = 0
    return known[at] == features, at


def _active_tokens(sample: DataFrame, known: np.ndarray, words: dict[int, np.ndarray]) -> list[tuple]:
    """(y, tokens, places, (active token, feature) pairs, labels) of each document of the sample; labels by the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, y, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for d, features in _parts(batch, 2):
                hit, at = _found(known, features)
                places = np.flatnonzero(hit.any(axis=1))
                token, kind = np.nonzero(hit[places])
                pairs = np.stack([token, at[places][token, kind]], axis=1).astype(np.int32)
                labels = (_found(words[1 - half[d]], features[places, 0])[0] & (y[d] > 0)).astype(np.int8)
                out.append((y[d], len(features), places.astype(np.int32).tobytes(), pairs.tobytes(), labels.tobytes()))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], ["y", "n", "places", "pairs", "labels"])

    rows = sample.mapInArrow(run, "y long, n long, places binary, pairs binary, labels binary").toLocalIterator()
    got = [(r["y"], r["n"], np.frombuffer(r["places"], np.int32), np.frombuffer(r["pairs"], np.int32).reshape(-1, 2), np.frombuffer(r["labels"], np.int8)) for r in rows]
    return sorted(got, key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes(), r[4].tobytes()))


def fit(sample: DataFrame) -> Field:
    """Features, chain and document score from a sample (half, y, text)."""
    kinds = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    constant = Field(np.zeros(0, np.uint64), np.zeros(0), -4.0, np.zeros((2, 2)), np.array([2.0 if kinds.get(1, 0) > kinds.get(0, 0) else -2.0, *[0.0] * DOC_STATS]))
    if len(kinds) < 2:
        return constant
    known, words = _evidence(sample)
    if not len(known):
        return constant
    docs, runs, background = _active_tokens(sample, known, words), [], 0
    for _, n, places, pairs, labels in docs:
        more, rest = runs_of(places, pairs, labels, n)
        runs += more
        background += rest
    if background:
        # All background looks alike: one run of it stands for the rest.
        runs.append(Run(np.zeros((0, 2), np.int64), np.zeros(20, np.int8), background / 20))
    field = Field(known, *_fit_chain(runs, len(known)), constant.doc)
    z = []
    for _, n, places, pairs, _ in docs:
        if not len(places):
            z.append(document_stats([]))
            continue
        emission = field.bias + np.bincount(pairs[:, 0], weights=field.weights[pairs[:, 1]], minlength=len(places))
        gaps = np.diff(np.concatenate([[-1], places, [n]])) - 1
        z.append(document_stats([(0, 0, p) for p in marginals(field, emission, gaps).tolist()]))
    return field._replace(doc=_logistic(np.array(z), np.array([d[0] for d in docs], dtype=float)))


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    x = np.hstack([np.ones((len(z), 1)), z])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(h, x.T @ (y - p) - penalty * w).clip(-2, 2)
    return w


def score_of(field: Field, spans: list[tuple[int, int, float]]) -> float:
    return float(1 / (1 + np.exp(-(field.doc[0] + np.dot(field.doc[1:], document_stats(spans))))))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 4, fold: int = 2, max_rows: int = 4_000) -> Field:
    """Learn from labelled rows outside the held-out fold: at most max_rows, by a hash of the id."""
    usable = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("l_id").isNotNull() & ~held_out(F.col("l_id"), folds, fold))
    chosen = sample_labels(usable, max_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    one = joined.groupBy("doc_id", "label_no", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = materialize(one.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), (F.col("y") > 0).cast("long").alias("y"), "text"), "toxicity-sample")
    field = fit(sample)
    discard(sample)
    return field


def score(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text) to doc_id, score, spans: offsets in code points of the offending words, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                scores, marks = [], []
                for d, spans in enumerate(tag(field, part, at)):
                    scores.append(score_of(field, spans))
                    hot = [s for s in spans if s[2] >= threshold]
                    points = np.concatenate([[0], np.cumsum((part[at[d] : at[d + 1]] & 0xC0) != 0x80)]) if hot else None
                    marks.append(json.dumps([[int(points[a]), int(points[b])] for a, b, _ in hot]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores, pa.float64()), pa.array(marks, pa.string())], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans string")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, text) to doc_id, held_out, score, predicted, spans."""
    field = train(docs, labels, **options)
    folds, fold = options.get("folds", 4), options.get("fold", 2)
    return score(docs, field).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
