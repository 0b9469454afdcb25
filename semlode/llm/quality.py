"""Quality classifier (operator 8): a sparse rule ensemble.

Statistics of whole texts are computed in one pass.  Small trees are grown on labelled statistics, each
path of a tree is a conjunctive rule, a lasso logistic regression weighs the rules and most get no weight;
the rest is compiled into one Spark column expression over the statistics.

Training uses a bounded sample of labelled rows (`max_rows`, in the order of a hash of the id), of which
only numbers reach the driver.  Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts have all statistics 0 and are scored like others; null labels are
not learned from; of repeated lines, those with equal sums of word hashes count as one line, so "a b" repeats "b a"; a table without labels or with labels of one kind gives a constant score; labels that
repeat count as often as they repeat; documents that repeat have equal scores, and of those that share an id
the one with the least statistics is learned from; equal bounds go to the earlier statistic; of a very long
text all counts; empty tables give empty results; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import columns_of, numbered, prefix_for, tidy
from ._text import NOT_SPACE, buffers, chunks, words_of

STATS = ["n_words", "n_bytes", "mean_word", "upper", "symbol", "digit", "bang", "bar", "stops", "distinct", "short_words", "long_words", "bare_marks", "line_words", "repeat_lines", "beyond_ascii", "repeat_pairs"]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT, _SYMBOL, _BANG, _BAR, _STOP = (_class(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~=+<>{}[]\\_/", "!", "|", ".?"))
_LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[0x80:] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each document; values of a document stand together."""
    edge = np.searchsorted(doc, np.arange(n + 1))
    return np.array([len(np.unique(values[edge[i] : edge[i + 1]])) for i in range(n)], dtype=np.int64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS for each text."""
    n = len(offsets) - 1
    words = words_of(data, offsets, NOT_SPACE)
    nw, nb = np.bincount(words.doc, minlength=n), np.diff(offsets)
    size = words.end - words.start
    by_word = lambda flag: np.bincount(words.doc, weights=flag, minlength=n)
    per_word, per_byte = 1.0 / np.maximum(nw, 1), 1.0 / np.maximum(nb, 1)
    newline = data == 10
    line_no = np.concatenate([[0], np.cumsum(newline)])[words.start] if len(data) else words.start
    lines = _distinct(words.doc, line_no, n)
    first = np.flatnonzero(np.concatenate([[True], (line_no[1:] != line_no[:-1]) | (words.doc[1:] != words.doc[:-1])])) if len(line_no) else np.zeros(0, np.int64)
    sums = np.add.reduceat(words.hash, first) if len(first) else np.zeros(0, np.uint64)
    different = _distinct(words.doc[first], sums, n)
    pairs = words.hash[:-1] * np.uint64(3) + words.hash[1:] if len(words.hash) > 1 else np.zeros(0, np.uint64)
    inside = words.doc[1:] == words.doc[:-1] if len(words.hash) > 1 else np.zeros(0, bool)
    pair_doc, pairs = words.doc[1:][inside] if len(words.hash) > 1 else np.zeros(0, np.int64), pairs[inside]
    n_pairs = np.bincount(pair_doc, minlength=n)
    out = np.zeros((n, len(STATS)))
    letters = _per_doc(_LETTER[data], offsets)
    letter_sums = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    bare = letter_sums[words.end] == letter_sums[words.start]
    out[:, 0], out[:, 1] = nw, nb
    out[:, 2] = by_word(size) * per_word
    out[:, 3] = _per_doc(_UPPER[data], offsets) / np.maximum(letters, 1)
    out[:, 4] = _per_doc(_SYMBOL[data], offsets) * per_byte
    out[:, 5] = _per_doc(_DIGIT[data], offsets) * per_byte
    out[:, 6] = _per_doc(_BANG[data], offsets) * per_word
    out[:, 7] = _per_doc(_BAR[data], offsets) * per_word
    out[:, 8] = _per_doc(_STOP[data], offsets) * per_word
    out[:, 9] = _distinct(words.doc, words.hash, n) * per_word
    out[:, 10] = by_word(size <= 3) * per_word
    out[:, 11] = by_word(size >= 20) * per_word
    out[:, 12] = by_word(bare) * per_word
    out[:, 13] = nw / np.maximum(lines, 1)
    out[:, 14] = 1 - different / np.maximum(lines, 1)
    out[:, 15] = _per_doc(data >= 0x80, offsets) * per_byte
    out[:, 16] = 1 - _distinct(pair_doc, pairs, n) / np.maximum(n_pairs, 1)
    out[nw == 0, 9:] = 0
    return out.round(9)


def with_statistics(docs: DataFrame, carry: list[str] | None = None, name: str = "stats") -> DataFrame:
    """docs with a column `name` (struct of STATS); carry: the other columns to keep (all that docs has)."""
    every = dict(zip(docs.columns, columns_of(docs)))
    carry = carry if carry is not None else [c for c in docs.columns if c.lower() != name.lower()]
    extra = [] if "text" in carry else [every["text"]]
    kept = docs.select(*[every[c] for c in carry], *extra)
    text, width = carry.index("text") if "text" in carry else len(carry), len(carry)
    schema = docs.select(*[every[c] for c in carry]).schema.add(name, T.StructType([T.StructField(s, T.DoubleType(), False) for s in STATS]), False)
    kind = pa.struct([pa.field(s, pa.float64(), False) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            parts = [statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
            values = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
            stats = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(STATS))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], stats], [*carry, name])

    return numbered(kept).mapInArrow(tidy(run), schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound): all must hold


class Ensemble(NamedTuple):
    rules: list[Rule]
    weights: list[float]
    bias: float


def _grow(x: np.ndarray, grad: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, least: int) -> list[Rule]:
    """The paths (inner ones too) of a regression tree on residuals."""
    if depth == 0 or len(rows) < 2 * least:
        return []
    best, total = (1e-9, -1, 0.0), grad[rows].sum()
    for c in columns:
        v = x[rows, c]
        order = np.argsort(v, kind="stable")
        s, g = v[order], np.cumsum(grad[rows][order])
        cut = np.flatnonzero(s[1:] > s[:-1])
        cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
        if not len(cut):
            continue
        k = cut + 1.0
        gain = g[cut] ** 2 / k + (total - g[cut]) ** 2 / (len(rows) - k) - total**2 / len(rows)
        i = gain.argmax()
        if gain[i] > best[0]:
            best = (gain[i], int(c), float((s[cut[i]] + s[cut[i] + 1]) / 2))
    _, c, bound = best
    if c < 0:
        return []
    out: list[Rule] = []
    for above in (False, True):
        side = rows[(x[rows, c] > bound) == above]
        here = ((c, above, bound),)
        out.append(here)
        out += [here + r for r in _grow(x, grad, side, columns, depth - 1, least)]
    return out


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c, above, bound in rule:
        out &= (x[:, c] > bound) == above
    return out


def _lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Proximal gradient with momentum; the bias is not penalised."""
    n, k = z.shape
    y = y.astype(np.float32)
    w, b = np.zeros(k, np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb, t = w.copy(), b, 1.0
    top, u = 0.0, np.ones(k, np.float32)
    for _ in range(30 if k else 0):  # the largest eigenvalue, without a copy of z
        u = z.T @ (z @ u)
        top = float(np.linalg.norm(u))
        u = u / max(top, 1e-30)
    rate = 4.0 * n / max(1.0, 1.1 * top + n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ vw + vb)))
        gw, gb = z.T @ (p - y) / n, (p - y).mean()
        nw = vw - rate * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        push = float((t - 1) / nt)
        vw, vb = (nw + push * (nw - w)).astype(np.float32), nb + push * (nb - b)
        w, b, t = nw.astype(np.float32), nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, penalty: float = 5e-4, seed: int = 5) -> Ensemble:
    """Rules from boosted small trees on random halves of the columns, weighed by lasso logistic regression."""
    if not len(y) or y.min() == y.max():
        return Ensemble([], [], 4.0 if len(y) and y[0] > 0.5 else -4.0 if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    score, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    least = max(3, len(y) // 500)
    for _ in range(trees):
        rows = rng.permutation(len(y))[: max(min(len(y), 4000), len(y) // 2)]
        columns = rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]
        grad = y - 1 / (1 + np.exp(-score))
        grown = _grow(x, grad, rows, columns, depth, least)
        for r in grown:
            rules[r] = None
        for r in grown:
            on = _holds(x, r)
            if on.any():
                score[on] += 0.3 * grad[on].mean()
    # A rule that holds for the same rows as an earlier one adds nothing.
    seen: dict[bytes, Rule] = {}
    for r in rules:
        seen.setdefault(np.packbits(_holds(x, r)).tobytes(), r)
    kept = list(seen.values())
    z = np.empty((len(y), len(kept)), dtype=np.float32)
    for k, r in enumerate(kept):
        z[:, k] = _holds(x, r)
    w, b = _lasso_logistic(z, y, penalty)
    return Ensemble([r for r, v in zip(kept, w) if v], [float(v) for v in w if v], float(b))


def _tree_sum(terms: list[Column]) -> Column:
    """A balanced sum keeps the expression shallow."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0.0)


def score_column(model: Ensemble, stats: str = "stats") -> Column:
    """The ensemble as a column expression over the statistics.

    Rules that begin with the same test share it, and a test decides for the rules of both its sides, so
    that the code Spark generates stays within the size of a compiled method.
    """
    root: dict = {"weight": model.bias, "tests": {}}
    for rule, weight in zip(model.rules, model.weights):
        node = root
        for c, above, bound in rule:
            sides = node["tests"].setdefault((c, bound), {})
            node = sides.setdefault(above, {"weight": 0.0, "tests": {}})
        node["weight"] += weight

    def value(node: dict | None) -> Column:
        if node is None:
            return F.lit(0.0)
        terms = [F.lit(node["weight"])] if node["weight"] else []
        for (c, bound), sides in node["tests"].items():
            terms.append(F.call_function("if", F.col(f"{stats}.{STATS[c]}") > F.lit(bound), value(sides.get(True)), value(sides.get(False))))
        return _tree_sum(terms)

    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value(root)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def sample_labels(usable: DataFrame, max_rows: int) -> DataFrame:
    """max_rows labels (l_id, y) at most, in the order of a hash of the id, numbered (label_no) where they repeat."""
    chosen = usable.orderBy(F.xxhash64("l_id"), "l_id", "y").limit(max_rows)
    return chosen.withColumn("label_no", F.row_number().over(Window.partitionBy("l_id").orderBy("y")))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 3, fold: int = 1, max_rows: int = 20_000, **options) -> Ensemble:
    """Learn from labelled rows outside the held-out fold, max_rows of them at most, in the order of a hash of the id."""
    usable = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("l_id").isNotNull() & ~held_out(F.col("l_id"), folds, fold))
    chosen = sample_labels(usable, max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "label_no", "y")
    # One row a label, so what reaches the driver is bounded by max_rows.
    one = with_statistics(texts, ["doc_id", "label_no", "y"]).groupBy("doc_id", "label_no", "y").agg(F.min("stats").alias("stats"))
    rows = one.select("doc_id", "y", "stats.*").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return fit(rows[STATS].to_numpy(float), rows["y"].to_numpy(float), **options)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, text) to doc_id, held_out, score, predicted."""
    model = train(docs, labels, **options)
    scored = with_statistics(docs.select("doc_id", "text"), ["doc_id"]).withColumn("score", score_column(model))
    folds, fold = options.get("folds", 3), options.get("fold", 1)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier accepts, with the columns of docs."""
    model = train(docs, labels, **options)
    name = prefix_for(docs, "stats")
    return with_statistics(docs, name=name).where(score_column(model, name) >= 0.5).select(*columns_of(docs))
