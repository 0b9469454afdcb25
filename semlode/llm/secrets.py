"""Secret scans (operator 9) with a trigram inverted index.

Each rule's pattern is parsed and a Boolean trigram query derived from it: what every match must
contain.  Texts are taken in blocks; a block's index has postings (sorted text numbers) for the trigrams
that occur in any query, built in one pass over the bytes.  A query intersects and unites postings, and
only the candidates are scanned with the pattern.  A rule without mandatory trigrams scans every text.

Defined cases: a null text is empty and has no spans; spans are code points, end exclusive; spans of a
kind never overlap, those of different kinds may; texts that repeat have equal results; a very long text
is a block of its own and is scanned whole, in time linear in its length; empty tables give empty results;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import LOWER, buffers, chunks


class Rule(NamedTuple):
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    base: bool = False


#: Every pattern reads a run of characters from its start only, so that a text costs time in proportion to its length.
#: Fixed rules.  The first three are those of the contract: found first, then dropped where the group is too short.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20, True),
    Rule("hex", r"[0-9a-f]+", False, 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@[^\s/@]+"),
]

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple

_MOST = 64


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What a text with one of these strings must contain."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _members(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value))
        elif op is K.RANGE and value[1] - value[0] < 8:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _exact(op, value) -> set[str] | None:
    """All strings that a node can match, if they are few."""
    if op is K.LITERAL:
        return {chr(value)}
    if op is K.IN:
        return _members(value)
    if op is K.SUBPATTERN:
        return _exact_all(value[3])
    if op is K.BRANCH:
        found = [_exact_all(x) for x in value[1]]
        return None if None in found else set().union(*found)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, inner = value
        one = _exact_all(inner)
        if one is None or high > 4:
            return None
        out: set[str] = set()
        for n in range(low, int(high) + 1):
            run = {""}
            for _ in range(n):
                run = {a + b for a in run for b in one}
                if len(run) > _MOST:
                    return None
            out |= run
        return out if len(out) <= _MOST else None
    return None


def _exact_all(nodes) -> set[str] | None:
    run = {""}
    for op, value in nodes:
        one = _exact(op, value)
        if one is None:
            return None
        run = {a + b for a in run for b in one}
        if len(run) > _MOST:
            return None
    return run


def _inner(op, value) -> Query:
    if op is K.SUBPATTERN:
        return _sequence(value[3])
    if op is K.BRANCH:
        return _any([_sequence(x) for x in value[1]])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] > 0:
        return _sequence(value[2])
    return True


def _sequence(nodes) -> Query:
    parts, run = [], {""}
    for op, value in nodes:
        one = _exact(op, value)
        joined = None if one is None else {a + b for a in run for b in one}
        if joined is not None and len(joined) <= _MOST:
            run = joined
            continue
        parts.append(_of_strings(run))
        run = one if one is not None else {""}
        if one is None:
            parts.append(_inner(op, value))
    return _all([*parts, _of_strings(run)])


def trigram_query(rule: Rule) -> Query:
    """What any match of the rule contains, in lower-case trigrams; True where nothing is mandatory."""
    return _lowered(_sequence(_parser.parse(rule.pattern, re.ASCII)))


def _lowered(q: Query) -> Query:
    if q is True:
        return True
    if isinstance(q, str):
        return q.lower() if q.isascii() else True
    return (_all if q[0] == "and" else _any)([_lowered(x) for x in q[1]])


def trigrams(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))


class Index:
    """Postings of one block of texts for a set of trigrams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: list[str], table: np.ndarray) -> None:
        self.n = len(offsets) - 1
        self.number = {t: i for i, t in enumerate(wanted)}
        low = LOWER[data].astype(np.int32)
        if len(low) < 3:
            at, which = np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
            hit = table[code]
            at = np.flatnonzero(hit)
            which = hit[at].astype(np.int64) - 1
        doc = np.searchsorted(offsets, at, side="right") - 1
        whole = at + 3 <= offsets[doc + 1] if len(at) else np.zeros(0, bool)
        pair = np.unique(which[whole] * max(self.n, 1) + doc[whole])
        self.docs = pair % max(self.n, 1)
        self.first = np.searchsorted(pair // max(self.n, 1), np.arange(len(wanted) + 1))

    def find(self, q: Query) -> np.ndarray:
        if q is True:
            return np.arange(self.n)
        if isinstance(q, str):
            i = self.number[q]
            return self.docs[self.first[i] : self.first[i + 1]]
        parts = [self.find(x) for x in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out


def lookup(wanted: list[str]) -> np.ndarray:
    """For each of the 2^24 trigrams of bytes, its number from 1, or 0."""
    table = np.zeros(1 << 24, dtype=np.uint16)
    for i, t in enumerate(wanted):
        a, b, c = t.encode()
        table[a << 16 | b << 8 | c] = i + 1
    return table


def _compiled(rule: Rule) -> re.Pattern:
    """For one repeated class that must reach a length, runs of that length are the runs that pass."""
    pattern = rule.pattern
    if rule.kind == "hex":
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)
    return re.compile(pattern, flags)


def scan_text(text: str, rules: list[tuple[int, tuple[Rule, re.Pattern]]]) -> list[tuple[int, int, int]]:
    """(start, number of rule, end) of every match that passes, in the order of start, then rule."""
    out = []
    for k, (rule, pattern) in rules:
        for m in pattern.finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def scan_block(texts: pa.Array, rules: list[Rule], compiled: list[re.Pattern], queries: list[Query], wanted: list[str], table: np.ndarray) -> list[list[tuple[int, int, int]]]:
    data, offsets = buffers(texts)
    index = Index(data, offsets, wanted, table)
    todo: list[list] = [[] for _ in range(len(texts))]
    for k, (rule, q) in enumerate(zip(rules, queries)):
        for d in index.find(q):
            todo[d].append((k, (rule, compiled[k])))
    return [scan_text(texts[d].as_py() or "", todo[d]) if todo[d] else [] for d in range(len(texts))]


def joined(spans: list[tuple[int, int, int]], rules: list[Rule]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, rules: list[Rule] = RULES, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, text) to doc_id, n_assign, n_access, n_hex, base_sha256, spans.  No shuffle."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [_compiled(r) for r in rules]
        queries = [trigram_query(r) for r in rules]
        wanted = sorted(set().union(*map(trigrams, queries)))
        table = lookup(wanted)
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets, block_bytes):
                rows = []
                for spans in scan_block(batch.column(1).slice(i, j - i), rules, compiled, queries, wanted, table):
                    base = [s for s in spans if rules[s[1]].base]
                    kinds = [sum(rules[k].kind == kind for _, k, _ in base) for kind in ("assign", "access", "hex")]
                    rows.append((*kinds, hashlib.sha256(joined(base, rules).encode()).hexdigest(), joined(spans, rules)))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def _for_sql(rule: Rule) -> tuple[str, int]:
    """A rule for DuckDB, and by how many characters its matches begin early.

    Its patterns fold case by Unicode and don't look behind: letters of either case are written out, and what may not
    stand before a match becomes a character of the match.
    """
    pattern = _compiled(rule).pattern.replace(r"\s", r"\x09-\x0D\x20")
    if rule.ignore_case:
        words, rest = pattern.split(")", 1)
        pattern = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words) + ")" + rest
    behind = pattern.startswith("(?<![")
    if behind:
        pattern = pattern.replace("(?<![", "[^", 1).replace("])", "]", 1)
    return pattern.replace("'", "''"), int(behind)


def oracle(rules: list[Rule] = RULES) -> str:
    """DuckDB SQL of scan.  A place is the length of all gaps and matches before it; a line feed put before each text is what may precede a match."""
    found = []
    for k, rule in enumerate(rules):
        pattern, early = _for_sql(rule)
        passes = f"length(regexp_extract(m, '{pattern}', {rule.group})) >= {rule.least}" if rule.least else "true"
        found.append(f"""
 SELECT n, {k} AS k, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, after - length(m) + {early} - 1 AS start, after - 1 AS stop FROM (
  SELECT n, m, sum(length(gap) + length(m)) OVER (PARTITION BY n ORDER BY i) AS after FROM (
   SELECT n, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (
    SELECT n, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM texts)))
 WHERE {passes}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in ("assign", "access", "hex"))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, chr(10) || coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
of_text AS (
 SELECT n, {counts}, string_agg(said, ',' ORDER BY start, k) FILTER (base) AS base, string_agg(said, ',' ORDER BY start, k) AS spans
 FROM (SELECT *, concat(kind, ':', start::BIGINT, ':', stop::BIGINT) AS said FROM found) GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN of_text USING (n)
"""
