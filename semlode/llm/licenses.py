"""License scans (operator 7), with DataFrame functions only.

A file's comment blocks and their paragraphs, its header lines (all those with a licence cue), the lines of a
licence file and the whole of it become sparse TF-IDF vectors over their words.  Blocks and paragraphs, without
comment marks and line ends, are compared with the notices() of licences (cosine of at least HEADER), lines with
TEMPLATES (at least 0.5), a whole licence file with the full texts of license_texts (at least WHOLE); inverse
document frequencies count what is compared and its templates.  A line with an SPDX identifier of a known licence
has score 1.  What goes first: the whole of a licence file, an SPDX identifier, comment blocks, lines.  Files
without a licence of their own inherit that of the licence file in the nearest directory above, found by joining
every ancestor directory with the directories that have one.

A comment block is what stands between `/*` and `*/`, `<!--` and `-->` or two triple quotes, or a run of lines that begin
with one of the line marks of LINE_MARK; its paragraphs end at lines that are empty but for marks.

Defined cases: null and empty texts have no licence of their own; null paths have no directories and inherit
nothing; a comment that does not end is none (a docstring ends with its text); equal scores go to the template first by name; a directory with several licence files takes
the best score, then the first path; rows that repeat have equal results, and rows of one file with other
texts results of their own; of a very long text every line is read; empty tables give empty results; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import cache, reduce
from importlib.resources import files as package_files

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import join_heavy, materialize

#: Fixed texts of well-known licence headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, the Creative Commons Attribution license.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
}

#: Fixed texts: the notice that the GNU licences ask for, in its three paragraphs.
GRANT = (
    "This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; "
    "either version {version} of the License, or (at your option) any later version."
)
WARRANTY = "This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
RECEIVED = "You should have received a copy of the GNU {name} along with this {work}. If not, see <https://www.gnu.org/licenses/>."
#: Fixed names of the GNU licences: what they call the work, their name and version.
GNU = {
    "GPL-2.0": ("program", "General Public License", "2"),
    "GPL-3.0": ("program", "General Public License", "3"),
    "LGPL-2.0": ("library", "Library General Public License", "2"),
    "LGPL-2.1": ("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": ("library", "Lesser General Public License", "3"),
    "AGPL-3.0": ("program", "Affero General Public License", "3"),
}
#: Fixed texts of the other licences' notices in source files.
NOTICES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "MPL-1.1": (
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        'License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for '
        "the specific language governing rights and limitations under the License."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause/notice": "Copyright The Authors. All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT/notice": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed "
        "without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."
    ),
}

#: Least cosine of a comment block or paragraph with a notice.
HEADER = 0.6
#: Line marks of comments, and what is taken off the beginnings of a block's lines.
LINE_MARK = r"^[ \t]*(?://+|#+|--+|;+|%+|dnl |rem )!?"
INNER_MARK = r"^[ \t]*[*#/;%!-]*[ \t]*"

#: Least cosine of a whole licence file: two licences of different families have at most 0.85 (GPL-3.0 and LGPL-2.1).
WHOLE = 0.85
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*\(*([a-z0-9.+-]+)"
#: Endings of an SPDX identifier that do not name another text.
SPDX_ENDING = r"(-only|-or-later|\+)$"

CUE = r"(?i)licen[sc]e|copyright|spdx|creative commons"
LICENSE_FILE = r"(?i)(^|/)(license|licence|copying|unlicense)(\.[a-z]+)?$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def header_lines(text: Column) -> Column:
    """The sentences of whole text that have a cue; a text without any costs one look for the cue."""
    sentences = F.split(text, r"\n|(?<=[.])[ ]+(?=[A-Z])")
    return F.when(F.regexp_like(text, F.lit(CUE)), F.concat_ws("\n", F.filter(sentences, lambda s: F.regexp_like(s, F.lit(CUE)))))


@cache
def full_texts() -> dict[str, str]:
    """The texts of license_texts; that of AGPL-3.0 is made from GPL-3.0's by its name and its section on networks."""
    out = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in package_files("semlode.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
    named = out["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public")
    return out | {"AGPL-3.0": named + AFFERO}


AFFERO = """
Remote Network Interaction. If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network
(if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a
network server at no charge, through some standard or customary means of facilitating copying of software.
"""


def notices() -> dict[str, str]:
    """The notices by licence; one with several has keys `licence/which`."""
    out = dict(NOTICES)
    for key, (work, name, version) in GNU.items():
        grant, *others = (t.format(work=work, name=name, version=version) for t in (GRANT, WARRANTY, RECEIVED))
        out |= {key: " ".join([grant, *others]), f"{key}/grant": grant}
    return out | {k: full_texts()[k] for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense")}


def headers(text: Column) -> Column:
    """The comment blocks of whole text and their paragraphs, those that have a cue; the marks 1 and 2 are control characters of this function."""
    plain = F.translate(text, "\r\x01\x02", "")
    between = lambda begin, end: F.transform(
        F.filter(F.slice(F.split(plain, begin), 2, 1 << 30), lambda x: F.contains(x, F.lit(end))), lambda x: F.substring_index(x, end, 1)
    )
    doc = F.filter(F.split(plain, '"""'), lambda x, i: i % 2 == 1)
    # A line break before a marked line becomes a 2, so a run of such lines hangs together from the line before it.
    run = F.split(F.replace(F.regexp_replace(F.concat(F.lit("\n"), plain), "(?md)" + LINE_MARK, "\x01"), F.lit("\n\x01"), F.lit("\x02")), "\n")
    lines = F.transform(F.filter(run, lambda x: F.contains(x, F.lit("\x02"))), lambda x: F.replace(F.substr(x, F.instr(x, F.lit("\x02")) + 1), F.lit("\x02"), F.lit("\n")))
    clean = F.transform(F.concat(between(r"/\*", "*/"), between("<!--", "-->"), doc, lines), lambda x: F.regexp_replace(x, "(?md)" + INNER_MARK, ""))
    units = F.flatten(F.transform(clean, lambda x: F.concat(F.split(x, "\n\n+"), F.array(x))))
    return F.when(F.regexp_like(text, F.lit(CUE)), F.filter(units, lambda x: F.regexp_like(x, F.lit(CUE))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(templates.items()), "license string, body string")


def cosines(texts: DataFrame, templates: dict[str, str], least: float, name: str) -> DataFrame:
    """(line, files, said) with distinct digests to line, best: struct<at, license>, at the negative score."""
    spark = texts.sparkSession
    terms = texts.select("line", "files", F.explode(words(F.col("said"))).alias("word")).groupBy("line", "word").agg(F.count(F.lit(1)).alias("tf"), F.first("files").alias("files"))
    terms = materialize(terms, f"{name}-terms")
    of_template = template_table(spark, templates).select("license", F.explode(words(F.col("body"))).alias("word")).groupBy("license", "word").agg(F.count(F.lit(1)).alias("tf"))
    total = texts.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first()["n"] + len(templates)
    counted = terms.select("word", F.col("files").alias("df")).unionByName(of_template.select("word", F.lit(1).alias("df"))).groupBy("word").agg(F.sum("df").alias("df"))
    idf = counted.select("word", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    # A word such as "license" may be in most lines.
    weigh = lambda t, key: join_heavy(t, idf, "word").withColumn("w", F.col("tf") * F.col("idf")).select(key, "word", "w")
    of_line, of_license = materialize(weigh(terms, "line"), f"{name}-vectors"), materialize(weigh(materialize(of_template, f"{name}-bodies"), "license"), f"{name}-templates")
    norm = lambda t, key, name: t.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))
    # The templates are a parameter of the call; their number of words bounds the broadcast.
    dots = of_line.join(F.broadcast(of_license.withColumnRenamed("w", "tw")), "word").groupBy("line", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norm(of_line, "line", "n1"), "line").join(F.broadcast(norm(of_license, "license", "n2")), "license")
    best = scored.withColumn("score", F.round(F.col("dot") / (F.col("n1") * F.col("n2")), 6)).where(F.col("score") >= least)
    return best.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("at"), "license")).alias("best"))


def own_license(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.5) -> DataFrame:
    """(file, path, text) to (file, path, body, license, score): what the text itself, of which body is the digest, says.

    Each distinct header sentence is scored once, however many files carry it, and a file takes its best sentence.
    So is each distinct unit of comments.  A licence file is also scored whole.
    """
    whole = F.coalesce(F.regexp_like("path", F.lit(LICENSE_FILE)), F.lit(False))
    key = ["file", "path", "body"]
    said = files.select("file", "path", digest(F.col("text")).alias("body"), F.when(whole, F.split("text", "\n")).otherwise(F.split(header_lines(F.col("text")), "\n")).alias("lines"))
    said = materialize(said.select(*key, F.explode("lines").alias("said")).where(F.col("said") != "").withColumn("line", digest(F.col("said"))), "license-lines")
    # From here on a line is known by its digest, and so are the units of comments.
    lines = said.groupBy("line").agg(F.count(F.lit(1)).alias("files"), F.first("said").alias("said"))
    tagged = F.regexp_replace(F.lower(F.regexp_extract("said", SPDX, 1)), SPDX_ENDING, "")
    known = template_table(files.sparkSession, dict.fromkeys(templates.keys() | full_texts().keys(), "")).select("license", F.lower("license").alias("tag"))
    tags = lines.select("line", tagged.alias("tag")).join(F.broadcast(known), "tag").select("line", F.struct(F.lit(-1.0).alias("at"), "license").alias("best"))
    of_line = cosines(lines, templates, least, "license").withColumn("after", F.lit(3)).unionByName(tags.withColumn("after", F.lit(1)))
    heads = files.where(~whole).select("file", "path", digest(F.col("text")).alias("body"), F.explode(headers(F.col("text"))).alias("said")).withColumn("line", digest(F.col("said")))
    heads = materialize(heads, "license-headers")
    units = heads.groupBy("line").agg(F.count(F.lit(1)).alias("files"), F.first("said").alias("said"))
    bodies = files.where(whole & (F.col("text") != "")).select("file", "path", digest(F.col("text")).alias("body"), F.col("text").alias("said"))
    texts = bodies.groupBy(F.col("body").alias("line")).agg(F.count(F.lit(1)).alias("files"), F.first("said").alias("said"))
    # Each is written, so that the join with a line that many files have may be split.
    best_of = lambda rows, best, name: rows.select(*key, "line").join(materialize(best, name), "line").select(*key, F.struct("after", "best").alias("got"))
    found = [
        best_of(said, of_line, "license-best"),
        best_of(heads, cosines(units, notices(), HEADER, "license-header").withColumn("after", F.lit(2)), "license-headers-best"),
        best_of(bodies.withColumn("line", F.col("body")), cosines(texts, full_texts(), WHOLE, "license-whole").withColumn("after", F.lit(0)), "license-bodies-best"),
    ]
    own = reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min("got")["best"].alias("best"))
    return materialize(own.select(*key, F.substring_index("best.license", "/", 1).alias("license"), (-F.col("best.at")).alias("score")), "license-own")


def ancestors(path: Column) -> Column:
    """array<struct<dir, depth>> of the directories above a path, the root ('') included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("dir"), k.alias("depth")))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.5) -> DataFrame:
    """(file, path, text) to file, path, license, score, inherited, inherited_from.

    Directories, not files, meet in the inheriting join: each distinct directory looks for its nearest
    licence file once, and files then take their directory's answer.
    """
    files = files.select("file", "path", "text")
    own = own_license(files, templates, least)
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    given = own.where(F.regexp_like("path", F.lit(LICENSE_FILE))).withColumn("dir", directory)
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("at"), "path", "license")).alias("given"))
    places = files.select(directory.alias("of")).where("of IS NOT NULL").distinct()
    above = places.select("of", F.explode(ancestors(F.concat("of", F.lit("/x")))).alias("a")).select("of", F.col("a.dir").alias("dir"), F.col("a.depth").alias("depth"))
    above = materialize(above.where((F.col("depth") > 0) | (F.col("dir") == "")), "license-above")
    # The directories near the root are above most others.
    nearest = join_heavy(above, materialize(given, "license-given"), "dir").groupBy("of").agg(F.max(F.struct("depth", F.col("given.license").alias("license"), F.col("given.path").alias("path"))).alias("got"))
    same = F.col("file").eqNullSafe(F.col("f2")) & F.col("path").eqNullSafe(F.col("p2")) & (F.col("body") == F.col("b2"))
    rows = files.select("file", "path", digest(F.col("text")).alias("body"), directory.alias("of")).join(own.select(F.col("file").alias("f2"), F.col("path").alias("p2"), F.col("body").alias("b2"), "license", "score"), same, "left")
    rows = rows.join(nearest, "of", "left")
    missing = F.col("license").isNull()
    return rows.select(
        "file", "path", F.coalesce("license", "got.license").alias("license"), "score", (missing & F.col("got").isNotNull()).alias("inherited"), F.when(missing, F.col("got.path")).alias("inherited_from")
    )


def document_files(docs: DataFrame) -> DataFrame:
    """The documents table as files: source/block of 64 ids/name; the first of each block is its licence file."""
    block = F.floor(F.col("doc_id") / 64)
    name = F.when(F.col("doc_id") % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file"), F.concat_ws("/", F.lit("corpus"), block.cast("string"), name).alias("path"), "text")


def query(docs: DataFrame) -> DataFrame:
    return scan(document_files(docs)).select(F.col("file").alias("doc_id"), "path", "license", "score", "inherited", "inherited_from")


def oracle() -> str:
    """DuckDB SQL of the query.  A sentence ends where a line feed is put in, as DuckDB's patterns don't look behind."""
    values = lambda texts: ", ".join("(" + ", ".join(f"'{x.replace(chr(39), 2 * chr(39))}'" for x in t) + ")" for t in sorted(texts.items()))
    word = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"

    def best(texts: str, templates: dict[str, str], least: float) -> str:
        return f"""
 WITH terms AS (SELECT line, files, word, count(*) AS tf FROM (SELECT line, files, unnest(regexp_extract_all(lower(said), '{word}')) AS word FROM {texts}) GROUP BY ALL),
 bodies AS (SELECT license, word, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(body), '{word}')) AS word FROM (VALUES {values(templates)}) AS v(license, body)) GROUP BY ALL),
 counted AS (SELECT word, sum(df) AS df FROM (SELECT word, files AS df FROM terms UNION ALL SELECT word, 1 FROM bodies) GROUP BY word),
 idf AS (SELECT word, ln(((SELECT coalesce(sum(files), 0) FROM {texts}) + {len(templates)} + 1) / (df + 1)) + 1 AS idf FROM counted),
 a AS (SELECT line, word, tf * idf AS w FROM terms JOIN idf USING (word)),
 b AS (SELECT license, word, tf * idf AS w FROM bodies JOIN idf USING (word)),
 dots AS (SELECT line, license, sum(a.w * b.w) AS dot FROM a JOIN b USING (word) GROUP BY ALL),
 scored AS (SELECT line, license, round(dot / (n1 * n2), 6) AS score FROM dots
  JOIN (SELECT line, sqrt(sum(w * w)) AS n1 FROM a GROUP BY line) USING (line) JOIN (SELECT license, sqrt(sum(w * w)) AS n2 FROM b GROUP BY license) USING (license))
 SELECT line, license, score FROM scored WHERE score >= {least}"""

    known = ", ".join(f"('{x}')" for x in sorted(TEMPLATES.keys() | full_texts().keys()))
    between = lambda begin, end: f"list_transform(list_filter(string_split(t, '{begin}')[2:], lambda x: contains(x, '{end}')), lambda x: split_part(x, '{end}', 1))"
    return rf"""
WITH files AS (
 SELECT doc_id, concat_ws('/', 'corpus', (doc_id // 64)::VARCHAR, CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE 'src/' || doc_id || '.txt' END) AS path, text, md5(coalesce(text, '')) AS body
 FROM documents),
placed AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, coalesce(regexp_matches(path, '{LICENSE_FILE}'), false) AS whole FROM files),
said AS (
 SELECT *, md5(said) AS line FROM (
  SELECT doc_id, path, body, whole, unnest(string_split(CASE WHEN whole THEN text ELSE regexp_replace(text, '([.])[ ]+([A-Z])', '\1' || chr(10) || '\2', 'g') END, chr(10))) AS said FROM placed)
 WHERE said <> '' AND (whole OR regexp_matches(said, '{CUE}'))),
lines AS (SELECT line, count(*) AS files, any_value(said) AS said FROM said GROUP BY line),
plain AS (SELECT doc_id, path, body, translate(text, chr(13) || chr(1) || chr(2), '') AS t FROM placed WHERE NOT whole AND regexp_matches(text, '{CUE}')),
comments AS (
 SELECT doc_id, path, body, regexp_replace(unnest({between("/*", "*/")} || {between("<!--", "-->")} || list_filter(string_split(t, repeat(chr(34), 3)), lambda x, i: i % 2 = 0) || list_transform(
  list_filter(string_split(replace(regexp_replace(chr(10) || t, '(?m){LINE_MARK}', chr(1), 'g'), chr(10) || chr(1), chr(2)), chr(10)), lambda x: contains(x, chr(2))),
  lambda x: replace(substr(x, strpos(x, chr(2)) + 1), chr(2), chr(10)))), '(?m){INNER_MARK}', '', 'g') AS c FROM plain),
heads AS (SELECT *, md5(said) AS line FROM (SELECT doc_id, path, body, unnest(string_split_regex(c, '\n\n+') || [c]) AS said FROM comments) WHERE regexp_matches(said, '{CUE}')),
units AS (SELECT line, count(*) AS files, any_value(said) AS said FROM heads GROUP BY line),
of_unit AS ({best("units", notices(), HEADER)}),
whole_texts AS (SELECT body AS line, count(*) AS files, any_value(text) AS said FROM placed WHERE whole AND text <> '' GROUP BY body),
of_line AS ({best("lines", TEMPLATES, 0.5)}),
of_tag AS (SELECT line, license, 1.0 AS score FROM (SELECT line, regexp_replace(lower(regexp_extract(said, '{SPDX}', 1)), '{SPDX_ENDING}', '') AS tag FROM lines) JOIN (VALUES {known}) AS k(license) ON lower(license) = tag),
of_whole AS ({best("whole_texts", full_texts(), WHOLE)}),
own AS (
 SELECT doc_id, path, body, split_part(arg_min(license, (after, -score, license)), '/', 1) AS license, arg_min(score, (after, -score, license)) AS score FROM (
  SELECT doc_id, path, body, license, score::DOUBLE AS score, 0 AS after FROM placed JOIN of_whole ON line = body WHERE whole
  UNION ALL SELECT doc_id, path, body, license, score, 1 FROM said JOIN of_tag USING (line)
  UNION ALL SELECT doc_id, path, body, license, score, 2 FROM heads JOIN of_unit USING (line)
  UNION ALL SELECT doc_id, path, body, license, score, 3 FROM said JOIN of_line USING (line))
 GROUP BY doc_id, path, body),
given AS (
 SELECT dir, arg_min(path, (-score, path, license)) AS path, arg_min(license, (-score, path, license)) AS license
 FROM (SELECT DISTINCT doc_id, path, body, dir FROM placed WHERE whole) JOIN own USING (doc_id, path, body) GROUP BY dir),
above AS (
 SELECT place, array_to_string(parts[1:k], '/') AS dir, k FROM (
  SELECT place, parts, unnest(range(0, len(parts))) AS k FROM (SELECT DISTINCT dir AS place, string_split(dir || '/x', '/') AS parts FROM placed))),
nearest AS (SELECT place, arg_max(license, k) AS license, arg_max(path, k) AS path FROM above JOIN given USING (dir) GROUP BY place)
SELECT p.doc_id, p.path, coalesce(o.license, n.license) AS license, o.score, o.license IS NULL AND n.path IS NOT NULL AS inherited, CASE WHEN o.license IS NULL THEN n.path END AS inherited_from
FROM placed AS p LEFT JOIN own AS o ON o.doc_id IS NOT DISTINCT FROM p.doc_id AND o.path = p.path AND o.body = p.body LEFT JOIN nearest AS n ON n.place = p.dir
"""
