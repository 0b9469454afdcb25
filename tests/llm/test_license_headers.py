"""Licence notices as they stand in the comments of source files."""

import math
import re
from collections import Counter

import duckdb
import pytest
from semlode.llm import licenses
from semlode.llm.queries import ORACLE

GPL = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version {v}
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL_2 = GPL.format(v=2) + """
You should have received a copy of the GNU General Public License
along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301, USA."""
GPL_3 = "frob - a tool that frobs\nCopyright (C) 2011  A. Person\n\n" + GPL.format(v=3) + """
You should have received a copy of the GNU General Public License
along with this program.  If not, see <http://www.gnu.org/licenses/>."""
LGPL_21 = """Copyright (C) 2004 The Authors

This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
BSD = "Copyright 2014 The Frob Authors. All rights reserved.\nUse of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
APACHE = """Copyright 2016 Frob Inc.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
LINUX = "frob.c: frobs\n\nThis program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation."

STYLES = {
    "stars": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\n#include <stdio.h>\nint main() { return 0; }\n",
    "open": lambda t: "/* " + t.replace("\n", "\r\n   ") + " */\r\nint x = 3 * 4 / 2;\r\n",
    "hash": lambda t: "#!/usr/bin/env python\n" + "\n".join(f"# {x}".rstrip() for x in t.split("\n")) + "\nimport os\nx = 1  # not a licence\n",
    "slashes": lambda t: "\n".join(f"// {x}".rstrip() for x in t.split("\n")) + "\n\npackage main\n",
    "dashes": lambda t: "\n".join(f"-- {x}".rstrip() for x in t.split("\n")) + "\nSELECT 1;\n",
    "docstring": lambda t: 'x = 1\n"""' + t + '"""\ndef f(): pass\n',
    "markup": lambda t: "<?xml version='1.0'?>\n<!--\n" + t + "\n-->\n<a/>\n",
}
TEXTS = {"GPL-2.0": [GPL_2, LINUX], "GPL-3.0": [GPL_3, GPL.format(v=3).split("\n\n")[0]], "LGPL-2.1": [LGPL_21], "BSD-3-Clause": [BSD], "MPL-2.0": [MPL], "Apache-2.0": [APACHE]}


def cases():
    out = [(style(t), k) for k, ts in TEXTS.items() for t in ts for style in STYLES.values()]
    full = licenses.full_texts()
    out += [(style("Copyright (c) 2019 The Authors\n\n" + full[k]), k) for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC") for style in STYLES.values()]
    out += [("/* " + GPL_3, None), (STYLES["hash"]("We compute the frobs of a table.\nSee the licence plates of the cars in the\nsecond column."), None), ("// code\n" * 3, None), ("\x01\x02// \x01license\x02", None), ("", None), (None, None)]
    out += [("// SPDX-License-Identifier: MIT\n" + STYLES["slashes"](MPL), "MIT"), ("/*" * 50_000 + " license", None), ("# license\n" * 50_000, None), ('"""' * 50_001 + "licence", None)]
    return out


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, f"d{i}/x.c", text) for i, (text, _) in enumerate(cases())]
    return {r["file"]: r for r in licenses.scan(spark.createDataFrame(rows, "file long, path string, text string")).collect()}


def test_each_notice_is_found(scanned):
    wrong = [(i, want, scanned[i]["license"], scanned[i]["score"]) for i, (_, want) in enumerate(cases()) if scanned[i]["license"] != want]
    assert not wrong


def units(text):
    """A plain reading of a text's comment units, line by line."""
    text = re.sub("[\r\x01\x02]", "", text or "")
    if not re.search(licenses.CUE, text):
        return []
    blocks = [p.split("*/")[0] for p in text.split("/*")[1:] if "*/" in p] + [p.split("-->")[0] for p in text.split("<!--")[1:] if "-->" in p] + text.split('"""')[1::2]
    run = None
    for line in [*text.split("\n"), ""]:
        m = re.match(licenses.LINE_MARK, line)
        if m:
            run = (run or []) + [line[m.end() :]]
        elif run is not None:
            blocks.append("\n".join(run))
            run = None
    out = []
    for block in blocks:
        lines = [re.sub(licenses.INNER_MARK, "", x) for x in block.split("\n")]
        paragraph = re.split("\n\n+", "\n".join(lines))
        out += [u for u in [*paragraph, "\n".join(lines)] if re.search(licenses.CUE, u)]
    return out


def test_scores_against_brute_force(scanned):
    words = lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
    said = {i: units(text) for i, (text, _) in enumerate(cases())}
    counts, templates = Counter(u for us in said.values() for u in us), licenses.notices()
    df = Counter(w for t in templates.values() for w in set(words(t)))
    for u, k in counts.items():
        df.update(dict.fromkeys(set(words(u)), k))
    n = counts.total() + len(templates)
    weigh = lambda t: {w: k * (math.log((n + 1) / (df[w] + 1)) + 1) for w, k in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known, compared = {k: weigh(t) for k, t in templates.items()}, {}
    for u in counts:
        v = weigh(u)
        scores = [(-round(sum(x * t.get(w, 0) for w, x in v.items()) / (norm(v) * norm(t) or 1), 6), k) for k, t in known.items()]
        compared[u] = min((s for s in scores if s[0] <= -licenses.HEADER), default=None)
    checked = 0
    for i, us in said.items():
        best = min((compared[u] for u in us if compared[u]), default=None)
        if best and "SPDX" not in cases()[i][0]:
            assert (scanned[i]["license"], scanned[i]["score"]) == (best[1].split("/")[0], pytest.approx(-best[0], abs=2e-6))
            checked += 1
    assert checked > 50


def test_sql_agrees(spark, tmp_path):
    docs = spark.createDataFrame([(i * 2 + 1, text) for i, (text, _) in enumerate(cases())], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    rel = con.execute(ORACLE["op7_licenses"])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=repr)
    assert sorted((tuple(r) for r in licenses.query(docs).select(*names).collect()), key=repr) == want
