"""Whole licence files and SPDX identifiers."""

import pytest
from semlode.llm import licenses

TAGS = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "LGPL-2.1+": "LGPL-2.1", "(ISC OR MIT)": "ISC", "NoSuch-1.0": None}


def test_texts_and_identifiers(spark):
    texts = licenses.full_texts()
    files = [(f"d{i}/LICENSE", "Copyright (c) 2019 The Authors\n\n" + t, k) for i, (k, t) in enumerate(sorted(texts.items()))]
    files += [(f"d{i}/x.c", "int x;", k) for i, k in enumerate(sorted(texts))]
    files += [(f"s{i}/x.py", f"# SPDX-License-Identifier: {t}\nimport os", k) for i, (t, k) in enumerate(TAGS.items())]
    files += [("p/LICENSE", "The house of the king and the hill that we saw in the morning.\n" * 40, None)]
    rows = [(i, path, text) for i, (path, text, _) in enumerate(files)]
    got = {r["file"]: r for r in licenses.scan(spark.createDataFrame(rows, "file long, path string, text string")).collect()}
    assert {i: got[i]["license"] for i in got} == {i: k for i, (*_, k) in enumerate(files)}
    assert all(got[i]["score"] == 1 for i, (p, _, k) in enumerate(files) if p[0] == "s" and k)
    assert {"GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "BSD-2-Clause", "BSD-3-Clause", "MIT"} <= texts.keys()


@pytest.mark.parametrize("line, want", [("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0")])
def test_version_lines(spark, line, want):
    assert licenses.scan(spark.createDataFrame([(1, "a/x.py", line)], "file long, path string, text string")).first()["license"] == want
