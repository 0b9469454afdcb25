"""The text-preparation queries against their SQL on sf0.01."""

import duckdb
import pytest
from semlode.llm import licenses, secrets
from semlode.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((dict(zip(names, r)) for r in rel.fetchall()), key=lambda r: repr(sorted(r.items())))
    got = sorted((r.asDict() for r in df.collect()), key=lambda r: repr(sorted(r.items())))
    assert want and got == want


def test_licenses_on_odd_files(spark, tmp_path):
    texts, mit = licenses.full_texts(), licenses.TEMPLATES["MIT"]
    files = [
        (0, texts["GPL-2.0"]), (1, "code"), (2, f"Prose here. {mit}  More prose. Copyright me."), (3, None), (3, None), (5, ""), (6, "x = 1 // SPDX-License-Identifier: (GPL-3.0-or-later)"),
        (64, f"{mit}\n\nwords"), (64, texts["BSD-3-Clause"]), (65, "é. Ünter"), (128, None), (129, "license " * 2000), (192, "SPDX-License-Identifier: no-such"), (193, "It's LICENCE, spdx"),
        (256, mit), (256, mit), (257, None), (None, mit), (None, mit), (None, None), (320, texts["AGPL-3.0"].replace("\n", " ")), (321, "\n. \n"),
    ]
    docs = spark.createDataFrame(files, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    rel = con.execute(ORACLE["op7_licenses"])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=repr)
    got = sorted((tuple(r) for r in licenses.query(docs).select(*names).collect()), key=repr)
    assert got == want and len(got) == len(files)
    of = {r[0]: r[2] for r in got if r[0] is not None}
    assert of[0] == of[1] == "GPL-2.0" and of[2] == of[256] == of[257] == "MIT" and of[6] == "GPL-3.0" and of[129] is None and of[320] == of[321] == "AGPL-3.0"


def test_secrets_on_odd_texts(spark, tmp_path):
    jwt = "eyJab.eyJcd.ef"
    texts = [
        "TOKEN='abcdef'", "api_key: abc api_KEY=abcdefg", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "é" + "0f" * 12, "0f" * 11 + "0", "paſſword=abcdefg", "toKen=abcdefg", "PASSWORD=" + "a" * 24, "token=",
        "-----BEGIN RSA PRIVATE KEY-----", "secret\n=abcdef", "secret  =  =abcdef", "ghp_" + "a1" * 20, f"{jwt} {jwt}.{jwt} x{jwt}\t{jwt}", "http://a:b@c http://d:e@f,http://g:h@i/xftp://j:k@l",
        "a://b\x0bc:d@e a://b:c\x0b@e a://é:ü@日本/", "", None, None, "xoxb-1234567890 AIza" + "x" * 36, "token=abcdefsecret=ghijkl secret:'x.y-z_0'", "x\x00token=abcdef\x01", "0f" * 12 + "g" + "0f" * 13, "DEADBEEF" * 4,
    ]
    docs = spark.createDataFrame([(i // 2 or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    rel = con.execute(ORACLE["op9_secrets"])
    names = [d[0] for d in rel.description]
    got = sorted((tuple(r) for r in secrets.scan(docs).select(*names).collect()), key=repr)
    assert got == sorted(rel.fetchall(), key=repr) and len(got) == len(texts)
