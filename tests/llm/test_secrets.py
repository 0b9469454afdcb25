import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from semlode.llm import secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def check(rows, got):
    names = ["assign", "access", "hex"]
    for i, text in rows:
        want = base(text or "")
        said = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert {s for s in r["spans"].split(",") if s.split(":")[0] in names} == set(filter(None, said.split(",")))


def test_query(small, rows, odd, empty):
    check([(i, t) for i, t, _ in rows], {r["doc_id"]: r for r in secrets.scan(small).collect()})
    got = secrets.scan(odd).collect()
    assert len(got) == odd.count() and all(r["spans"] == "" for r in got if r["doc_id"] in (2, 3, 4))
    assert next(r for r in got if r["doc_id"] == 8)["spans"] == "assign:9:27"
    assert secrets.scan(empty).count() == 0


def test_hard_texts(spark):
    texts = ["TOKEN='abcdef'", "api_key: abc api_KEY=abcdefg", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "é" + "0f" * 12, "0f" * 11 + "0", "passſword = abcdefg", "PASSWORD=" + "a" * 24, "token=", "-----BEGIN RSA PRIVATE KEY-----", "xtoken == abcdef", "secret\n=abcdef", "secret  =  =abcdef", "ghp_" + "a1" * 20, "https://me:pw12@host/x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    check(list(enumerate(texts)), got)
    assert got[9]["spans"].startswith("private_key:0:") and "github:0:44" in got[13]["spans"] and got[14]["spans"] == "url_login:0:20"


def test_trigram_queries_hold_for_every_match():
    queries = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert queries["hex"] is True and queries["access"] == ("and", ("aki", "kia"))
    assert queries["assign"][0] == "or" and "tok" in secrets.trigrams(queries["assign"])


def holds(q, text):
    if q is True:
        return True
    if isinstance(q, str):
        return q in text
    return (all if q[0] == "and" else any)(holds(x, text) for x in q[1])


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(secrets.RULES), st.data())
def test_queries_are_necessary(rule, data):
    flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)
    match = data.draw(st.from_regex(re.compile(rule.pattern, flags), fullmatch=True))
    assert holds(secrets.trigram_query(rule), match.lower())


def test_time_is_linear_in_long_runs():
    """A megabyte of each kind of run that a pattern begins with."""
    hard = ["a" * 1_000_000 + "://", "eyJ" * 333_000 + ".eyJ", "http://" + "a" * 500_000 + ":" + "b" * 500_000, "token" + " " * 1_000_000, "-----BEGIN " + "PRIVATE KEY" * 90_000, "ghp_" * 250_000, "AKIA" * 250_000, "xoxb-" * 200_000]
    rules = [(k, (r, secrets._compiled(r))) for k, r in enumerate(secrets.RULES)]
    for text in hard:
        began = time.perf_counter()
        secrets.scan_text(text, rules)
        assert time.perf_counter() - began < 5
