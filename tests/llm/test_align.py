"""op12 against brute force: whole texts, both tokenizers token by token, links pair by pair."""

import hashlib
import json
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from semlode.llm import align


@pytest.fixture(scope="module")
def plain():
    """A text to its groups, [(A ids, B ids)], empty where it has no tokens."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # The byte-level characters, read from the library's own alphabet by what it makes of each byte.
    of = {}
    for byte in range(256):
        if byte < 128:
            of[a.pre_tokenizer.pre_tokenize_str(chr(byte))[0][0]] = byte
    for lead in range(0xC2, 0xF5):
        for point in range(0x80, 0x110000, 0x40):
            if 0xD800 <= point < 0xE000 or chr(point).encode()[0] != lead:
                continue
            shown = "".join(x for x, _ in a.pre_tokenizer.pre_tokenize_str(chr(point)))
            for c, byte in zip(shown, chr(point).encode()):
                of[c] = byte
            break
    for point in range(0x80, 0xC0):
        of["".join(x for x, _ in a.pre_tokenizer.pre_tokenize_str(chr(0x100 + point - 0x80)))[1]] = point

    def bytes_a(i):
        return bytes(of[c] for c in a.id_to_token(i))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.encode().replace("▁".encode(), b" ")

    def groups(text):
        if not text:
            return []
        whole = (" " + text).encode()
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(map(bytes_a, x)) != whole or b"".join(map(bytes_b, y)) != whole:
            return []
        out, i, j, at_x, at_y, gx, gy = [], 0, 0, 0, 0, [], []
        while i < len(x) or j < len(y):
            if at_x <= at_y and i < len(x):
                gx.append(x[i])
                at_x += len(bytes_a(x[i]))
                i += 1
            else:
                gy.append(y[j])
                at_y += len(bytes_b(y[j]))
                j += 1
            if at_x == at_y:
                out.append((gx, gy))
                gx, gy = [], []
        return out

    return groups


def expected(plain, rows):
    found = [(d, plain(t)) for d, t in rows]
    counts = Counter()
    for _, g in found:
        counts.update({(x, y) for gx, gy in g for x in gx for y in gy})
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for d, g in found:
        links = [(x, y) for gx, gy in g for x in gx for y in gy]
        text = ";".join(",".join(map(str, gx)) + "|" + ",".join(map(str, gy)) for gx, gy in g)
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def check(plain, docs, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = align.align(docs, **how)
    assert got.columns == [x.split()[0] for x in align.RESULT.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(plain, rows)


def test_documents(plain, spark, small):
    check(plain, small)
    check(plain, small.repartition(3), chunk=200_000)


def test_odd_and_empty(plain, spark, odd, empty):
    more = spark.createDataFrame(
        [(20, "x▁y stays out"), (21, "trailing "), (22, "  two  spaces  "), (23, "a\n\nb\n c \t d\r\ne\x0b\x0cf"), (24, "<|endoftext|> </s> <s> <0x41>"), (25, "日本語　の 文字   x \x1c y"), (26, "\n"), (27, " "), (28, "it's 're 'S \x00 nul"), (29, "äöü" * 400 + "🎉" * 300)],
        "doc_id long, text string",
    )
    check(plain, odd.select("doc_id", "text").unionByName(more))
    assert align.align(empty).collect() == []


def test_groups_are_given_whole(plain, spark, small):
    docs = small.limit(60)
    want = {d: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(t)) for d, t in docs.select("doc_id", "text").collect()}
    assert {r[0]: r[1] for r in align.group_texts(docs, chunk=20_000).collect()} == want


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*align.tokenizers(None, None))


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \n\t\r   　'sré▁<0x>{};.09"), st.characters(codec="utf-8")), max_size=40))
def test_segments_are_tokenised_like_the_whole(plain, pair, text):
    parts = pair.segments(text)
    assert "".join(parts) == (" " + text if text else "")
    found = pair.align(parts) if parts else []
    want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(text))
    assert (None in found and want == "") or ";".join(found) == want


def test_large_groups_are_counted_by_distinct_ids(pair, monkeypatch):
    aligned = ["5,5,7|9,8,9;1|2", None, "1|2", "5|9,9"]
    for large in (256, 1):
        monkeypatch.setattr(align, "LARGE", large)
        links = align.Linked(aligned)
        got = [[(int(k) >> 32, int(k) & 0xFFFFFFFF, int(w)) for k, w in zip(links.keys[links.pair[a:b]], links.weight[a:b])] for a, b in zip(links.first, links.first[1:])]
        assert got == [[(1, 2, 1), (5, 8, 2), (5, 9, 4), (7, 8, 1), (7, 9, 2)], [], [(1, 2, 1)], [(5, 9, 2)]]
        assert {c: links.counts[c].tolist() for c in align.COUNTS} == {"n_a": [4, 0, 1, 1], "n_b": [4, 0, 1, 2], "n_groups": [2, 0, 1, 1], "n_links": [10, 0, 1, 2]}


def test_splits_are_verified(pair, tmp_path):
    """With an entry that reaches across a space in A's vocabulary, texts stay whole."""
    assert pair.splits == " \n\t"
    made = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    vocab = made["model"]["vocab"]
    last = max((n for n in vocab.items() if n[1] < 50256), key=lambda n: n[1])[0]
    vocab["eĠt"] = vocab.pop(last)
    made["model"]["merges"] = [m for m in made["model"]["merges"] if "".join(m if isinstance(m, list) else m.split(" ")) != last]
    (tmp_path / "across.json").write_text(json.dumps(made))
    assert align.Pair(str(tmp_path / "across.json"), public_tokenizers.path("piece_bpe_32k.model")).splits == ""
