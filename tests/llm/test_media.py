import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from semlode.llm import media


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 120_000), st.integers(0, 1 << 30))
def test_round_trip(n, seed):
    raw = np.random.default_rng(seed).bytes(n)
    stream = media.write_stream(raw)
    back = media.read_stream(stream)
    assert back.payload == raw and back.lost == back.bad == 0 and len(stream) % 188 == 0
    assert back.programs[media.PROGRAM]["streams"] == {media.ES_PID: media.PRIVATE_TYPE}
    assert back.stamps == [i * media.TICKS for i in range(len(back.stamps))] == back.entry_points


def test_all_tail_sizes():
    for n in range(0, 800):
        assert media.read_stream(media.write_stream(b"\x47" * n)).payload == b"\x47" * n


def test_damage_is_seen():
    stream = media.write_stream(b"x" * 2000)
    gone = stream[: 188 * 4] + stream[188 * 5 :]
    assert media.read_stream(gone).lost == 1 and media.read_stream(gone).bad >= 1
    broken = bytearray(stream)
    broken[188 + 12] ^= 1
    assert media.read_stream(bytes(broken)).bad == 1
    assert media.read_stream(b"").payload == b""


def test_query(small, rows, odd, empty):
    got = {r["doc_id"]: r for r in media.digests(small).collect()}
    for i, text, _ in rows:
        raw = text.encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r["feature"].endswith("lost=0;bad=0")
    rest = media.digests(odd).collect()
    assert len(rest) == odd.count() and all(r["payload_bytes"] == 64 for r in rest if r["doc_id"] in (2, 3))
    assert len({tuple(r)[1:] for r in rest if r["doc_id"] in (9, 10)}) == 1
    assert media.digests(empty).count() == 0
    decoded = media.decode(media.encode(odd)).collect()
    assert sum(len(r["payload"]) for r in decoded) == sum(r["payload_bytes"] for r in rest)
