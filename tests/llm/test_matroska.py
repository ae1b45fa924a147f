import hashlib
import random
import zlib

import pytest

from payloom.llm import matroska as M


def padded(text):
    b = (text or "").encode()
    return b + bytes(-len(b) % 64 if b else 64)


@pytest.mark.parametrize("size", [1, 64, 511, 512, 513, 4096, 5000, 32768, 40_000, 300_001])
def test_round_trip(size):
    payload = random.Random(size).randbytes(size)
    data = M.mux(payload)
    media = M.demux(data)
    assert M.payload_of(data, media) == payload and media.doc_type == "matroska"
    assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bit_depth"] == 8
    assert [p[1] for p in media.packets] == [at * M.FRAME // M.PER_MS for at in range(len(media.packets))]
    assert {c for _, _, c in media.cues} == {p[5] for p in media.packets}
    assert [t for t, _, _ in media.cues] == [i * 4096 for i in range(len(media.cues))]


@pytest.mark.parametrize("n", [0, 1, 126, 127, 128, 16382, 16383, 1 << 21, 1 << 40])
def test_variable_length_numbers(n):
    raw = M.vint(n)
    assert M.read_vint(raw, 0) == (n, len(raw))


def test_all_lacings_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 10, b"c" * 700]
    head = b"\x81\x00\x05"
    xiph = head + bytes([0x80 | 1 << 1, 2]) + b"\xff\x2d" + b"\x0a" + b"".join(frames)
    ebml = head + bytes([0x80 | 3 << 1, 2]) + M.vint(300) + M.signed_vint(-290) + b"".join(frames)
    fixed = head + bytes([2 << 1, 1]) + b"xxyy"
    group = M.element(M.GROUP, M.element(M.BLOCK, head + b"\x00zz") + M.uint(M.BLOCK_DURATION, 1))
    inner = M.uint(M.TIMESTAMP, 100) + M.element(M.SIMPLE_BLOCK, xiph) + M.element(M.SIMPLE_BLOCK, ebml) + M.element(M.SIMPLE_BLOCK, fixed) + group
    unknown = M.CLUSTER.to_bytes(4, "big") + b"\xff" + inner
    data = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M._TRACKS + unknown + M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 7) + M.element(M.SIMPLE_BLOCK, b"\x81\x00\x00\x80q"))
    found = M.demux(data)
    assert [data[a:b] for _, _, a, b, _, _ in found.packets] == frames * 2 + [b"xx", b"yy", b"zz", b"q"]
    assert [p[1] for p in found.packets][0] == 105 and found.packets[-1][1] == 7
    assert [p[4] for p in found.packets] == [True] * 6 + [False] * 2 + [True] * 2


def test_malformed():
    data = M.mux(b"x" * 1000)
    with pytest.raises(ValueError):
        M.demux(data[:-30])
    with pytest.raises(ValueError):
        M.demux(b"\x00\x00")


def test_edges(spark, edge_docs, edge_rows, no_docs):
    rows = M.read_media(M.to_media(edge_docs)).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows), key=str)
    want = [(i, len((t or "").encode()), len(padded(t)), hashlib.sha256(padded(t)).hexdigest(), zlib.crc32(padded(t)[-64:])) for i, t in edge_rows]
    assert got == sorted(want, key=str)
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] == 12}) == 1
    table = M.packets(M.to_media(edge_docs)).where("doc_id = 8").orderBy("packet_no").collect()
    assert len(table) == -(-len(padded(dict(edge_rows)[8])) // M.FRAME) and table[1]["timestamp_ns"] == 64_000_000
    assert M.read_media(M.to_media(no_docs)).count() == 0
