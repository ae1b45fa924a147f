"""Media columns in Matroska: writing and parsing EBML without outside tools.

A payload is stored as 8-bit PCM samples of one audio track: frames of `FRAME` samples, `LACED` frames to a block,
`BLOCKS` blocks to a cluster, cues for every cluster. Full blocks use fixed-size lacing, others EBML lacing. The parser
reads variable-length element ids and sizes (unknown sizes of segment and clusters too), SimpleBlocks and BlockGroups,
all four kinds of lacing and cues, and gives a packet table of track, timestamp, byte range, key flag and cluster.

Defined results: a null text is the empty text; a payload is padded with zero bytes to a multiple of 64, 64 at least;
equal texts give equal media and features; repeated rows each get their row; null media has no packets. Truncated or
malformed media ends with ValueError. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.llm.common import slices, stored, table, utf8

# Element ids, fixed values of the format (RFC 8794, RFC 9559).
EBML, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
SEGMENT, INFO, SCALE, MUXER, WRITER, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, RATE_HZ, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster or segment of unknown size.
_UPPER = {CLUSTER, CUES, TRACKS, INFO, SEGMENT}

RATE = 8000
FRAME, LACED, BLOCKS = 512, 8, 8
PER_MS = RATE // 1000
ALIGN = 64


# --- writing -----------------------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """n as a variable-length size."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    """A difference of EBML lacing."""
    width = 1
    while not -(1 << 7 * width - 1) < n < 1 << 7 * width - 1:
        width += 1
    return vint(n + (1 << 7 * width - 1) - 1, width)


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2))
_TRACKS = element(TRACKS, element(TRACK, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE_HZ, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))
_INFO = uint(SCALE, 1_000_000) + element(MUXER, b"payloom") + element(WRITER, b"payloom")


def block(frames: list[bytes], relative: int) -> bytes:
    """A SimpleBlock of track 1."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        flags, lace = 0, b""
    elif len(set(sizes)) == 1:
        flags, lace = 2, bytes([len(frames) - 1])
    else:
        flags, lace = 3, bytes([len(frames) - 1]) + vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, 0x80 | flags << 1) + lace + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose samples are the payload's bytes."""
    per_block, per_cluster = FRAME * LACED, FRAME * LACED * BLOCKS
    body = element(INFO, _INFO + element(DURATION, struct.pack(">d", len(payload) / PER_MS))) + _TRACKS
    parts, at, cues = [body], len(body), []
    for c in range(0, len(payload), per_cluster):
        start = c // PER_MS
        blocks = [uint(TIMESTAMP, start)]
        for b in range(c, min(c + per_cluster, len(payload)), per_block):
            end = min(b + per_block, len(payload))
            blocks.append(block([payload[f : min(f + FRAME, end)] for f in range(b, end, FRAME)], b // PER_MS - start))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE, uint(CUE_TIME, start) + element(CUE_TRACKS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# --- parsing -----------------------------------------------------------------------------------------------------


@dataclass
class Media:
    doc_type: str = ""
    scale_ns: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ticks, start, end, key, cluster's place in the segment)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    #: (time, track, cluster's place in the segment)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length number and the place behind it; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"bad variable-length number at {at}")
    width = 9 - data[at].bit_length()
    end = at + width
    if end > len(data):
        raise ValueError(f"truncated at {at}")
    raw = int.from_bytes(data[at:end], "big")
    if keep_marker:
        return raw, end
    value = raw & (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), end


def elements(data: bytes, at: int, end: int, open_ended: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, start of body, end of body) of the elements in a range."""
    while at < end:
        place = at
        name, at = read_vint(data, at, keep_marker=True)
        if open_ended and name in _UPPER:
            return
        size, at = read_vint(data, at)
        stop = at + size
        if size < 0:
            if name not in (SEGMENT, CLUSTER):
                raise ValueError(f"unknown size at {place}")
            stop = end
            if name == CLUSTER:
                stop = max([b for _, _, _, b in elements(data, at, end, open_ended=True)], default=at)
        if stop > end:
            raise ValueError(f"element at {place} ends behind its parent")
        yield name, place, at, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first starts; kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [end - at], at
    if at >= end:
        raise ValueError("a laced block has no frame count")
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError("frames of fixed size don't fill their block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= end:
                    raise ValueError("truncated lacing")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            start = at
            size, at = read_vint(data, at)
            if i:
                size += sizes[-1] - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("frames are larger than their block")
    return [*sizes, last], at


def _block(out: Media, data: bytes, a: int, b: int, time: int, cluster: int, key: bool | None) -> None:
    track, at = read_vint(data, a)
    if at + 3 > b:
        raise ValueError("truncated block")
    relative, flags = struct.unpack_from(">hB", data, at)
    sizes, at = lace_sizes(data, at + 3, b, flags >> 1 & 3)
    bits = out.tracks.get(track, {}).get("bit_depth", 8) * out.tracks.get(track, {}).get("channels", 1)
    rate, first = out.tracks.get(track, {}).get("rate", 0), at
    for size in sizes:
        ticks = int((at - first) * 8 * 1_000_000_000 // (bits * rate * out.scale_ns)) if rate else 0
        out.packets.append((track, time + relative + ticks, at, at + size, bool(flags & 0x80) if key is None else key, cluster))
        at += size


def demux(data: bytes) -> Media:
    """The tracks, packets and cues of a Matroska file."""
    out = Media()
    for name, _, a, b in elements(data, 0, len(data)):
        if name == EBML:
            for k, _, x, y in elements(data, a, b):
                if k == DOC_TYPE:
                    out.doc_type = data[x:y].rstrip(b"\0").decode("ascii")
        elif name == SEGMENT:
            for top, place, x, y in elements(data, a, b):
                if top == INFO:
                    out.scale_ns = next((_number(data, i, j) for k, _, i, j in elements(data, x, y) if k == SCALE), out.scale_ns)
                elif top == TRACKS:
                    for k, _, i, j in elements(data, x, y):
                        if k == TRACK:
                            _track(out, data, i, j)
                elif top == CLUSTER:
                    time = 0
                    for k, _, i, j in elements(data, x, y):
                        if k == TIMESTAMP:
                            time = _number(data, i, j)
                        elif k == SIMPLE_BLOCK:
                            _block(out, data, i, j, time, place - a, None)
                        elif k == GROUP:
                            inner = list(elements(data, i, j))
                            for g, _, p, q in inner:
                                if g == BLOCK:
                                    _block(out, data, p, q, time, place - a, all(z[0] != 0xFB for z in inner))
                elif top == CUES:
                    for k, _, i, j in elements(data, x, y):
                        if k == CUE:
                            fields = list(elements(data, i, j))
                            when = next((_number(data, p, q) for g, _, p, q in fields if g == CUE_TIME), 0)
                            for g, _, p, q in fields:
                                if g == CUE_TRACKS:
                                    inner = {z: _number(data, m, n) for z, _, m, n in elements(data, p, q)}
                                    out.cues.append((when, inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER, 0)))
    return out


def _track(out: Media, data: bytes, a: int, b: int) -> None:
    track: dict = {"channels": 1}
    number = 0
    for k, _, i, j in elements(data, a, b):
        if k == TRACK_NUMBER:
            number = _number(data, i, j)
        elif k == CODEC:
            track["codec"] = data[i:j].decode("ascii")
        elif k == TRACK_TYPE:
            track["type"] = _number(data, i, j)
        elif k == AUDIO:
            for g, _, p, q in elements(data, i, j):
                if g == RATE_HZ:
                    track["rate"] = struct.unpack(">d" if q - p == 8 else ">f", data[p:q])[0]
                elif g == CHANNELS:
                    track["channels"] = _number(data, p, q)
                elif g == BIT_DEPTH:
                    track["bit_depth"] = _number(data, p, q)
    out.tracks[number] = track


def payload_of(data: bytes, media: Media | None = None, track: int = 1) -> bytes:
    media = media or demux(data)
    return b"".join(data[a:b] for t, _, a, b, _, _ in media.packets if t == track)


def feature(payload: bytes, media: Media) -> str:
    """Packets, clusters, cues, duration, and mean, deviation and steps of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    clusters = {p[5] for p in media.packets}
    last = media.packets[-1][1] if media.packets else 0
    steps = float(np.abs(np.diff(x)).mean()) if len(x) > 1 else 0.0
    mean, deviation = (float(x.mean()), float(x.std())) if len(x) else (0.0, 0.0)
    return f"packets={len(media.packets)};clusters={len(clusters)};cues={len(media.cues)};last_ms={last};mean={mean:.4f};deviation={deviation:.4f};step={steps:.4f}"


# --- columns -----------------------------------------------------------------------------------------------------


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's bytes, padded, as a Matroska file."""
    rows = docs.select(F.col(id_col), utf8(F.col(text_col)).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            media = [mux(t + bytes(-len(t) % ALIGN if t else ALIGN)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, n_bytes long, media binary")


def packets(rows: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: id, packet_no, track, timestamp_ns, start, end, key, cluster."""
    rows = rows.select(F.col(id_col), F.col(media_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                found = demux(data.as_py()) if data.is_valid else Media()
                table = [(n, t, ts * found.scale_ns, a, b, k, c) for n, (t, ts, a, b, k, c) in enumerate(found.packets)]
                if table:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(table), batch.schema.field(0).type), *(pa.array(col, kind) for col, kind in zip(zip(*table), [pa.int64()] * 5 + [pa.bool_(), pa.int64()]))], [id_col, "packet_no", "track", "timestamp_ns", "start", "end", "key", "cluster"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, packet_no long, track long, timestamp_ns long, start long, end long, key boolean, cluster long")


def read_media(rows: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, n_bytes, and what the stored bytes give: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    rows = rows.select(F.col(id_col), "n_bytes", F.col(media_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for data in batch.column(2).to_pylist():
                found = demux(data)
                payload = payload_of(data, found)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, found)))
            columns = zip(*out) if out else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(stored(to_media(table(spark, sf_dir, "documents")), "media"))


QUERIES = {"op7_matroska": op7_matroska}
ORACLES: dict[str, str] = {}
