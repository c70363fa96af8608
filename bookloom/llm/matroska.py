"""Matroska: packet tables of EBML media in a binary column, and a writer for PCM samples.

`packets` parses variable-length elements, clusters, simple and grouped blocks with Xiph, EBML and
fixed lacing, and cues; a row per packet has its track, timestamp and byte range. `mux` stores bytes
as 8-bit PCM in such a file, so that the parser can be held against exact contents.

Defined results: null or empty media has no packets; media cut short gives the packets before the
cut and `error`; elements of unknown size end where a parent's next element begins; unknown elements
are skipped; equal rows give equal rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import table, utf8

# Element identifiers of the format.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x1A45DFA3, 0x4282, 0x4287, 0x4285, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, INFO, TRACKS, TRACK_ENTRY, AUDIO}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: A frame has so many samples (192 ms at 8 kHz), a block so many frames, a cluster so many blocks.
FRAME, BLOCK_FRAMES, CLUSTER_BLOCKS, HZ = 1536, 8, 16, 8000
UNIT = 192


class Packet(NamedTuple):
    track: int
    timestamp: int
    lacing: str
    position: int
    start: int
    length: int
    key: bool
    cluster: int


def vint(n: int, length: int = 0) -> bytes:
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing flag and what goes before the frames: fixed for equal sizes, Xiph for two, EBML otherwise."""
    if len(frames) == 1:
        return 0, b""
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 2, bytes([len(sizes) - 1])
    if len(sizes) == 2:
        return 1, bytes([1]) + b"\xff" * (sizes[0] // 255) + bytes([sizes[0] % 255])
    head = [vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        length = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
        head.append(vint(b - a + (1 << 7 * length - 1) - 1, length))
    return 3, bytes([len(sizes) - 1]) + b"".join(head)


#: SimpleBlock and Cues need version 2.
_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 2) + number(DOC_TYPE_READ_VERSION, 2))
_ABOUT = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"bookloom") + element(WRITING_APP, b"bookloom")) + element(
    TRACKS,
    element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", HZ)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))),
)


def mux(samples: bytes) -> bytes:
    """A Matroska file with these 8-bit samples as its one audio track."""
    parts, cues, at = [_ABOUT], [], len(_ABOUT)
    step = FRAME * BLOCK_FRAMES
    for c in range(0, len(samples), step * CLUSTER_BLOCKS):
        time = c * 1000 // HZ
        body = [number(CLUSTER_TIMESTAMP, time)]
        for b in range(c, min(len(samples), c + step * CLUSTER_BLOCKS), step):
            frames = [samples[i : i + FRAME] for i in range(b, min(len(samples), b + step), FRAME)]
            flag, head = lace(frames)
            block = b"\x81" + struct.pack(">hB", b * 1000 // HZ - time, flag << 1 | 0x80 * (b == c)) + head + b"".join(frames)
            last = b + step >= len(samples)
            body.append(element(BLOCK_GROUP, element(BLOCK, block) + number(BLOCK_DURATION, sum(map(len, frames)) * 1000 // HZ)) if last else element(SIMPLE_BLOCK, block))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """The number at `at` and where it ends; -1 if its size is unknown. keep: with the length marker, as in identifiers."""
    first = data[at]
    if not first:
        raise ValueError("a number of more than 8 bytes")
    length = 9 - first.bit_length()
    if at + length > len(data):
        raise ValueError("cut short")
    n = int.from_bytes(data[at : at + length], "big")
    if keep:
        return n, at + length
    n -= 1 << 7 * length
    return (-1 if n == (1 << 7 * length) - 1 else n), at + length


def laced(data: bytes, at: int, end: int, flag: int) -> tuple[int, list[int]]:
    """Where the first frame of a block begins, and the sizes of its frames."""
    if not flag:
        return at, [end - at]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if flag == 2:
        if (end - at) % count:
            raise ValueError("frames of a fixed lace differ")
        return at, [(end - at) // count] * count
    for _ in range(count - 1):
        if flag == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            was = at
            n, at = read_vint(data, at)
            if sizes:
                n = sizes[-1] + n - ((1 << 7 * (at - was) - 1) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    return at, sizes


def demux(data: bytes) -> dict:
    """packets, cues as (time, track, offset of the cluster in the file), scale, and error (None if whole)."""
    out: dict = {"packets": [], "cues": [], "scale": 1_000_000, "clusters": 0, "blocks": 0, "error": None}
    ends: list[tuple[int, int]] = []  # of the masters that are open: identifier, end
    at, time, cluster, segment, cue = 0, 0, 0, 0, [0, 0]
    try:
        while at < len(data):
            while ends and at >= ends[-1][1]:
                ends.pop()
            begin = at
            kind, at = read_vint(data, at, keep=True)
            size, at = read_vint(data, at)
            if kind in (CLUSTER, CUES, INFO, TRACKS):  # what ends a cluster of unknown size
                while ends and ends[-1][0] != SEGMENT:
                    ends.pop()
            end = len(data) if size < 0 else at + size
            if end > len(data) and kind not in MASTERS:
                raise ValueError("cut short")
            if kind in MASTERS:
                ends.append((kind, min(end, ends[-1][1] if ends else len(data)) if size < 0 else end))
                if kind == SEGMENT:
                    segment = at
                elif kind == CLUSTER:
                    cluster, time = begin, 0
                    out["clusters"] += 1
                continue
            if kind in (SIMPLE_BLOCK, BLOCK):
                track, p = read_vint(data, at)
                shift, flags = struct.unpack_from(">hB", data, p)
                first, sizes = laced(data, p + 3, end, flags >> 1 & 3)
                key = bool(flags & 0x80)
                for i, n in enumerate(sizes):
                    out["packets"].append(Packet(track, time + shift, LACINGS[flags >> 1 & 3], i, first, n, key, cluster))
                    first += n
                out["blocks"] += 1
            elif kind in (CLUSTER_TIMESTAMP, TIMESTAMP_SCALE, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                n = int.from_bytes(data[at:end], "big")
                if kind == CLUSTER_TIMESTAMP:
                    time = n
                elif kind == TIMESTAMP_SCALE:
                    out["scale"] = n
                elif kind == CUE_CLUSTER:
                    out["cues"].append((cue[0], cue[1], segment + n))
                else:
                    cue[kind == CUE_TRACK] = n
            at = end
        if ends and max(e for _, e in ends) > len(data):
            raise ValueError("cut short")
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e) or type(e).__name__
    return out


def packets(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row per packet: key, track, timestamp_ns (of its block), lacing, position (in its lace), start and length in the media, keyframe, cluster (its offset), cued (a cue names that cluster), error (of the media)."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, track long, timestamp_ns long, lacing string, position int, start long, length long, keyframe boolean, cluster long, cued boolean, error string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, m in enumerate(b.column(1)):
                got = demux(m.as_py() or b"")
                if got["packets"]:
                    p, cued = list(zip(*got["packets"], strict=True)), {c[2] for c in got["cues"]}
                    n = len(p[0])
                    columns = [pa.array([t * got["scale"] for t in p[1]], pa.int64()), pa.array(p[2]), pa.array(p[3], pa.int32()), pa.array(p[4], pa.int64()), pa.array(p[5], pa.int64()), pa.array(p[6]), pa.array(p[7], pa.int64()), pa.array([c in cued for c in p[7]]), pa.array([got["error"]] * n, pa.string())]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n)), pa.array(p[0], pa.int64()), *columns], [x.split()[0] for x in schema.split(", ")])

    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(parse, schema).withColumnRenamed("key", key)


def features(samples: np.ndarray, got: dict) -> str:
    """A description of the samples and of how they were stored."""
    x = samples.astype(np.float64)
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    laces = "+".join(sorted({p.lacing for p in got["packets"]}))
    return f"packets={len(got['packets'])};blocks={got['blocks']};clusters={got['clusters']};cues={len(got['cues'])};lacing={laces};ms={len(samples) * 1000 // HZ};mean={x.mean():.4f};sd={x.std():.4f};crossings={crossings}"


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as samples, parses the file, and describes what the packets hold (see op10)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                media = mux(t + b" " * (-len(t) % UNIT if t else UNIT))
                got = demux(media)
                back = b"".join([media[p.start : p.start + p.length] for p in got["packets"]])
                rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(back, np.uint8), got)))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(key).alias("key"), utf8(text).alias("text")).mapInArrow(store, schema).withColumnRenamed("key", key)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
