"""Static range asymmetric numeral system over token ids: frames that decode on their own.

A frame is little-endian:
  magic 'BLA1', crc32 of all that follows, and then
  crc32 of the frequency table, number of ids, of documents, of lanes, of checkpoints, of words, bytes of the directory (u32 each);
  the directory: zlib of document ids (i64), nulls (u8) and lengths (u32);
  per checkpoint the number of words read before it (u32) and each lane's state (u64);
  words (u32) in the order in which a decoder reads them.
Id i belongs to lane i % lanes; all lanes share one stream of words. Decoding may begin at any
checkpoint (one every CHECKPOINT ids), so parts of a frame can be decoded in parallel.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"BLA1"
#: Frequencies add up to 2**BITS; a state stays in [2**31, 2**63) and moves 32 bits at a time.
BITS, LOW = 18, 31
LANES = 1024
CHECKPOINT = 1 << 18
_HEAD = struct.Struct("<7I")


class Table:
    """Frequencies of symbols, as both sides need them."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.crc = zlib.crc32(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes())
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[symbols] = freq
        self.start[symbols] = np.cumsum(freq) - freq
        self.symbol = np.repeat(symbols.astype(np.uint32), freq)
        self.slot_freq = np.repeat(freq.astype(np.uint64), freq)
        self.slot_rest = np.arange(len(self.symbol), dtype=np.uint64) - np.repeat(np.cumsum(freq) - freq, freq).astype(np.uint64)


def quantised(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to the counts, each at least 1, that add up to 2**BITS."""
    total = 1 << BITS
    if len(symbols) > total // 2:
        raise ValueError(f"{len(symbols)} symbols need more than {BITS} bits")
    if not len(symbols):
        return np.zeros(0, np.int64)
    freq = np.maximum(1, np.floor(counts * (total / counts.sum())).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    spare = total - int(freq.sum())
    if spare >= 0:
        freq[order[0]] += spare
    while spare < 0:  # the roundings up to 1 are taken from the largest
        take = np.minimum(freq[order] - 1, -(spare // np.maximum(1, np.count_nonzero(freq > 1))))
        take = np.minimum(take, np.maximum(0, -spare - (np.cumsum(take) - take)))
        freq[order] -= take
        spare += int(take.sum())
    return freq


def encode(ids: np.ndarray, docs: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, t: Table) -> bytes:
    n, lanes = len(ids), min(LANES, max(1, len(ids) // 64))
    x = np.full(lanes, 1 << LOW, np.uint64)
    freq, start = t.freq[ids], t.start[ids]
    limit = freq << np.uint64(LOW + 32 - BITS)
    steps = -(-n // lanes)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    every = span(lanes) // lanes
    words, shift, bits = 0, np.uint64(32), np.uint64(BITS)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        y, f = x[: b - a], freq[a:b]
        full = y >= limit[a:b]
        moved = y[full]
        if len(moved):
            out.append(moved.astype("<u4"))
            words += len(moved)
            y = np.where(full, y >> shift, y)
        q = y // f
        x[: b - a] = (q << bits) + (y - q * f) + start[a:b]
        if step % every == 0:
            marks.append((words, x.copy()))
    directory = zlib.compress(docs.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<u4").tobytes(), 1)
    marks = marks[::-1] or [(0, x)]
    body = b"".join([
        _HEAD.pack(t.crc, n, len(docs), lanes, len(marks), words, len(directory)), directory,
        *(struct.pack("<I", words - w) + s.astype("<u8").tobytes() for w, s in marks),
        *(w.tobytes() for w in reversed(out)),
    ])
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def parse(frame: bytes) -> dict:
    """The parts of a frame, after its checksum has been verified."""
    if frame[:4] != MAGIC or struct.unpack_from("<I", frame, 4)[0] != zlib.crc32(memoryview(frame)[8:]):
        raise ValueError("a frame is damaged")
    crc, n, docs, lanes, marks, words, size = _HEAD.unpack_from(frame, 8)
    at = 8 + _HEAD.size
    d = zlib.decompress(frame[at : at + size])
    at += size
    points = []
    for _ in range(marks):
        points.append((struct.unpack_from("<I", frame, at)[0], np.frombuffer(frame, "<u8", lanes, at + 4)))
        at += 4 + 8 * lanes
    return {
        "table": crc, "n": n, "lanes": lanes, "points": points, "words": np.frombuffer(frame, "<u4", words, at),
        "docs": np.frombuffer(d, "<i8", docs), "nulls": np.frombuffer(d, "u1", docs, 8 * docs), "lengths": np.frombuffer(d, "<u4", docs, 9 * docs),
    }


def decode(p: dict, t: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids between two checkpoints (all by default). The spans from each checkpoint to the next are decoded side by side, each from its own lanes and place among the words."""
    if p["table"] != t.crc:
        raise ValueError("a frame was written with another frequency table")
    lanes, n, words = p["lanes"], p["n"], p["words"]
    every = span(lanes) // lanes
    points = p["points"][first:last]
    begin, end = first * every * lanes, min(n, (first + len(points)) * every * lanes)
    if end <= begin:
        return np.empty(0, np.uint32)
    steps = min(every, -(-(end - begin) // lanes))
    at, x = np.array([w for w, _ in points], np.int64), np.concatenate([state for _, state in points]).astype(np.uint64)
    out = np.empty((len(points), steps * lanes), np.uint32)
    mask, bits, shift, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64(1 << LOW)
    tail = end - begin - (len(points) - 1) * every * lanes  # ids of the last span, the only one that may be short
    for a in range(0, steps * lanes, lanes):
        live = (len(points) - 1) * lanes + max(0, min(lanes, tail - a))
        y = x[:live]
        slot = y & mask
        found, full = t.symbol[slot], live // lanes
        out[:full, a : a + lanes] = found[: full * lanes].reshape(full, lanes)
        if rest := live - full * lanes:
            out[full, a : a + rest] = found[full * lanes :]
        y = t.slot_freq[slot] * (y >> bits) + t.slot_rest[slot]
        need = np.flatnonzero(y < low)
        if len(need):
            each = np.bincount(need // lanes, minlength=len(points))
            y[need] = y[need] << shift | words[np.repeat(at - (np.cumsum(each) - each), each) + np.arange(len(need))]
            at += each
        x[:live] = y
    return out.reshape(-1)[: end - begin]


def span(lanes: int) -> int:
    """Ids between two checkpoints: whole turns of the lanes."""
    return max(1, CHECKPOINT // lanes) * lanes


def between(p: dict, t: Table, start: int, stop: int) -> np.ndarray:
    """The ids at the places start to stop of a frame, read from the last checkpoint before them to the first behind."""
    start, stop, every = max(0, start), min(p["n"], stop), span(p["lanes"])
    if stop <= start:
        return np.empty(0, np.uint32)
    first = start // every
    return decode(p, t, first, -(-stop // every))[start - first * every : stop - first * every]
