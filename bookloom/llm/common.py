"""Helpers that several operators share: tables, the shared folder, and byte-level word scanning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters by byte: everything but space and \t..\r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Letters and digits in ASCII, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: What Spark hands a Python worker at a time, unless the session says otherwise; a worker and its JVM hold a few such batches.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(8 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and bytes where it has Spark's own defaults."""
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, default) in (default, f"{default}b"):
            spark.conf.set(name, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one in local mode, as in tests, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/bookloom-shared"
    return f"{base.rstrip('/')}/bookloom"


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str) -> F.Column:
    """A text column as its bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


#: Keys of rows that go are broadcast up to so many (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def text_hash(text: str) -> F.Column:
    """Tells apart rows that share a key."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__ and so on that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs that are not in gone (gone_key, gone_hash: key, which may be null, and text_hash)."""
    k, h = fresh(docs, "gone_key"), fresh(docs, "gone_hash")
    gone = materialize(gone.toDF("gone_key", "gone_hash").distinct(), "gone").toDF(k, h)
    few = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = (text_hash(text) == F.col(h)) & F.col(key).eqNullSafe(F.col(k))
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), same, "left_anti")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has at most `most` bytes in a column, or one row: bounds a task's memory."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.diff(offsets(b.column(column)))
        ends, start, total = [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                ends.append(i)
                total = 0
            total += n
        for end in [*ends, b.num_rows]:
            yield b.slice(start, end - start)
            start = end


def offsets(a: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins and ends."""
    off = offsets(a)
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as [start, end) in data, never across values, and the index of the first word of each value (with the total last)."""
    n = len(data)
    w = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begin, end = w.copy(), np.zeros(n + 1, bool)
    if n:
        begin[1:] &= ~w[:-1] | cut[1:n]
        end[1:] = w
        end[1:n] &= ~w[1:] | cut[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    return s, e, np.searchsorted(s, off)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each [s, e), from prefix sums of a polynomial modulo 2**64."""
    n = len(data)
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p)]) for p in (_P, _PINV)]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=total[1:])
    return mix((total[e] - total[s]) * _powers[1][s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of all values, and the bounds of each value's part.

    Words are runs without white space, A-Z lower-cased; a value with fewer than k words has one
    shingle of all of them, one without words has none.
    """
    data = LOWER[data]
    s, e, first = spans(data, off, NOT_SPACE)
    h = word_hashes(data, s, e)
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    bounds = np.r_[0, np.cumsum(count)]
    out = np.empty(bounds[-1], np.uint64)
    long = np.flatnonzero(words >= k)
    if len(long):
        at = np.repeat(first[:-1][long] - np.r_[0, np.cumsum(count[long])[:-1]], count[long]) + np.arange(count[long].sum())
        v = np.zeros(len(at), np.uint64)
        for j in range(k):
            v = mix(v + h[at + j] + np.uint64(j + 1))
        to = np.repeat(bounds[:-1][long] - np.r_[0, np.cumsum(count[long])[:-1]], count[long]) + np.arange(count[long].sum())
        out[to] = v
    for i in np.flatnonzero((words > 0) & (words < k)):
        v = np.full(1, words[i], np.uint64) * np.uint64(0xA24BAED4963EE407)
        for j in range(first[i], first[i + 1]):
            v = mix(v + h[j])
        out[bounds[i]] = v[0]
    return out, bounds
