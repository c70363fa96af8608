"""Periodic runs of words, found by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q and a length of at least max(12, 2 * q) that no
neighbouring word extends. For each lag the matches (equal words that far apart) are counted exactly: frequent
words by an FFT autocorrelation of where they stand, rare ones by the differences of their places. A run of
period q has at least max(12 - q, q) matches at lag q, so only lags with as many are scanned for islands of
consecutive matches. Matches inside a run of a shorter period that divides the lag are known from that run
and taken off first: no match of a run with smallest period q is among them (two stretches with different
smallest periods overlap in less than the sum of the two), so nothing is lost, and a text that repeats
one word is scanned once instead of at every lag.

Defined results: a null text is an empty one; texts without words have no runs and collapse to an empty text;
a text is taken whole, one at a time in a task, in arrays of some times its number of words; repeated rows each
give a row; columns other than the two named ones are ignored, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import slices, table, utf8

#: Words of the shortest run.
SHORTEST = 12
#: From this lag on, a scan looks at one place for each island that could be there, and around those that match.
SPARSE = 64


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each different word, in order of appearance."""
    number = defaultdict(itertools.count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def lag_counts(ids: np.ndarray) -> np.ndarray:
    """For each lag up to half the length: how many words equal the one that far on.

    A word is heavy where its pairs would cost more than a transform. The power spectra of heavy words are
    added up and transformed back once; the values are whole numbers, and the error of a transform of n
    doubles is far below a half for any text that fits a task (about 1e-15 * n ** 1.5).
    """
    n = len(ids)
    most = n // 2
    counts = np.zeros(most + 1, np.int64)
    if most == 0:
        return counts
    size = 1 << (2 * n - 1).bit_length()
    order = np.argsort(ids, kind="stable")
    often = np.bincount(ids)
    heavy = np.flatnonzero(often.astype(np.int64) ** 2 > 2 * size * size.bit_length())
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for w in heavy.tolist():
            spectrum = np.fft.rfft(ids == w, size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    is_heavy = np.zeros(len(often), bool)
    is_heavy[heavy] = True
    places = order[~is_heavy[ids[order]]]
    words = ids[places]
    at = np.arange(len(places))
    for k in range(1, len(places)):
        at = at[: np.searchsorted(at, len(places) - k)]
        at = at[words[at + k] == words[at]]
        if not len(at):
            break
        gap = places[at + k] - places[at]
        near = gap <= most  # places rise within a word, so what is too far stays too far
        at, gap = at[near], gap[near]
        counts += np.bincount(gap, minlength=most + 1)
    counts[0] = n
    return counts


def extent(ids: np.ndarray, q: int, i: int) -> tuple[int, int]:
    """The island of consecutive matches at lag q around the match at i, as [first, end)."""
    n, step, end = len(ids) - q, 32, i + 1
    while end < n:
        same = ids[end : min(n, end + step)] == ids[end + q : min(n, end + step) + q]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = end + len(same), 2 * step
    step, first = 32, i
    while first > 0:
        low = max(0, first - step)
        same = (ids[low:first] == ids[low + q : first + q])[::-1]
        if not same.all():
            first -= int(same.argmin())
            break
        first, step = low, 2 * step
    return first, end


def islands(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """All maximal stretches [first, end) of at least `least` consecutive matches at lag q."""
    n = len(ids) - q
    if n < least:
        return []
    if least < SPARSE:
        same = np.zeros(n + 2, np.int8)
        same[1:-1] = ids[:-q] == ids[q:]
        change = np.diff(same)
        first, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = end - first >= least
        return list(zip(first[long].tolist(), end[long].tolist(), strict=True))
    # Each island holds a multiple of `least`, and matches on at least least // 2 places to one side of it.
    places = np.arange(0, n, least)
    places = places[ids[places] == ids[places + q]]
    left = right = places
    for k in range(1, min(16, least // 2)):
        right = right[np.flatnonzero(right + k < n)]
        right = right[ids[right + k] == ids[right + k + q]]
        left = left[np.flatnonzero(left >= k)]
        left = left[ids[left - k] == ids[left - k + q]]
        if not len(left) and not len(right):
            return []
    found, upto = [], 0
    for i in np.union1d(left, right).tolist():
        if i >= upto:
            first, upto = extent(ids, q, i)
            if upto - first >= least:
                found.append((first, upto))
    return found


def prime_divisors(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*found, q] if q > 1 else found


def runs(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start and then period."""
    n, found = len(ids), []
    counts = lag_counts(ids)
    lags = np.arange(len(counts))
    least = np.maximum(shortest - lags, lags)
    for q in (np.flatnonzero(counts[1:] >= least[1:]) + 1).tolist():
        if counts[q] < least[q]:  # a shorter period has explained them
            continue
        for first, end in islands(ids, q, int(least[q])):
            stretch = ids[first : end + q]
            if any(np.array_equal(stretch[: -(q // r)], stretch[q // r :]) for r in prime_divisors(q)):
                continue
            length = len(stretch)
            found.append((first, length, q))
            again = np.arange(2 * q, min(length, len(counts)), q)
            counts[again] -= length - again
    return sorted(found, key=lambda r: (r[0], r[2])) if n else []


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: key, n_words, runs (start, length, period; by start, then period) and collapsed, the text without repeats. prepare(key, words) gives the words to look at, if not the text's own."""
    kind = docs.schema[key].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sizes, every, texts = [], [], []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = data.split()
                if prepare:
                    words = prepare(k, words)
                found = runs(numbered(words), shortest)
                sizes.append(len(words))
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(collapsed(words, found)).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(every, pa.list_(run)), pa.array(texts, pa.string())], ["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text")).mapInArrow(find, f"key {kind}, n_words long, runs {RUNS}, collapsed string")
    return rows.withColumnRenamed("key", key)


def rewritten(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: every tenth document by its id's checksum goes on with one stretch repeated. A null key changes nothing."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * math.ceil((n - a) / p))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), prepare=rewritten)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = found.select("*", best.alias("best"), lines.alias("lines"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
