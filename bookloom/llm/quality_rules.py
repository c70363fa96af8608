"""Quality rules: counts over a whole text, and compression bands.

Zstandard is run over the whole document and over fixed chunks of it. Text whose ratio (compressed bytes over
bytes) falls below its length's limit repeats itself; text above it is close to random bytes. Limits depend on
the length, since short texts compress worse (a frame has about 10 bytes of its own) and long ones better. A
document is rejected where the whole of it is out of its band, or where more than BAD_SHARE of its bytes lie
in chunks that are out of theirs; so a long text with one odd passage stays, and one that is junk in good
part goes although its average looks sound.

Defined results: a null text is an empty one; an empty text and one of white space have no words, ratio null,
and fail the base rules; texts of any length are measured whole, one at a time in a task's memory; repeated
rows each give a row, equal texts the same values; columns other than the two named ones are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import slices, table, utf8
from bookloom.llm.periodic_runs import numbered

#: (bytes from, least ratio, greatest ratio) of a text or chunk; a band holds up to the next one's first byte.
#: Prose of one kilobyte compresses to about half, of many to a third or more; base64 never falls below 0.75.
BANDS = ((0, 0.0, math.inf), (128, 0.30, 1.00), (512, 0.25, 0.90), (1024, 0.22, 0.85), (4096, 0.20, 0.75), (16384, 0.18, 0.72))
#: Bytes of a chunk, and the share of a document's bytes that may lie in chunks out of their band.
CHUNK = 4096
BAD_SHARE = 1 / 3
LEVEL = 3
WINDOW = 8

_SPACE = bytes([32, *range(9, 14)])
#: What a count of the code points of words leaves out: white space and continuation bytes.
_NO_CHARACTER = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def band(n: int, bands: tuple = BANDS) -> tuple[float, float]:
    """The least and greatest ratio of n bytes."""
    return next((low, high) for at, low, high in reversed(bands) if n >= at)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words stand in a window of `size` words that occurs more than once, its first place included. Windows are compared word by word (as the bytes of word numbers), not by a hash."""
    n = len(words)
    if n <= size:
        return 0
    ids = numbered(words)
    # A window with a word that occurs once occurs once.
    single = np.r_[0, np.cumsum(np.bincount(ids)[ids] == 1)]
    places = np.flatnonzero(single[size:] == single[: n - size + 1])
    if len(places) < 2:
        return 0
    raw, width, first, hit = ids.tobytes(), 4 * size, {}, np.zeros(n + 1, np.int64)
    for i in places.tolist():
        before = first.setdefault(raw[4 * i : 4 * i + width], i)
        if before != i:
            for at in (before, i):
                hit[at] += 1
                hit[at + size] -= 1
    return int(np.count_nonzero(np.cumsum(hit[:n])))


def repeated_lines(text: bytes) -> int:
    """How many lines with a word equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


class Meter:
    """Compresses texts with one reused context."""

    def __init__(self, level: int = LEVEL):
        import zstandard

        self.packed = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress

    def ratio(self, data: bytes) -> float:
        return len(self.packed(data)) / len(data)

    def verdict(self, data: bytes, chunk: int = CHUNK, bands: tuple = BANDS, bad_share: float = BAD_SHARE) -> tuple[float | None, int, int, int, bool]:
        """The ratio of the whole, chunks, chunks below and above their band, and whether the text is in its bands."""
        if not data:
            return None, 0, 0, 0, False
        whole = self.ratio(data)
        low, high = band(len(data), bands)
        below = above = bad = chunks = 0
        for at in range(0, len(data), chunk):
            piece = data[at : at + chunk]
            r = whole if len(piece) == len(data) else self.ratio(piece)
            least, most = band(len(piece), bands)
            chunks, below, above = chunks + 1, below + (r < least), above + (r > most)
            bad += len(piece) if not least <= r <= most else 0
        return whole, chunks, below, above, low <= whole <= high and bad <= bad_share * len(data)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, bands: tuple = BANDS, bad_share: float = BAD_SHARE) -> DataFrame:
    """Per row: key, the counts of the base rules, ratio, n_chunks, n_repetitive and n_incompressible (chunks), and in_bands."""
    kind = docs.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter()
        for b in slices(batches, "text"):
            rows = []
            for data in b.column(1).to_pylist():
                words = data.split()
                rows.append((len(words), len(data.translate(None, _NO_CHARACTER)), len(data) - len(data.translate(None, _SYMBOLS)), repeated_lines(data), repeated_words(words), *meter.verdict(data, chunk, bands, bad_share)))
            kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["key", *_NAMES])

    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text")).mapInArrow(measure, f"key {kind}, {_SCHEMA}")
    return rows.withColumnRenamed("key", key)


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_repetitive long, n_incompressible long, in_bands boolean"
_NAMES = [x.split(" ")[0] for x in _SCHEMA.split(", ")]


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = measured(table(spark, sf_dir, "documents")).withColumn("base_failed", failed)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return found.select(*first, (~F.col("base_failed") & F.col("in_bands")).alias("kept"), "ratio", "n_chunks", "n_repetitive", "n_incompressible")
