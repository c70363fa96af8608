"""Benchmark decontamination: a prefix-filtered set join of documents with windows of benchmark items.

A window is `width` consecutive words of an item (all its words if it has fewer). Its shingles are its
pairs of neighbouring words (of a window of one word, the word). Shingles are ordered by rarity, that is
by how many times they occur in all documents; since a window must be contained whole, its necessary
prefix is its one rarest shingle, and a window with a shingle that no document has is left out. Places of
documents that may hold a prefix are rows with the words around them; they are joined with the windows on
the shingle, the length and position bounds fix where the window would lie, and its bytes are compared there.

Scale: tables of windows, shingles, counts and places are all Spark tables, and only a bitmap of shingles
of at most FILTER_BITS bits goes through the driver; it lets through what the join then drops. Up to FEW
windows of FEW_BYTES together are broadcast to the places; beyond, both are shuffled by shingle and salt,
so that a shingle with very many places is the work of SALTS tasks or more.

Defined results: null and empty texts have no words and no hits; items without words have no windows;
windows of items with a null key hit but are not named; repeated items each count; repeated documents each
give a row; texts of any length work; other columns are ignored, whatever their names; empty tables give no
hits or no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom.llm.common import ALNUM, LOWER, materialize, mix, raw, slices, spans, table, text_hash, utf8, without, word_hashes

WIDTH = 10
#: Windows are broadcast up to so many, and so many bytes.
FEW, FEW_BYTES = 100_000, 16 << 20
#: Into how many parts places and windows of one shingle are dealt where both are shuffled.
SALTS = 16
#: Bits of a bitmap for each shingle in it, and at most.
BITS_EACH, FILTER_BITS = 1024, 1 << 27
#: Distinct shingles that a task counts before it hands them on, and rows that it returns at a time.
COUNTED, RETURNED = 1 << 20, 1 << 14

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return _WORDS.findall(text.lower())


def windows(items: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(item, window): every window of every item as its words joined by spaces, once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(t)
                found = list({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}) if w else []
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    return items.select(F.col(key).cast("string").alias("item"), utf8(text).alias("text")).mapInArrow(cut, "item string, window binary").distinct()


class Words:
    """The words of a batch of texts: [begin, end) of each, the first of each text (the total last), and hashes of shingles."""

    def __init__(self, texts: pa.Array):
        data, off = raw(texts)
        self.data = LOWER[data]
        self.begin, self.end, self.first = spans(self.data, off, ALNUM)
        h = word_hashes(self.data, self.begin, self.end)
        self.word = mix(h + np.uint64(3))
        self.pair = mix(h + mix(np.r_[h[1:], np.zeros(min(1, len(h)), np.uint64)] + np.uint64(2)))
        #: The last word of a text begins no pair.
        self.paired = np.ones(len(h), bool)
        self.paired[self.first[1:][np.diff(self.first) > 0] - 1] = False

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words, a space after each, and where each begins and ends in that."""
        size = self.end - self.begin
        begin = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[begin + size] = False
        out[inside] = self.data[ALNUM[self.data]]
        return out.tobytes(), begin, begin + size


def shingled(cut: DataFrame) -> DataFrame:
    """(window, size, at, byte_at, token): every shingle of every window, the word and byte of the window at which it begins."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "window"):
            w = Words(b.column("window"))
            size = np.diff(w.first)
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - w.first[row]
            off = np.r_[0, np.cumsum([len(x) for x in b.column("window").to_pylist()])]
            token = np.where(size[row] == 1, w.word, w.pair)
            keep = w.paired | (size[row] == 1)
            row, at, token, byte_at = row[keep], at[keep], token[keep], (w.begin - off[row])[keep]
            yield pa.RecordBatch.from_arrays([b.column("window").take(pa.array(row)), pa.array(size[row], pa.int64()), pa.array(at, pa.int64()), pa.array(byte_at, pa.int64()), pa.array(token.view(np.int64))], ["window", "size", "at", "byte_at", "token"])

    return cut.select("window").distinct().mapInArrow(split, "window binary, size long, at long, byte_at long, token long")


class Filter:
    """A bitmap of tokens: has() is true for each of them and for few others."""

    def __init__(self, tokens: DataFrame):
        n = tokens.count()
        bits = min(FILTER_BITS, max(1 << 16, 1 << (n * BITS_EACH).bit_length()))
        self.mask, self.packed = np.uint64(bits - 1), np.zeros(bits // 8, np.uint8)
        bit = F.col("token").bitwiseAND(F.lit(bits - 1))
        # At most FILTER_BITS / 32768 rows of 4096 bytes.
        for r in tokens.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("map")).toLocalIterator():
            self.packed[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["map"]), np.uint8)

    def has(self, token: np.ndarray) -> np.ndarray:
        bit = token & self.mask
        return (self.packed[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def occurrences(docs: DataFrame, known: Broadcast, single: bool, text: str) -> DataFrame:
    """(token, n): how many times shingles that the filter lets through occur in all documents, summed in each task before the shuffle."""

    def handed(total: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        token, where = np.unique(np.concatenate([t for t, _ in total]), return_inverse=True)
        return token, np.bincount(where, np.concatenate([n for _, n in total]), len(token)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total, held = known.value, [], 0
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            token = w.pair[w.paired & of.has(w.pair)]
            if single:
                token = np.r_[token, w.word[of.has(w.word)]]
            total.append(np.unique(token, return_counts=True))
            held += len(total[-1][0])
            if held > COUNTED:
                total = [handed(total)]
                held = len(total[0][0])
                if held > COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(total[0][0].view(np.int64)), pa.array(total[0][1])], ["token", "n"])
                    total, held = [], 0
        if total:
            token, n = handed(total)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return docs.select(utf8(text).alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, cut: DataFrame, text: str) -> tuple[DataFrame, bool]:
    """(window, size, at, byte_at, token) with the one shingle of each window that is rarest in docs, for windows whose shingles all occur; and whether any has one word."""
    every = materialize(shingled(cut), "shingles")
    single = every.where("size = 1").limit(1).count() > 0
    known = docs.sparkSession.sparkContext.broadcast(Filter(every.select("token").distinct()))
    counts = occurrences(docs, known, single, text)
    rarest = every.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at", "byte_at", "size")).alias("r"))
    found = materialize(rarest.where("r.n > 0").select("window", "r.size", "r.at", "r.byte_at", "r.token"), "prefixes")
    known.unpersist()
    return found, single


def places(docs: DataFrame, wanted: Broadcast, width: int, single: bool, rows: bool, key: str, text: str) -> DataFrame:
    """A row (token, place, place_byte, around) for every place of a document with a shingle that the filter lets through: its word, and the
    width - 1 words before and after in one string, the shingle at place_byte; with rows also one for each document, with n_words alone."""
    kind = docs.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = wanted.value
        names = ["key", "hash", "n_words", "token", "place", "place_byte", "around"]
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            if rows:
                empty = [pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("hash"), pa.array(np.diff(w.first), pa.int64()), *empty], names)
            at = np.flatnonzero(w.paired & of.has(w.pair))
            token = w.pair[at]
            if single:
                alone = np.flatnonzero(of.has(w.word))
                at, token = np.r_[at, alone], np.r_[token, w.word[alone]]
            if not len(at):
                continue
            row = np.searchsorted(w.first, at, "right") - 1
            joined, begin, end = w.joined()
            start = begin[np.maximum(w.first[row], at - width + 1)]
            stop = end[np.minimum(w.first[row + 1], at + width) - 1]
            for k in range(0, len(at), RETURNED):
                c = slice(k, k + RETURNED)
                around = [joined[x:y] for x, y in zip(start[c].tolist(), stop[c].tolist(), strict=True)]
                r = pa.array(row[c])
                columns = [pa.nulls(len(r), pa.int64()), pa.array(token[c].view(np.int64)), pa.array(at[c] - w.first[row[c]], pa.int64()), pa.array(begin[at[c]] - start[c], pa.int64()), pa.array(around, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("key").take(r), b.column("hash").take(r), *columns], names)

    schema = f"key {kind}, hash long, n_words long, token long, place long, place_byte long, around binary"
    return docs.select(F.col(key).alias("key"), text_hash(text).alias("hash"), utf8(text).alias("text")).mapInArrow(find, schema)


def verified(found: DataFrame, prefix: DataFrame, few: int) -> DataFrame:
    """(key, hash, start, end, window): where windows occur whole in documents, each once."""
    size = prefix.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("window")), F.lit(0)).alias("bytes")).first()
    found = found.where("token IS NOT NULL")
    if size.n <= few and size.bytes <= FEW_BYTES:
        both = found.join(F.broadcast(prefix), "token")
    else:
        dealt = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = found.withColumn("salt", F.pmod(F.xxhash64("key", "hash", "place"), F.lit(SALTS)).cast("int")).join(dealt, ["token", "salt"])
    at = "(place_byte - byte_at)"
    both = both.where(f"place >= at AND {at} >= 0 AND {at} + length(window) <= length(around)").where(
        f"substring(around, CAST({at} + 1 AS INT), length(window)) = window"
        f" AND ({at} = 0 OR substring(around, CAST({at} AS INT), 1) = X'20')"
        f" AND ({at} + length(window) = length(around) OR substring(around, CAST({at} + length(window) + 1 AS INT), 1) = X'20')"
    )
    return both.select("key", "hash", (F.col("place") - F.col("at")).alias("start"), (F.col("place") - F.col("at") + F.col("size")).alias("end"), "window").distinct()


def hits(docs: DataFrame, cut: DataFrame, width: int, few: int, rows: bool, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The table of places, and where windows occur."""
    prefix, single = prefixes(docs, cut, text)
    wanted = docs.sparkSession.sparkContext.broadcast(Filter(prefix.select("token").distinct()))
    found = materialize(places(docs, wanted, width, single, rows, key, text), "places")
    wanted.unpersist()
    return found, materialize(verified(found, prefix, few), "hits")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH, few: int = FEW) -> DataFrame:
    """Per document: key, n_words, n_hit, spans (start and end of hit ranges of words, in turn), items (with a window in it, sorted as strings)."""
    cut = materialize(windows(items, width, item_key, item_text), "windows")
    found, hit = hits(docs, cut, width, few, True, key, text)
    by = Window.partitionBy("key", "hash").orderBy("start", "end")
    ranges = hit.select("key", "hash", "start", "end").distinct().withColumn("before", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("nth", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.groupBy("key", "hash", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ranges = ranges.groupBy("key", "hash").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.array("start", "end"))).alias("spans"))
    named = hit.select("key", "hash", "window").distinct().join(cut.where("item IS NOT NULL"), "window").select("key", "hash", "item").distinct()
    named = named.groupBy("key", "hash").agg(F.array_sort(F.collect_list("item")).alias("items")).toDF("item_key", "item_hash", "items")
    ranges = ranges.toDF("hit_key", "hit_hash", "n_hit", "spans")
    out = found.where("token IS NULL").select("key", "hash", "n_words")
    out = out.join(ranges, (F.col("hash") == F.col("hit_hash")) & F.col("key").eqNullSafe(F.col("hit_key")), "left").join(named, (F.col("hash") == F.col("item_hash")) & F.col("key").eqNullSafe(F.col("item_key")), "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.flatten("spans"), none("long")).alias("spans"), F.coalesce("items", none("string")).alias("items"))


def clean_rows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH, few: int = FEW) -> DataFrame:
    """The rows of docs without any hit, with their columns; what goes is joined by key and a hash of the text."""
    cut = materialize(windows(items, width, item_key, item_text), "windows")
    hit = hits(docs, cut, width, few, False, key, text)[1]
    return without(docs, hit.select("key", "hash"), key, text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same search in DuckDB.
OP9_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, size, array_to_string(w[p:p + size - 1], ' ') AS win
       FROM (SELECT *, least({WIDTH}, len(w)) AS size, unnest(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
dw AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw))),
hit AS (SELECT DISTINCT doc_id, p, dw.size, item FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
