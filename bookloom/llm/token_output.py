"""Token ids of a corpus in binary frames, in ascending document order, and back.

`write_ids` tokenises documents with a public vocabulary, counts all ids, and writes frames of the
format in `ans` as a table (shard, first, n, frame) in the shared folder; `read_ids` decodes them,
a frame at a time wherever it lies, all spans between checkpoints side by side; `read_range` reads any run
of ids from the nearest checkpoint. Documents are dealt out by ranges of their key, so a shard is a
contiguous run; only a total per shard and a count per vocabulary entry reach the driver, both
bounded by settings and not by the data.

Defined results: a null or empty text has the end id alone; null keys come first; rows with equal
keys are ordered by their texts and each keeps its own row; a document is never split over frames,
however long; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from bookloom.llm import ans
from bookloom.llm.common import materialize, offsets, partitions, raw, slices, table
from bookloom.llm.token_counts import byte_symbols

#: A task keeps the ids of at most so many different pieces of text, as arrays of about 40 bytes each.
MEMO = 400_000
#: Bytes of text that a task tokenises at a time (or one document); what it takes is about 20 times that.
SLICE = 4 << 20
#: Pieces that the library is handed as one text.
JOINED = 2000
#: A frame ends after the document that brings it to so many ids.
FRAME_IDS = 1 << 20

# No pre-token crosses a space or line end where white space stands alone, among letters for which
# the pattern needs no Unicode tables; texts with anything else go to the library whole.
_IRREGULAR = r"  |\n\n| \n|\n |[^\n\x20-\x7eÀ-ÖØ-öø-ɏ]"


class Encoder:
    """Ids by the tokenizers library, which is asked once for each piece of text between spaces that a task keeps.

    Each slice of texts is cut at spaces and line ends, its different pieces are found by dictionary
    encoding, and their ids are spread over the texts as arrays. Pieces that begin with a space, or with a
    line end, go to the library many at a time: only a piece's first id can hold that character, so the
    ids of the joined text fall apart again.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.of.get_added_tokens_decoder().values()]
        self.irregular = "|".join([*special, _IRREGULAR])
        self.end = np.array([end_id], "<u2")
        words = self.of.get_vocab()
        self.begins = {}
        for mark in " \n":
            shown = byte_symbols()[ord(mark)]
            self.begins[mark] = np.zeros(1 << 16, bool)
            self.begins[mark][[i for w, i in words.items() if w.startswith(shown)]] = True
        self.known, self.flat, self.sizes = pa.array([], pa.string()), np.empty(0, "<u2"), np.empty(0, np.int64)

    def ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(r.ids, "<u2") for r in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    def ask_joined(self, words: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many of each), each word with the mark before it."""
        got = self.ask([mark + mark.join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])
        flat = np.concatenate([*got, np.empty(0, "<u2")])
        starts = np.flatnonzero(self.begins[mark][flat])
        if len(starts) != len(words):
            raise ValueError(f"the vocabulary gives {len(starts)} pieces for {len(words)}")
        return flat, np.diff(np.r_[starts, len(flat)])

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many of each). A piece stands for itself after a space, but after \\r for the text without it (a text's first), after \\n for itself, and \\t for a text's end."""
        kind = np.fromiter((0 if not w or w[0] in "\r\t" or w == "\n" else 2 if w[0] == "\n" else 1 for w in words), np.int8, len(words))
        alone, spaced, lines = (np.flatnonzero(kind == k) for k in range(3))
        single = self.ask([(words[i][1:] if words[i][:1] == "\r" else words[i] if words[i] == "\n" else " ") for i in alone])
        single = [self.end if words[i] == "\t" else x for i, x in zip(alone, single, strict=True)]
        parts = [(np.concatenate([*single, np.empty(0, "<u2")]), np.array([len(x) for x in single], np.int64))]
        parts += [self.ask_joined([words[i][cut:] for i in at], mark) for at, mark, cut in ((spaced, " ", 0), (lines, "\n", 1))]
        return gathered(np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]), np.argsort(np.concatenate([alone, spaced, lines]), kind="stable"))

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct pieces, in their order."""
        at = pc.index_in(words, value_set=self.known)
        flat, sizes = self.fresh(words.filter(pc.is_null(at)).to_pylist())
        new, at = at.null_count, pc.fill_null(at, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(new)
        both, every = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        if len(every) <= MEMO:
            self.known, self.flat, self.sizes = pa.concat_arrays([self.known, words.filter(pa.array(at >= len(self.known)))]), both, every
        return gathered(both, every, at)

    def regular(self, texts: pa.Array) -> pa.Array:
        marked = pc.binary_join_element_wise(pa.scalar("\r"), pc.replace_substring(texts, "\n", " \n"), pa.scalar(" \t"), pa.scalar(""))
        cut = pc.split_pattern(marked, " ")
        words, last = cut.values.dictionary_encode(), cut.offsets.to_numpy()[1:] - 1
        del marked, cut
        flat, sizes = self.pieces(words.dictionary)
        code = words.indices.to_numpy()
        spread, n = gathered(flat, sizes, code)
        bounds = 2 * np.r_[0, np.cumsum(n)[last]]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(spread)])

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as 16-bit numbers, with the end id."""
        odd = pc.match_substring_regex(texts, self.irregular)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(at):
            return self.regular(texts)
        whole = pa.array([np.r_[x, self.end].astype("<u2").tobytes() for x in self.ask(texts.take(pa.array(at)).to_pylist())], pa.binary())
        if len(at) == len(texts):
            return whole
        rest = np.setdiff1d(np.arange(len(texts)), at)
        both = pa.concat_arrays([self.regular(texts.take(pa.array(rest))), whole])
        return both.take(pa.array(np.argsort(np.r_[rest, at], kind="stable")))


def gathered(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of flat that stand at the places in at, one after the other, and their sizes); sizes has those of all runs."""
    starts, n = (np.cumsum(sizes) - sizes).astype(np.int32), sizes[at].astype(np.int32)
    ends = np.cumsum(n, dtype=np.int32)
    return flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)], n


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Writes all documents; returns the table of frames and the frequency table (symbols, frequencies). The vocabulary has under 65,536 ids, the key is an integer."""
    spark, names = docs.sparkSession, ["shard", "start", "key", "ids", "times"]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shard, start = encoder(path, end_id), TaskContext.get().partitionId(), 0
        times = np.zeros(1 << 16, np.int64)
        for b in batches:
            for part in slices(iter([b]), "text", SLICE):
                ids = of(part.column(1))
                ends = start + np.cumsum(np.diff(offsets(ids)) // 2)
                starts, start = np.r_[start, ends[:-1]], int(ends[-1])
                n = len(ids)
                got = np.bincount(raw(ids)[0].view("<u2"))
                times[: len(got)] += got
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(starts, pa.int64()), part.column(0), ids, pa.nulls(n, pa.binary())], names)
        pa.default_memory_pool().release_unused()
        if times.any():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array([times.tobytes()], pa.binary())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x, np.int64) for b in batches for x in b.column(0).to_pylist()), np.zeros(1 << 16, np.int64))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], ["id", "n"])

    ranged = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange(partitions(spark), F.col("key").asc_nulls_first())
    # A row without ids ends each shard: how often each id occurs in it.
    tokens = materialize(ranged.sortWithinPartitions(F.col("key").asc_nulls_first(), "text").mapInArrow(tokenise, "shard int, start long, key long, ids binary, times binary"), "tokens")
    found = tokens.where("times IS NOT NULL").select("times").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    tokens = tokens.where("ids IS NOT NULL").select("shard", "start", "key", "ids")
    symbols = found["id"].to_numpy(np.int64)
    freq = ans.quantised(symbols, found["n"].to_numpy(np.float64))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ans.Table(symbols, freq)
        held: list = []
        shard = first = after = None

        def flush() -> pa.RecordBatch:
            keys = np.array([h[0] or 0 for h in held], np.int64)
            frame = ans.encode(np.frombuffer(b"".join([h[1] for h in held]), "<u2"), keys, np.array([h[0] is None for h in held]), np.array([len(h[1]) // 2 for h in held]), t)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([after - first], pa.int64()), pa.array([frame], pa.binary())], ["shard", "first", "n", "frame"])

        for b in batches:
            for s, start, k, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (s != shard or start != after or after - first >= FRAME_IDS):
                    yield flush()
                    held = []
                if not held:
                    shard, first = s, start
                after = start + len(ids) // 2
                held.append((k, ids))
        if held:
            yield flush()

    return materialize(tokens.mapInArrow(frames, "shard int, first long, n long, frame binary"), "frames", "none"), symbols, freq


def read_ids(frames: DataFrame, symbols: np.ndarray, freq: np.ndarray, key: str = "doc_id") -> DataFrame:
    """Per document: key, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit numbers)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ans.Table(symbols, freq)
        for b in batches:
            for first, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = ans.parse(frame)
                ids = memoryview(ans.decode(p, t).astype("<u4").tobytes())
                lengths = p["lengths"].astype(np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(p["docs"], pa.int64(), mask=p["nulls"].astype(bool)), pa.array(first + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return placed(frames).mapInArrow(unpack, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def placed(frames: DataFrame) -> DataFrame:
    """Frames with their first id's place among all documents' ids. A total per shard, of which there are as many as shuffle partitions, is all that is gathered."""
    totals = frames.groupBy("shard").agg(F.sum("n").alias("n"))
    base = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    return frames.join(F.broadcast(base), "shard").select((F.col("first") + F.col("base")).alias("first"), "frame", "n")


def read_range(frames: DataFrame, symbols: np.ndarray, freq: np.ndarray, start: int, stop: int) -> DataFrame:
    """The ids at the places start to stop of the whole corpus, as a row (start, ids) for each checkpointed span that they touch; only the frames that hold them are read, and each from its nearest checkpoint."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ans.Table(symbols, freq)
        for b in batches:
            for first, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = ans.parse(frame)
                every = ans.span(p["lanes"])
                for at in range(max(0, start - first) // every * every, min(p["n"], stop - first), every):
                    low = max(at, start - first)
                    ids = ans.between(p, t, low, min(at + every, stop - first)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([first + low], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["start", "ids"])

    return placed(frames).where((F.col("first") < stop) & (F.col("first") + F.col("n") > start)).select("first", "frame").mapInArrow(unpack, "start long, ids array<int>")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(*write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
