"""Token counts by byte-pair merging with a heap of adjacent pairs over a linked list.

`count_tokens` counts what a public word-BPE tokenizer gives, without making identifiers: each
pre-token starts as its byte symbols, the pair of lowest rank is popped and merged until none is
left, and the count is the number of symbols minus that of merges.

Defined results: a null or empty text has 0 bytes and 0 tokens; white space alone has 0 tokens; any
text length works, a row at a time; repeated rows each give a row; columns other than the two named
ones are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import table, utf8

#: A task keeps the counts of at most so many different pre-tokens.
MEMO = 1_000_000

# Texts of these characters alone need no Unicode tables: re's classes and the pattern's agree on them.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ]*")
_PLAIN_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# A fixed value: the pre-tokenizer's pattern.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        k = after[i] = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return left


class WordCounter:
    """Counts tokens of texts with the vocabulary file of a lower-casing word-BPE tokenizer."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = [t[:2] for t in special]
        self.split = regex.compile(_SPLIT).findall
        self.symbols = byte_symbols()
        self.memo: dict[str, int] = {}

    def word(self, w: str) -> int:
        symbols = [self.symbols[b] for b in w.encode()]
        symbols[-1] += self.suffix
        n = merged_length(symbols, self.ranks)
        if len(self.memo) < MEMO and len(w) <= 64:
            self.memo[w] = n
        return n

    def part(self, text: str) -> int:
        if _PLAIN.fullmatch(text):
            words = _PLAIN_SPLIT.findall(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            words = self.split("".join(map(str.lower, text)) if "Σ" in text else text.lower())
        counts = list(map(self.memo.get, words))
        if None in counts:
            counts = [self.word(w) if n is None else n for w, n in zip(words, counts, strict=True)]
        return sum(counts)

    def __call__(self, text: str) -> int:
        if self.special and any(m in text for m in self.marks):
            found = len(self.special.findall(text))
            if found:
                return found + sum(map(self.part, self.special.split(text)))
        return self.part(text)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8) and n_tokens. path: a word-BPE vocabulary on every executor."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([of(t.decode()) for t in texts], pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text")).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return rows.withColumnRenamed("key", key)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
