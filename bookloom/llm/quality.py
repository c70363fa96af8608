"""Document quality by hierarchical empirical Bayes: a classifier's evidence and its site's record.

Evidence: counts of shape (symbols, capitals, separators, repetition, lengths) of the whole text go
through a logistic function learned from labels. Sites: the mean evidence of a host's documents is
drawn towards that of all documents, and that of a path inside a host towards the host's, the more
so the fewer documents there are; how strongly is itself estimated from how much hosts, and paths of
a host, differ. A document's posterior joins its own likelihood ratio with the odds of its path, from
which its own share has been taken out.

All statistics of hosts and paths are grouped sums over all documents; only labels are read up to a
bound (MOST_LABELS, chosen by a hash of the key) to fit the classifier.

Defined results: null and empty texts are rejected by their own evidence (score 0); a null host or
path is a site of its own; labels that are null or of unknown documents are left out, of several for one key the lowest counts; without labels
of both kinds all evidence is even and every document with words is kept; texts of any length are
read whole; repeated rows each give a row; other columns are kept by `accepted`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import NOT_SPACE, materialize, raw, slices, spans, table, text_hash, utf8, without, word_hashes

MOST_LABELS = 50_000
KEEP = 0.5
#: A path's odds move a document's by at most this much: no site condemns a document by itself.
MOST_SITE = 1.5
#: Sites are broadcast up to so many.
BROADCAST_SITES = 200_000

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[65:91] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_PROSE = np.zeros(256, bool)
_PROSE[[ord(c) for c in ".,;:'\"-?()"]] = True
_SYMBOLS = ~(_LETTERS | _DIGITS | _PROSE) & NOT_SPACE
FEATURES = ("symbols", "symbol_words", "capitals", "digits", "doubled", "repeated_words", "repeated_neighbours", "distinct", "mean_length", "long_words", "prose_marks", "log_words")


def shape(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, from its bytes."""
    n = len(off) - 1
    s, e, first = spans(data, off, NOT_SPACE)
    words = np.diff(first)
    size, count = np.maximum(1, np.diff(off)).astype(float), np.maximum(1, words).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return (total[off[1:]] - total[off[:-1]]).astype(float)

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return (total[first[1:]] - total[first[:-1]]).astype(float)

    symbol = _SYMBOLS[data]
    letters = np.maximum(1, per_text(_LETTERS[data]))
    doubled = np.r_[False, symbol[1:] & (data[1:] == data[:-1])] if len(data) else symbol
    marks = np.r_[0, np.cumsum(symbol)]
    hashes = word_hashes(data, s, e)
    order = np.lexsort((hashes, np.repeat(np.arange(n), words)))
    h, of = hashes[order], np.repeat(np.arange(n), words)[order]
    again = np.r_[False, (h[1:] == h[:-1]) & (of[1:] == of[:-1])] if len(h) else np.zeros(0, bool)
    neighbour = np.r_[False, hashes[1:] == hashes[:-1]] if len(h) else np.zeros(0, bool)
    length = e - s
    return np.c_[
        per_text(symbol) / size, per_word(marks[e] > marks[s]) / count, per_text(_CAPITALS[data]) / letters, per_text(_DIGITS[data]) / size,
        per_text(doubled) / size, np.bincount(of, again, n) / count, per_word(neighbour) / count, (1 - np.bincount(of, again, n) / count) * np.sqrt(count) / 10,
        (np.diff(off) / count) / 10, per_word(length > 25) / count, per_text(_PROSE[data]) / size * 10, np.log1p(words) / 10,
    ] * (words > 0)[:, None]


class Classifier:
    """A logistic function of the features, their squares, and their standing against the training rows."""

    def __init__(self, beta: np.ndarray, middle: np.ndarray, spread: np.ndarray, base: float):
        self.beta, self.middle, self.spread, self.base = beta, middle, spread, base

    @staticmethod
    def expand(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
        z = np.clip((x - middle) / spread, -6, 6)
        return np.c_[np.ones(len(z)), z, z * z / 4]

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """The log-likelihood ratio of good to bad."""
        return np.clip(self.expand(x, self.middle, self.spread) @ self.beta, -12, 12) - self.base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Classifier:
        middle, spread = x.mean(0) if len(x) else np.zeros(len(FEATURES)), (x.std(0) if len(x) else np.zeros(len(FEATURES))) + 1e-6
        z = cls.expand(x, middle, spread)
        beta = np.zeros(z.shape[1])
        if not len(y) or y.min() == y.max():
            return cls(beta, middle, spread, 0.0)
        pull = np.eye(z.shape[1])
        pull[0, 0] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ beta)
            beta += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        return cls(beta, middle, spread, math.log(y.mean() / (1 - y.mean())))


def measured(rows: DataFrame, keep: list[str], f, schema: str) -> DataFrame:
    """f(features, words > 0) beside the columns to keep; rows has them and then `text` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = shape(*raw(b.column(len(keep))))
            got = f(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v) for v in got.values())], [*keep, *got])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*keep, "text").mapInArrow(run, ", ".join([*kinds, schema]))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    train = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).groupBy("key").agg(F.min("label").alias("label"))
    n = train.count()
    if n > MOST_LABELS:
        train = train.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1e6 * MOST_LABELS / n))
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text")).join(F.broadcast(train), "key")
    seen = measured(rows, ["label"], lambda x: {"x": x.tolist()}, "x array<double>").toPandas()
    x = np.array(seen["x"].tolist(), float).reshape(len(seen), len(FEATURES))
    full = x.any(axis=1)
    return Classifier.fit(x[full], seen["label"].to_numpy(float)[full])


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def strength(groups: DataFrame, total: str, n: str, prior: str) -> float:
    """How many documents the prior counts for: by moments, from how much the groups' means vary beyond what their sizes explain."""
    m, p = F.col(total) / F.col(n), F.col(prior)
    got = groups.where(F.col(n) > 0).agg(F.sum(F.col(n) * (m - p) ** 2).alias("between"), F.sum(p * (1 - p)).alias("chance"), F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * p * (1 - p)).alias("within")).first()
    if not got or not got.n or not got.within:
        return 1e6
    excess = max(0.0, got.between - got.chance) / got.n
    mean_chance = got.within / got.n
    return float(min(1e6, max(1.0, mean_chance / excess - 1 if excess > 0 else 1e6)))


class Judge:
    """The classifier, and what all documents say about their sites."""

    def __init__(self, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang"):
        self.key, self.text, self.host, self.path = key, text, host, path
        self.model = learn(docs, labels, key, text)
        self.rows = materialize(self.evidence(docs.select(F.col(key).alias("key"), *self.place(docs))), "evidence")
        paths = materialize(self.rows.where("full").groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("good")), "paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
        total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
        self.mean = float(min(1 - 1e-4, max(1e-4, (total.good or 0.0) / total.n))) if total and total.n else 0.5
        self.k_host = strength(hosts.withColumn("prior", F.lit(self.mean)), "host_good", "host_n", "prior")
        hosts = hosts.withColumn("host_mean", (F.col("host_good") + self.k_host * self.mean) / (F.col("host_n") + self.k_host)).withColumnRenamed("host", "h")
        self.sites = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")
        self.k_path = strength(self.sites, "good", "n", "host_mean")

    def place(self, docs: DataFrame) -> list[Column]:
        return [F.col(self.host).cast("string").alias("host"), F.col(self.path).cast("string").alias("path"), text_hash(self.text).alias("hash"), utf8(self.text).alias("text")]

    def evidence(self, rows: DataFrame) -> DataFrame:
        """rows of (key, host, path, hash, text as bytes) with full (the text has words), evidence and p instead of the text."""
        model = self.model

        def weigh(x: np.ndarray) -> dict:
            full = x.any(axis=1)
            ratio = model.evidence(x)
            return {"full": full, "evidence": np.where(full, ratio, -99.0), "p": np.where(full, 1 / (1 + np.exp(-np.clip(ratio + model.base, -30, 30))), 0.0)}

        return measured(rows, ["key", "host", "path", "hash"], weigh, "full boolean, evidence double, p double")

    def judged(self, rows: DataFrame) -> DataFrame:
        """rows with evidence, and host_mean, path_mean, score and keep beside."""
        few = self.sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
        site = self.sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "good", "host_n", "host_good")
        joined = rows.join(F.broadcast(site) if few else site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
        # Without the document itself, so that its evidence counts once.
        own, one = F.when(F.col("full"), F.col("p")).otherwise(0.0), F.when(F.col("full"), 1.0).otherwise(0.0)
        drawn = lambda good, n, k, prior: F.least(F.greatest((F.coalesce(good, F.lit(0.0)) - own + k * prior) / (F.coalesce(n, F.lit(0.0)) - one + k), F.lit(1e-4)), F.lit(1 - 1e-4))
        joined = joined.withColumn("host_mean", drawn(F.col("host_good"), F.col("host_n"), self.k_host, F.lit(self.mean)))
        joined = joined.withColumn("path_mean", drawn(F.col("good"), F.col("n"), self.k_path, F.col("host_mean")))
        shift = F.least(F.greatest(logit(F.col("path_mean")) - logit(F.lit(self.mean)), F.lit(-MOST_SITE)), F.lit(MOST_SITE))
        score = F.when(F.col("full"), 1 / (1 + F.exp(-(F.col("evidence") + logit(F.lit(self.mean)) + shift)))).otherwise(0.0)
        return joined.withColumn("score", score).withColumn("keep", F.col("full") & (F.col("score") >= KEEP)).drop("h", "q", "n", "good", "host_n", "host_good")


def accepted(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of docs that are kept, with their columns; what goes is joined by key and a hash of the text."""
    judge = Judge(docs, labels, **columns)
    gone = judge.judged(judge.rows).where("NOT keep").select(F.col("key").alias("gone_key"), F.col("hash").alias("gone_hash"))
    return without(docs, gone, judge.key, judge.text)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judge = Judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judge.judged(judge.rows).select(F.col("key").alias("doc_id"), "evidence", "host_mean", "path_mean", "score", "keep")
