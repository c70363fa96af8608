"""Toxicity by a weighted pattern grammar over clauses.

A text is cut into clauses, and a cascade of weighted finite-state transducers reads a clause's words;
each reads what the one before it writes.

1. The lexicon writes a word as its class, or, once on each path, as a match: an insult or a threat, whose
   arc has the word's weight. Fixed entries are function words in four languages; learned ones are whole
   words, stems of STEMS letters, and pairs of words that follow each other.
2. Phrases: a threat within INTENT_REACH words of an intention is an intended one; an intensifier
   strengthens an insult within INTENSE_REACH words.
3. Frames: negation among the last NEAR words and quotations after a reporting verb damp matches.
4. Binding: a path picks one match, and a target within NEAR words on either side strengthens it.
   A threat counts only with a target before it, an intended one with a target on either side.

A path's weight is the product of its arcs' and its last state's, and a clause's the sum over all paths,
thus over its matches. `compose` makes one transducer of phrases, frames and binding; the lexicon, whose
entries are many, is composed with it as words are read. A document's score is a logistic function of
what its clauses add up to.

Labels give the learned weights and the two numbers of the logistic function; only rows whose fold
isn't held out are used, at most MOST_LABELS of them (by a hash of the key), and a document's
language, source and key never enter a score.

Defined results: null and empty texts score as texts without matches; texts of any length are read
whole; repeated rows each give a row; labels that are null, or of unknown documents, are left out; of several labels for one key the
toxic one counts;
without usable labels the lexicon is empty and all scores are the prior's; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import table, utf8

MOST_LABELS = 50_000
#: Stems of so many letters are learned beside whole words.
STEMS = (4, 5, 6, 7, 8)
#: Words are first told apart by so many letters: one that begins like no entry has none.
HEAD = min(STEMS)
#: An entry must occur in so many toxic documents, with this log-odds at least, and with this log-likelihood ratio against chance.
LEAST_DOCS, LEAST_WEIGHT, LEAST_SURPRISE = 5, 2.5, 12.0
#: By how much the log-odds of a pair of words must exceed those of its words.
PAIR_GAIN = 1.0
HELD_OUT, FOLDS, CUT = 2, 4, 0.3

# Function words of the grammar in English, German, French and Spanish.
TARGETS = set("you your yours yourself he she they them him her his their those these people du dich dir euch ihr sie er ihm ihnen tu toi vous vos ton ta il elle ils elles leur tú usted ustedes ellos ellas él".split())
NEGATIONS = set("not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals weder ne pas jamais ni nunca jamás".split())
REPORTS = set("said says say saying told tells called calls quoted wrote writes reported reports claimed sagte sagt schrieb nannte behauptete dit disait écrit appelait dijo dice escribió llamó".split())
THREATS = set("kill killed hurt destroy burn beat stab shoot punish töten umbringen schlagen verbrennen tuer frapper brûler matar golpear quemar".split())
INTENTS = set("will shall gonna going want wants should must werde wirst wird will muss sollte vais va vas veux doit voy va quiero debe".split())
INTENSIFIERS = set("such total totally utter utterly complete completely absolute absolutely really truly so solch völlig absolut total tellement complètement vraiment tan totalmente completamente".split())
#: What is left of a match's weight, by (negated, in reported speech).
DAMP = {(False, False): 1.0, (True, False): 0.6, (False, True): 0.7, (True, True): 0.5}
TARGET_BOOST, THREAT_WEIGHT, NEAR = 1.25, 2.0, 4
INTENSE_BOOST, INTENSE_REACH, INTENT_REACH = 1.1, 2, 3

_CLAUSES = re.compile(r"[.!?;:\n]+")
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")


def entries(word: str, before: str = "") -> list[str]:
    """What a lexicon may list a word as: itself, its stems, and with the word before it."""
    return [word + "$", *(word[:k] for k in STEMS if len(word) > k), *([f"{before} {word}"] if before else [])]


def listed(text: str) -> set[str]:
    """All entries that a text in lower case has."""
    return {e for c in _CLAUSES.split(text) for words in [_WORDS.findall(c)] for before, w in zip(["", *words], words, strict=False) for e in entries(w, before)}


OTHER, INSULT, THREAT, INTENDED, TARGET, NEGATION, REPORTING, QUOTE, INTENT, INTENSIFIER = CLASSES = range(10)
FIXED = {w: c for words, c in ((INTENSIFIERS, INTENSIFIER), (INTENTS, INTENT), (TARGETS, TARGET), (REPORTS, REPORTING), (NEGATIONS, NEGATION), ('"“”«»', QUOTE)) for w in words}


class Transducer(NamedTuple):
    """arcs: state to {symbol read: [(next state, symbol written, weight)]}; final: weights of the states in which a path may end."""

    start: object
    arcs: dict
    final: dict


def build(start: object, step: Callable[[object, int], list[tuple]], final: Callable[[object], float]) -> Transducer:
    """The transducer of all states that step reaches from the start."""
    arcs: dict = {start: {}}
    todo = [start]
    while todo:
        state = todo.pop()
        for c in CLASSES:
            if found := step(state, c):
                arcs[state][c] = found
            for after, _, _ in found:
                if after not in arcs:
                    arcs[after] = {}
                    todo.append(after)
    return Transducer(start, arcs, {s: w for s in arcs if (w := final(s))})


def phrases() -> Transducer:
    """States: for how many more words an intention, and an intensifier, hold."""

    def step(state, c):
        intent, intense = state
        after = (INTENT_REACH if c == INTENT else max(0, intent - 1), INTENSE_REACH if c == INTENSIFIER else max(0, intense - 1))
        if c == INSULT:
            return [(after, INSULT, INTENSE_BOOST if intense else 1.0)]
        return [(after, INTENDED if c == THREAT and intent else OTHER if c in (INTENT, INTENSIFIER) else c, 1.0)]

    return build((0, 0), step, lambda _: 1.0)


def frames() -> Transducer:
    """States: for how many more words a negation holds; whether a reporting verb has been read; whether a quotation is open."""

    def step(state, c):
        negated, told, opened = state
        after = (NEAR if c == NEGATION else max(0, negated - 1), told or c == REPORTING, opened != (c == QUOTE))
        if c in (INSULT, THREAT, INTENDED):
            return [(after, c, DAMP[negated > 0, told and opened])]
        return [(after, TARGET if c == TARGET else OTHER, 1.0)]

    return build((0, False, False), step, lambda _: 1.0)


def binding() -> Transducer:
    """States: nothing picked, and for how many more words a target before holds; picked, and for how many more words a target may follow (or, for an intended threat, must); done."""

    def step(state, c):
        kind, left = state
        if kind == "done":
            return [(state, OTHER, 1.0)] if c not in (INSULT, THREAT, INTENDED) else []
        if c == TARGET:
            return [(("free", NEAR) if kind == "free" else ("done", 0), OTHER, 1.0 if kind == "free" else TARGET_BOOST)]
        if c in (INSULT, THREAT, INTENDED):
            if kind != "free":
                return []
            if left:
                return [(("done", 0), c, TARGET_BOOST)]
            return {INSULT: [(("may", NEAR), c, 1.0)], INTENDED: [(("must", NEAR), c, 1.0)]}.get(c, [])
        if kind == "free":
            return [(("free", max(0, left - 1)), OTHER, 1.0)]
        if left > 1:
            return [((kind, left - 1), OTHER, 1.0)]
        return [(("done", 0), OTHER, 1.0)] if kind == "may" else []

    return build(("free", 0), step, lambda s: float(s[0] in ("done", "may")))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer whose paths are those of first with what second makes of what they write; states are numbers, of the pairs that can be reached, and arcs that differ in weight alone are one."""
    start = (first.start, second.start)
    number, todo, arcs, final = {start: 0}, [start], {}, {}
    while todo:
        pair = todo.pop()
        n, row = number[pair], {}
        for c, out in first.arcs[pair[0]].items():
            merged: dict = {}
            for p, between, w in out:
                for q, written, v in second.arcs[pair[1]].get(between, ()):
                    if (p, q) not in number:
                        number[p, q] = len(number)
                        todo.append((p, q))
                    merged[number[p, q], written] = merged.get((number[p, q], written), 0.0) + w * v
            if merged:
                row[c] = [(*to, w) for to, w in merged.items()]
        arcs[n] = row
        if w := first.final.get(pair[0], 0.0) * second.final.get(pair[1], 0.0):
            final[n] = w
    return Transducer(0, arcs, final)


def total(of: Transducer, read: list[list[tuple[int, float]]]) -> float:
    """The sum of the weights of all paths over a text, each of whose places may be read as any of its symbols by their weights."""
    now, arcs = {of.start: 1.0}, of.arcs
    for symbols in read:
        after: dict = {}
        if len(symbols) == 1 and symbols[0][1] == 1.0:
            # Nearly all words: the same sums in the same order, without products by 1.
            c = symbols[0][0]
            for state, x in now.items():
                for to, _, v in arcs[state].get(c, ()):
                    after[to] = after[to] + x * v if to in after else x * v
            now = after
            continue
        for state, x in now.items():
            row = arcs[state]
            for c, w in symbols:
                for to, _, v in row.get(c, ()):
                    after[to] = after.get(to, 0.0) + x * w * v
        now = after
    return sum(x * of.final.get(state, 0.0) for state, x in now.items())


CASCADE = compose(compose(phrases(), frames()), binding())
#: What the lexicon writes for a word without a class; at the start of a clause such words change nothing.
PLAIN = [(OTHER, 1.0)]
STAYS = [(to, v) for to, _, v in CASCADE.arcs[CASCADE.start].get(OTHER, ())] == [(CASCADE.start, 1.0)]


class Hits(dict):
    """Whether a word by itself is a match, by word, as asked before."""

    def __init__(self, of: Grammar):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> bool:
        got = self.of.matches(word)
        if len(self) < 500_000:
            self[word] = got
        return got


class Grammar:
    """The cascade with a lexicon of learned weights."""

    def __init__(self, weights: dict[str, float], slope: float = 1.0, shift: float = 0.0):
        self.weights, self.slope, self.shift = weights, slope, shift
        self.pairs = {tuple(e.split(" ")) for e in weights if " " in e}
        self.ends = {w for _, w in self.pairs}
        self.heads = {w[:HEAD] for w in itertools.chain(THREATS, (e.removesuffix("$") for e in weights if " " not in e))}
        self.known: dict[str, tuple[int, float]] = {}
        self.hits: Hits | None = None

    def word(self, word: str) -> tuple[int, float]:
        """Its class, and its weight as an insult by itself."""
        got = self.known.get(word)
        if got is None:
            fixed = FIXED.get(word)
            w = 0.0 if fixed else max((self.weights.get(x, 0.0) for x in entries(word)), default=0.0)
            got = (fixed or (THREAT if word in THREATS else INSULT if w else OTHER), w)
            if len(self.known) < 500_000:
                self.known[word] = got
        return got

    def matches(self, word: str) -> bool:
        """Whether this word by itself is a match."""
        return word[:HEAD] in self.heads and self.word(word)[0] in (INSULT, THREAT)

    def hit(self) -> Hits:
        if self.hits is None:
            self.hits = Hits(self)
        return self.hits

    def __getstate__(self) -> dict:
        return self.__dict__ | {"hits": None}

    def symbols(self, word: str, before: str) -> list[tuple[int, float]]:
        """What the lexicon writes for a word after another."""
        c, w = self.word(word)
        if c == OTHER and not w and word not in self.ends:
            return PLAIN
        if word in self.ends:
            w = max(w, self.weights.get(f"{before} {word}", 0.0))
        out = [(OTHER if c in (INSULT, THREAT) else c, 1.0)]
        if w:
            out.append((INSULT, w))
        if c == THREAT and w < THREAT_WEIGHT:
            out.append((THREAT, THREAT_WEIGHT - w))  # what a bound threat is worth above the word alone
        return out

    def barren(self, words: list[str]) -> bool:
        """Whether neither a word nor a pair of words is a match: the second words of pairs are common, the pairs are not."""
        return not any(map(self.hit().__getitem__, words)) and self.pairs.isdisjoint(zip(words, words[1:], strict=False))

    def clause(self, words: list[str]) -> float:
        if self.barren(words):
            return 0.0
        read = [self.symbols(w, before) for before, w in zip(["", *words], words, strict=False)]
        return total(CASCADE, itertools.dropwhile(PLAIN.__eq__, read) if STAYS else read)

    def evidence(self, text: str) -> float:
        """The clauses' weights, each further match counting for less; bounded, so that length alone adds little."""
        text = text.lower()
        if self.barren(_WORDS.findall(text)):
            return 0.0
        found = sorted((x for c in _CLAUSES.split(text) if c and (x := self.clause(_WORDS.findall(c)))), reverse=True)
        return sum(x / (1 + i) for i, x in enumerate(found))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.evidence(text) + self.shift))))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """A grammar from labelled rows outside the held-out fold: entry counts are summed in Spark, then the logistic function is fitted on evidence per document."""
    train = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT))
    train = train.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).groupBy("key").agg(F.max("label").alias("label"))
    n = train.count()
    if n > MOST_LABELS:
        train = train.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1e6 * MOST_LABELS / n))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(train), "key").select("label", "text")

    def count(of: int, candidates: frozenset[str] | None) -> DataFrame:
        """In how many documents of one label each entry (or candidate) occurs; '' stands for all of them."""

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    found = listed(t.lower())
                    seen.update(found if candidates is None else found & candidates)
                    seen[""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

        return rows.where(F.col("label") == of).select("text").mapInArrow(tally, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    # Entries of enough toxic documents: at most a few per label read, so they fit the driver as the labels do.
    toxic = {r.entry: r.n for r in count(1, None).where((F.col("n") >= LEAST_DOCS) | (F.col("entry") == "")).toLocalIterator()}
    all_toxic = toxic.pop("", 0)
    clean = {r.entry: r.n for r in count(0, frozenset(toxic)).toLocalIterator()}
    all_clean = clean.pop("", 0)
    if not all_toxic or not all_clean:
        return Grammar({}, 0.0, math.log((all_toxic + 0.5) / (all_clean + 0.5)))
    share, weights = all_toxic / (all_toxic + all_clean), {}
    for entry, t in toxic.items():
        c = clean.get(entry, 0)
        surprise = t * math.log(t / (t + c) / share) + (c * math.log(c / (t + c) / (1 - share)) if c else 0)
        weight = math.log((t + 0.5) / (all_toxic + 1)) - math.log((c + 0.5) / (all_clean + 1))
        if surprise >= LEAST_SURPRISE and weight >= LEAST_WEIGHT:
            weights[entry] = weight
    # A pair is an entry of its own where it tells more than either of its words does.
    alone = Grammar({e: w for e, w in weights.items() if " " not in e})
    weights = {e: w for e, w in weights.items() if " " not in e or all(alone.word(x)[1] < w - PAIR_GAIN for x in e.split(" "))}
    grammar = Grammar(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([grammar.evidence(t) for t in b.column(1).to_pylist()], pa.float64())], ["label", "x"])

    seen: pd.DataFrame = rows.mapInArrow(measure, "label int, x double").toPandas()
    grammar.slope, grammar.shift = logistic(seen["x"].to_numpy(), seen["label"].to_numpy(float))
    return grammar


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a weak pull of the slope towards 0 and the slope never negative."""
    features, beta = np.c_[x, np.ones_like(x)], np.zeros(2)
    pull = np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + pull, features.T @ (y - p) - pull @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def scored(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score, and matches (clauses with any weight)."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.score(t.decode()) for t in b.column(1).to_pylist()], pa.float64())], ["key", "score"])

    return docs.select(F.col(key).alias("key"), utf8(text).alias("text")).mapInArrow(score, f"key {kind}, score double").withColumnRenamed("key", key)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
