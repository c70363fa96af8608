"""Operators 11 to 13 against their definitions, written out plainly, and on odd rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bookloom.llm import conversation_trie, periodic_runs, quality_rules, queries
from bookloom.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


# 11: quality rules


def rules(text: str) -> tuple:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(i, i + 8))
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_base_rules_equal_definition(spark):
    of = texts(spark)
    got = queries.QUERIES["op11_quality_rules"](spark, SF).collect()
    assert len(got) == len(of)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(of[r.doc_id])


def test_verdict_is_by_the_bands(spark):
    """The verdict as the bands state it, with another compressor object for each text."""
    import zstandard

    def ratio(data):
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(data)) / len(data)

    def inside(data):
        low, high = [(x[1], x[2]) for x in quality_rules.BANDS if x[0] <= len(data)][-1]
        return low <= ratio(data) <= high

    of = texts(spark)
    for r in queries.QUERIES["op11_quality_rules"](spark, SF).collect():
        data = of[r.doc_id].encode()
        chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
        bad = sum(len(c) for c in chunks if not inside(c))
        assert r.n_chunks == len(chunks) and r.kept == (not r.base_failed and inside(data) and 3 * bad <= len(data))
        assert r.ratio is None if not data else r.ratio == pytest.approx(ratio(data))


def test_bands_reject_junk_and_keep_prose(frame):
    rnd = random.Random(3)
    letters = "etaoinshrdlucmfwypvbgk"
    words = ["".join(rnd.choices(letters, range(22, 0, -1), k=rnd.randint(2, 9))) for _ in range(4000)]
    prose = " ".join(rnd.choices(words, [1 / (i + 1) for i in range(4000)], k=6000))
    noise = base64.b64encode(rnd.randbytes(40_000)).decode()
    noise = " ".join(noise[i : i + 40] for i in range(0, len(noise), 40))
    stretch = prose[:400].split()
    loop = " ".join(" ".join(stretch) + f" {i}" for i in range(120))
    rows = [(1, prose), (2, noise), (3, loop), (4, prose[:20_000] + noise[:6_000]), (5, prose[:9_000] + noise[:12_000]), (6, prose[:1500]), (7, " ".join(words[:40]))]
    got = {r.doc_id: r.in_bands for r in quality_rules.measured(frame(rows)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: True}


def test_quality_rules_keep_labelled_good(spark):
    sf = SF.replace("0.001", "0.1")
    found = quality_rules.op11_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("n_words >= 20")
    good = found.where("quality = 1 AND NOT base_failed").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).first()
    assert good.n > 2000 and good.kept == good.n
    bad = found.where("quality = 0").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).first()
    assert bad.kept < 0.6 * bad.n


def test_quality_rules_odd_rows(edges, frame):
    got = {(r.doc_id, r.n_words) for r in quality_rules.measured(edges).collect()}
    assert {(1, 0), (2, 0), (3, 0), (7, 1), (10, 60_000), (11, 1)} <= got and quality_rules.measured(edges).count() == edges.count()
    empty = [r for r in quality_rules.measured(edges).collect() if r.doc_id in (1, 2)]
    assert all(r.ratio is None and not r.in_bands and r.n_chunks == 0 for r in empty)
    assert quality_rules.measured(frame([])).count() == 0


# 12: periodic runs


def brute_runs(words: list) -> list:
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q):
                part = words[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(800):
        n, v = rnd.randint(0, 90), rnd.choice([1, 2, 2, 3, 5])
        ids = [rnd.randrange(v) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            a, p, size = rnd.randrange(n + 1), rnd.randint(1, 9), rnd.randint(1, 40)
            for i in range(a + p, min(n, a + size)):
                ids[i] = ids[i - p]
        assert periodic_runs.runs(np.array(ids, np.int32)) == brute_runs(ids), ids


@pytest.mark.parametrize("values", [2, 3])
def test_runs_of_long_periods_and_heavy_words(values):
    """Few different words make all of them heavy (transforms), and periods over SPARSE take the scan by places."""
    rnd = random.Random(values)
    for _ in range(4):
        ids = [rnd.randrange(values) for _ in range(1500)]
        a, p = rnd.randrange(300), rnd.randint(periodic_runs.SPARSE, 400)
        for i in range(a + p, min(1500, a + 2 * p + rnd.randint(-3, 200))):
            ids[i] = ids[i - p]
        got = np.array(ids, np.int32)
        assert periodic_runs.lag_counts(got)[1:].tolist() == [int((got[q:] == got[:-q]).sum()) for q in range(1, 751)]
        assert periodic_runs.runs(got) == brute_runs(ids)


def test_runs_of_very_long_texts_take_seconds():
    began = time.time()
    assert periodic_runs.runs(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]
    assert periodic_runs.runs(np.tile(np.arange(1000, dtype=np.int32), 300)) == [(0, 300_000, 1000)]
    assert time.time() - began < 20


def by_definition(doc_id: int, text: str) -> tuple:
    words = WORD.findall(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *shown, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_query_equals_definition(spark):
    of = {i: x for i, x in texts(spark).items() if len(x) < 12_000}
    got = {r.doc_id: tuple(r)[1:8] for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(texts(spark)) and sum(r[0] > 0 for r in got.values()) > 10
    for i, x in of.items():
        assert got[i] == by_definition(i, x), i


def test_periodic_runs_odd_rows(edges, frame):
    got = periodic_runs.periodic_runs(edges).collect()
    assert len(got) == edges.count() and all(r.runs is not None and r.collapsed is not None for r in got)
    (long,) = [r for r in got if r.doc_id == 10]
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 1)] and long.collapsed == "word"
    assert all(r.n_words == 0 and r.runs == [] and r.collapsed == "" for r in got if r.doc_id in (1, 2, 3))
    assert periodic_runs.periodic_runs(frame([])).count() == 0


# 13: conversation trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, conv string, pos string, print string, owner string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CONVERSATIONS)


def trie_of(rows: list) -> list:
    """The query's nodes by its definition, from dictionaries of prefixes."""
    told: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            told.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(t)] for c, t in told.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = said.get(base, [])[:h] + own[h:]
    nodes: dict = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        childless = [q for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in below)]
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_conversations(seed: int, n: int = 60) -> list:
    rnd, rows = random.Random(seed), []
    for c in [*rnd.sample(range(-20, 3 * n), n - 1), 10**15]:
        for turn in range(rnd.choice([1, 2, 3, 7, 12])):
            rows.append((c, turn if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["yes", "no", "", None, "çà", "yes no"])))
    return rows


def trie(spark, rows, **more):
    frame = made(spark, rows)
    turns, convs = conversation_trie.rebuilt(conversation_trie.numbered(frame))
    return sorted((tuple(r) for r in conversation_trie.prefix_trie(turns, convs, **more).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_definition(spark, seed):
    rows = random_conversations(seed)
    assert trie(spark, rows) == trie_of(rows)


@pytest.mark.parametrize("bits", [1, 3])
def test_colliding_fingerprints_are_split(spark, bits):
    rows = random_conversations(9, 40)
    assert trie(spark, rows, weak_bits=bits) == trie_of(rows)


def test_trie_of_one_long_conversation_among_others(spark):
    """A conversation over many partitions and blocks, with copies that leave it late."""
    rows = [(5, i, "user", f"turn {i % 97}") for i in range(9000)] + [(6, i, "user", f"turn {i % 97}") for i in range(4500)] + [(6, 4500, "user", "other"), (7, 0, "user", "alone")]
    got = trie(spark, rows)
    one = lambda depth: [r for r in got if r[1] == depth]
    assert len(one(0)) == 1 and one(0)[0][:4] == (5, 0, None, 3)
    assert sorted(r[3] for r in one(4500))[-1] == 2 and sorted(r[3] for r in one(4501)) == [1, 1] and one(9000)[0][4:6] == (0, 1)
    shared = zlib.crc32(b"7") % 9  # what conversation 7 begins with is that of 5 too
    assert one(0)[0][6] == sum(len(f"turn {i % 97}") for i in range(4500)) + sum(len(f"turn {i}") for i in range(shared))


def test_trie_odd_rows(spark):
    rows = [(None, 0, "user", "left out"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (3, None, None, None), (4, 1, "user", "x" * 300_000), (8, 2, "a", "b"), (8, 2, "a", "a"), (0, 0, None, "")]
    assert trie(spark, rows) == trie_of(rows)
    assert trie(spark, []) == [] and trie(spark, [(None, 0, "a", "b")]) == []


def test_trie_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = queries.QUERIES["op13_conversation_trie"](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({conversation_trie.OP13_SQL})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)
