"""Each operator against a brute-force version, a library, SQL or held-out labels, and on tables of odd rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bookloom.llm import ans, components, decontamination, html_text, matroska, mixing, near_dedup, quality, queries, token_counts, token_output, toxicity, warc
from bookloom.llm.common import table

SF = "/root/testdata/sf0.001"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df, *names):
    return sorted((tuple(r[c] for c in names or df.columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE[name]})").fetchall()
    assert rows_of(df, *names) == sorted(want, key=repr)


def test_a_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))
    assert all(map(callable, queries.QUERIES.values()))


# 1: mixing


def test_mixing_targets_and_takes(spark):
    rows = queries.QUERIES["op1_mixing"](spark, SF).collect()
    source = {r.doc_id: r.source for r in table(spark, SF, "documents").collect()}
    total, target, taken = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        s = source[r.doc_id]
        total[s] += r["size"]
        target[s] = r.target
        taken[s] += r.taken
    assert sum(target.values()) == pytest.approx(min(1.5 * sum(total.values()), 2 * sum(total.values())))
    largest = max(r["size"] for r in rows)
    for s in total:
        assert target[s] <= 2 * total[s] + 1e-6 and abs(taken[s] - target[s]) <= largest
    assert rows_of(queries.QUERIES["op1_mixing"](spark, SF)) == rows_of(queries.QUERIES["op1_mixing"](spark, SF))


def test_mixing_inclusion_odds(frame, monkeypatch):
    """Over seeds, documents that are nine times as long are taken oftener, as their odds of inclusion say; the target is met each time."""
    sizes = [10 if i % 2 else 90 for i in range(400)]
    docs = frame([(i, "w " * n, "en", "a") for i, n in enumerate(sizes)])
    seen = Counter()
    for seed in range(5):
        monkeypatch.setattr(mixing, "SEED", seed)
        rows = mixing.shares(docs).collect()
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 45
        seen.update((r["size"], r.copies - 1) for r in rows)
    share = {n: seen[n, 1] / (seen[n, 0] + seen[n, 1]) for n in (10, 90)}
    odds = {n: p / (1 - p) for n, p in share.items()}
    assert share[10] < share[90] and 4.5 < odds[90] / odds[10] < 18


def test_mixing_odd_rows(edges, frame):
    assert mixing.shares(edges).count() == edges.count()
    mixed = mixing.mixed(edges)
    assert mixed.columns == edges.columns
    assert all(r["size"] == r.taken == 0 for r in mixing.shares(edges).where("doc_id in (1, 2, 3)").collect())
    empty_source = frame([(1, None, "en", "b"), (2, "", "en", "b"), (3, "x y", "en", "a")])
    assert {r.doc_id: r.taken for r in mixing.shares(empty_source).collect()}.items() >= {1: 0, 2: 0}.items()
    assert mixing.shares(frame([])).count() == mixing.mixed(frame([])).count() == 0


# 2 and 3: tokens


def test_token_counts_equal_library(spark, edges):
    of = Tokenizer.from_file(WORD_BPE)
    for docs in (table(spark, SF, "documents"), edges):
        texts = [r.text or "" for r in docs.collect()]
        want = Counter((len(t.encode()), len(e.ids)) for t, e in zip(texts, of.encode_batch(texts, add_special_tokens=False)))
        got = Counter((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, WORD_BPE).collect())
        assert got == want


def test_token_counts_empty(frame):
    assert token_counts.count_tokens(frame([]), WORD_BPE).count() == 0


def expected_ids(docs):
    of = Tokenizer.from_file(BYTE_BPE)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, start = [], 0
    for i, t in rows:
        ids = np.array([*of.encode(t, add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_token_output_round_trip(spark, edges):
    for docs in (table(spark, SF, "documents"), edges):
        got = token_output.read_ids(*token_output.write_ids(docs, BYTE_BPE))
        assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == expected_ids(docs)


def test_token_ranges_start_at_checkpoints(spark, edges, monkeypatch):
    """Runs of ids from frames of many checkpoints: the same as from all ids."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 63, 1000, 4096, 50_000, 2 * 4096 * 5, 123_457):
        monkeypatch.setattr(ans, "CHECKPOINT", 4096)
        ids = (rng.zipf(1.3, n) % 900).astype(np.int64)
        symbols, counts = np.unique(ids, return_counts=True)
        t = ans.Table(symbols, ans.quantised(symbols, counts.astype(float)))
        p = ans.parse(ans.encode(ids, np.arange(1), np.zeros(1, bool), np.array([n]), t))
        points, every = len(p["points"]), ans.span(p["lanes"])
        assert points == max(1, -(-n // every)) and (ans.decode(p, t) == ids).all()
        for first in range(points):
            assert (ans.decode(p, t, first, first + 1) == ids[first * every : (first + 1) * every]).all()
            assert (ans.decode(p, t, first) == ids[first * every :]).all()
        for _ in range(30):
            a, b = (int(x) for x in rng.integers(-5, n + 6, 2))
            assert (ans.between(p, t, a, b) == ids[max(0, a) : max(0, b)]).all()
    monkeypatch.setattr(token_output, "FRAME_IDS", 9000)
    written = token_output.write_ids(table(spark, SF, "documents"), BYTE_BPE)
    every = token_output.read_range(*written, 0, 1 << 40).orderBy("start").collect()
    assert [r.start for r in every] == np.cumsum([0, *(len(r.ids) for r in every)])[:-1].tolist()
    whole = [i for r in every for i in r.ids]
    assert len(whole) == token_output.read_ids(*written).agg({"n_tokens": "sum"}).head()[0]
    some = token_output.read_range(*written, 20_001, 47_003).orderBy("start").collect()
    assert [i for r in some for i in r.ids] == whole[20_001:47_003] and len(some) > 2


def test_token_output_empty(frame):
    assert token_output.read_ids(*token_output.write_ids(frame([]), BYTE_BPE)).count() == 0


def test_ans_round_trip_and_damage():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 30_000), 60_000).astype("<u2")
    symbols, counts = np.unique(ids, return_counts=True)
    t = ans.Table(symbols.astype(np.int64), ans.quantised(symbols.astype(np.int64), counts.astype(float)))
    lengths = np.array([10_000, 0, 20_000])
    frame = ans.encode(ids, np.arange(3), np.zeros(3, bool), lengths, t)
    assert (ans.decode(ans.parse(frame), t) == ids).all()
    broken = bytearray(frame)
    broken[len(frame) // 2] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017
        assert (ans.decode(ans.parse(bytes(broken)), t) == ids).all()


# 4: WARC


def test_warc_round_trip_with_magic_in_payloads(spark, tmp_path):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = [(1, "http://a/1", trap * 3), (2, "http://a/2", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/6", "é\n" * 9), (6, "http://a/6", "é\n" * 9), (None, None, "lost")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w")
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == len(data) and all(r.intact for r in got)
    want = Counter((len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for _, _, h in data)
    assert Counter((r.payload_bytes, r.payload_digest) for r in got) == want
    assert Counter(r.record_type for r in got)["revisit"] == 2
    warc.write(pages.limit(0), f"{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_chain_longer_than_a_stride(spark, tmp_path):
    warc.write(spark.range(300).selectExpr("id AS page_id", "'u' AS url", "concat('p', id) AS html").coalesce(1), f"{tmp_path}/w")
    got = warc.read(spark, f"file://{tmp_path}/w")
    assert got.select("record_id").distinct().count() == 300


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", ((10, 5), (1000, 2), (None, 1)))
    pages = [(k, "http://a.b/", "x" * n) for k, n in enumerate([0, 3, 10, 11, 500, 1000, 1001, 5000, 5000, 9, 10] * 3)] + [(None, None, None)]
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(pages) and all(r.intact for r in got)
    files = Counter(r.file for r in got)
    held = {f: [r.payload_bytes for r in got if r.file == f] for f in files}
    assert all(len(n) <= (5 if max(n) <= 10 else 2 if max(n) <= 1000 else 1) for n in held.values())


def test_warc_scan_of_a_megabyte_of_magics_takes_seconds():
    began = time.process_time()
    for piece in (b"WARC/1.1\r\n", b"WARC/1.0\r\nContent-Length: 1\r\n", b"WARC/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"):
        found = warc.scan(piece * (1_000_000 // len(piece)))
        assert len(found) == (1_000_000 // len(piece) if piece.endswith(b"\r\n\r\n\r\n\r\n") else 0)
    assert time.process_time() - began < 8
    assert list(warc.scan(b"WARC/1.1\r\nA: b\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")) == [16]


def test_warc_revisits_are_held_against_their_response(spark, tmp_path):
    """Of two files, one has its response's payload changed (same length), one its revisit's length."""
    import os

    pages = spark.createDataFrame([(1, "u", "same text"), (2, "u", "same text"), (3, "u", "alone"), (5, "u", "twice"), (7, "u", "twice")], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), f"{tmp_path}/w")
    (name,) = [f"{tmp_path}/w/{x}" for x in os.listdir(f"{tmp_path}/w") if x.startswith("part-")]
    data = open(name, "rb").read()
    os.mkdir(f"{tmp_path}/x")
    open(f"{tmp_path}/x/a.warc", "wb").write(data.replace(b"same text", b"SAME text"))
    at = data.index(b"WARC-Refers-To: <urn:bookloom:page:5>")
    open(f"{tmp_path}/x/b.warc", "wb").write(data[:at] + data[at:].replace(b"html; charset=utf-8\r\nContent-Length: 5", b"html; charset=utf-8\r\nContent-Length: 6", 1))
    tell = lambda name: {int(re.search(r"(\d+)>", r.record_id)[1]): (r.record_type, r.intact) for r in warc.read(spark, f"{tmp_path}/{name}").collect()}
    good = {1: ("response", True), 2: ("revisit", True), 3: ("response", True), 5: ("response", True), 7: ("revisit", True)}
    assert tell("w") == good
    assert tell("x/a.warc") == good | {1: ("response", False), 2: ("revisit", False)}
    assert tell("x/b.warc") == good | {7: ("revisit", False)}
    open(f"{tmp_path}/x/c.warc", "wb").write(data[: data.index(b"WARC/1.1", 10)] + b"junk" + data)
    assert len(tell("x/c.warc")) == 1  # a chain that breaks ends


def test_warc_clashing_columns_and_stuffed_pages(spark, tmp_path):
    trap = "WARC/1.1\r\nContent-Length: 1\r\n" * 200 + "\r\nx\r\n\r\n"
    rows = [(i, "u", trap * 20 if i % 2 else f"p{i}", "k", "s", "b", "f", "o") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, sha1 string, bytes string, first string, of string")
    warc.write(pages, f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert len(got) == 6 and all(r.intact for r in got) and {r.payload_bytes for r in got} == {2, len(trap) * 20}


# 5: HTML


def test_main_text(spark):
    page = lambda n: f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>Menu</nav><div class='x'>Site words</div><article><h1>Head &amp; {n}</h1><p>One  two\n<b>th</b>ree</p><script>var a;</script><div class='comments'>bad</div></article><footer>Foot</footer></body></html>"
    data = [(i, f"http://h/{i}", page(i)) for i in range(8)] + [(20, None, None), (21, "http://h/x", ""), (22, "http://h/y", "<p>open <i>only"), (23, "http://h/z", "<<>< & &#x41;&lt;")]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(data, "page_id long, url string, html string"), "url", "html", "page_id", "url").collect()}
    assert got[3].text == "Head & 3 One two three"
    assert got[20].text == got[21].text == "" and got[22].text == "open only"
    assert len(got) == len(data)


def test_site_template_outside_articles(spark):
    page = lambda n: f"<body><div>Our site</div><div><p>Own words number {n * n}</p></div><div>Call now</div></body>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages, "url", "html", "page_id").collect()}
    assert got == {i: f"Own words number {i * i}" for i in range(20)}


@pytest.mark.parametrize("host_templates", [1000, 0])
def test_site_template_inside_main_and_at_any_host_size(spark, monkeypatch, host_templates):
    monkeypatch.setattr(html_text, "HOST_TEMPLATES", host_templates)
    # On the first host: six layouts, each on a sixth of the pages; own words, and an article that is copied whole.
    box = lambda k: f"<div>Box number {k}<ul><li><a href='/join'>join us</a></li></ul></div>"
    copied = "<p>This is copied as a whole</p><div>with its inset</div>"
    page = lambda n: f"<body><main>{box(n % 6)}<p>The own words of page {n}</p><p>Same words</p><a href='/'>Start</a> | <a href='/{n}'>Link {n}</a></main></body>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(36)] + [(i, f"http://h/{i}", f"<body><div>{i}</div><article>{copied}</article></body>") for i in range(50, 60)]
    # A host of ten pages, five of which have the notice; and running text with the same link.
    rows += [(i, f"http://g/{i}", f"<body><p>Some {i} <a href='/'>linked</a> words</p>{'<div>Notice</div>' * (i % 2)}</body>") for i in range(100, 110)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html", "page_id").collect()}
    want = {i: f"The own words of page {i} Same words | Link {i}" for i in range(36)} | {i: "This is copied as a whole with its inset" for i in range(50, 60)} | {i: f"Some {i} linked words" for i in range(100, 110)}
    assert got == want


def test_templates_equal_brute_force_over_trees(spark):
    """Random pages of nested boxes: which boxes recur at a place is counted on the trees they were made from; at both ends of a page what recurs goes."""
    rng = random.Random(5)
    pool = [f"<div>shared {i}<div>inner {i % 3}</div></div>" for i in range(8)]

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(pool) if rng.random() < 0.5 else f"<div>own {rng.randrange(10**9)}</div>"
        return ["<section>", *(tree(depth - 1) for _ in range(rng.randint(1, 3))), "</section>"]

    def source(t):
        return t if isinstance(t, str) else "".join(map(source, t))

    def boxes(t, place=()):
        if isinstance(t, str):
            whole = [((*place, "div"), t)] if t.startswith("<div>") else []
            return whole + [((*place, "div", "div"), x) for x in re.findall(r"(?<=\d)<div>inner \d</div>", t)]
        return [((*place, "section"), source(t))] + [x for c in t[1:-1] for x in boxes(c, (*place, "section"))]

    def texts(t, often, place=(), gone=False):
        """(text, whether a box around it recurs) of each block."""
        s = source(t)
        if isinstance(t, str):
            here = (*place, "div")
            gone = gone or (here, s) in often
            own, inner = re.match(r"<div>([^<]*)(<div>[^<]*</div>)?", t).groups()
            return [(own, gone)] + ([(re.sub("<[^>]*>", "", inner), gone or ((*here, "div"), inner) in often)] if inner else [])
        here = (*place, "section")
        gone = gone or (here, s) in often
        return [x for c in t[1:-1] for x in texts(c, often, here, gone)]

    def text(t, often):
        found = texts(t, often)
        own = [i for i, (_, gone) in enumerate(found) if not gone]
        return [x for x, _ in found[own[0] : own[-1] + 1]] if own else []

    pages = [(i, f"http://{i % 2}/", tree(3)) for i in range(60)]
    different = {(u, source(t)): t for _, u, t in pages}
    counts = Counter((u, b) for (u, _), t in different.items() for b in set(boxes(t)))
    places = Counter((u, p) for (u, _), t in different.items() for p in {p for p, _ in boxes(t)})
    often = {u: {b for (v, b), n in counts.items() if v == u and n >= max(html_text.LEAST_PAGES, html_text.SHARE * places[u, b[0]])} for u in ("http://0/", "http://1/")}
    df = spark.createDataFrame([(i, u, f"<body>{source(t)}</body>") for i, u, t in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df, "url", "html", "page_id").collect()}
    assert got == {i: " ".join(text(t, often[u])) for i, u, t in pages} and any(often.values())


@pytest.mark.parametrize("size", [4, 6, 500])
def test_repeated_headings_rows_and_sentences_stay(spark, size):
    """What articles of a host legitimately repeat stays, however many pages the host has; so does running text of pages without an article."""
    inside = lambda i: f"<h2>Introduction</h2><p>Own {i * i} words</p><div>Methods</div><p>More {i} words</p><table><tr><td>Count</td><td>{i}</td></tr><tr><td>Total</td><td>0</td></tr></table><p>See the appendix for details.</p><ul><li>None</li></ul>"
    words = lambda i: f"Introduction Own {i * i} words Methods More {i} words Count {i} Total 0 See the appendix for details. None"
    rows = [(i, "http://a/", f"<body><article>{inside(i)}</article></body>") for i in range(size)] + [(1000 + i, "http://b/", f"<body>{inside(i)}</body>") for i in range(size)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html", "page_id").collect()}
    assert got == {i: words(i) for i in range(size)} | {1000 + i: words(i) for i in range(size)}


@pytest.mark.parametrize("size", [6, 500])
def test_rare_chance_repeats_of_large_hosts_stay(spark, size):
    """Five equal boxes are a template on a host of six pages, and chance on one of five hundred."""
    page = lambda i: f"<body><article><p>Words {i}</p><div>See <a href='/x'>{'the note' if i < 5 else i}</a></div><p>End {i}</p></article></body>"
    rows = [(i, "http://a/", page(i)) for i in range(size)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html", "page_id").collect()}
    assert got[0] == ("Words 0 End 0" if size == 6 else "Words 0 See the note End 0") and got[5] == "Words 5 See 5 End 5"


@pytest.mark.parametrize("head, piece, tail", [
    ("", "<div>", ""), ("", "</p>", ""), ("", "<p>a", ""), ("", "<b>x</i>", ""), ("", "<a href='x>", ""), ("", "<", ""), ("", "&amp;", ""), ("", '<a "', ""), ("", "<div>x", ""), ("", "<span>x", ""), ("", "<span>x</span>", ""),
    ("<b><div>", "<i>", "</b>"), ("<div>", "<p><a href='/'>x</a></p>", ""), ("<i>", "<div>y</div>", ""), ("", "<li>x", ""), ("", "<article>x<div><a>y</a></div>", ""), ("", "<table><tr><td>x", ""),
])
def test_html_of_a_megabyte_takes_seconds(head, piece, tail):
    began = time.process_time()
    times = 1_000_000 // (len(piece) + len(head) + len(tail))
    html_text.Page(head * times + piece * times + tail * times + "<p>end</p>").text()
    assert time.process_time() - began < 30


def test_html_odd_rows(spark):
    rows = [(1, "http://h/1", "<p hidden>no</p><p>yes</p>"), (1, "http://h/1", "<p hidden>no</p><p>yes</p>"), (None, None, "<article>a<div class='usercomments'>bad</div></article>"), (2, "http://h/2", None)]
    df = spark.createDataFrame([(*r, "h", 1, "t") for r in rows], "page_id long, url string, html string, host string, page long, text string")
    assert sorted(r.text for r in html_text.main_text(df, "url", "html", "page_id").collect()) == ["", "a", "yes", "yes"]
    assert html_text.main_text(df.limit(0), "url", "html", "page_id").count() == 0


def test_html_query_columns(spark):
    df = queries.QUERIES["op5_html_extraction"](spark, SF)
    assert {"page_id", "url", "text", "n_chars"} <= set(df.columns)
    rows = df.collect()
    assert len(rows) == table(spark, SF, "pages").count() and all(r.n_chars == len(r.text) for r in rows)


# 6 and 8: classifiers


def test_quality_separates_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    seen = labels.where("quality is not null AND doc_id % 2 = 0")
    judge = quality.Judge(table(spark, sf, "documents"), seen)
    held = judge.judged(judge.rows).join(labels.where("doc_id % 2 = 1").selectExpr("doc_id AS key", "quality"), "key").where("quality is not null").collect()
    right = sum(r.keep == (r.quality == 1) for r in held)
    assert right >= 0.9 * len(held)


def test_quality_odd_rows(spark, edges, frame):
    labels = table(spark, SF, "labels")
    kept = quality.accepted(edges, labels)
    assert kept.columns == edges.columns and kept.where("doc_id in (1, 2, 3)").count() == 0
    assert quality.accepted(frame([]), labels).count() == 0
    assert quality.accepted(edges, labels.limit(0)).where("doc_id = 4").count() == 2


def test_toxicity_held_out(spark):
    # The smaller tables have under ten toxic labels for some languages, too few for any lexicon.
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op8_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out AND toxic is not null").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.8 * sum(r.toxic for r in rows) and hit >= 0.8 * sum(r.predicted for r in rows)


def test_toxicity_grammar():
    g = toxicity.Grammar({"vorg$": 4.0})
    assert g.evidence("you vorg") > g.evidence("a vorg") > g.evidence("he is not a vorg") > 0 == g.evidence("a kind word")
    assert g.evidence('she said "vorg"') < g.evidence("vorg")


def test_composed_transducers_equal_enumeration():
    """Random clauses, scored by looking at all positions instead of by states."""
    g, rng = toxicity.Grammar({"vorg$": 4.0, "kill$": 1.0}), random.Random(3)
    kinds = ["vorg", "kill", "you", "not", "said", '"', "tree", "sky"]

    def naive(words):
        total = 0.0
        for i, w in enumerate(words):
            x = {"vorg": 4.0, "kill": 1.0}.get(w, 0.0)
            near = lambda span, what: any(words[j] == what for j in span if 0 <= j < len(words))
            before, after = near(range(i - 4, i), "you"), near(range(i + 1, i + 5), "you")
            if w == "kill" and before:
                x = 2.0
            framed = "said" in words[:i] and words[:i].count('"') % 2 == 1
            total += x * toxicity.DAMP[near(range(i - 4, i), "not"), framed] * (1.25 if before or after else 1.0)
        return total

    for _ in range(3000):
        words = rng.choices(kinds, k=rng.randint(0, 14))
        assert g.clause(words) == pytest.approx(naive(words)), words
    # A clause's weight is that of one path for each match.
    assert g.clause("vorg vorg".split()) == 8.0


def test_composition_equals_all_paths():
    """compose and total against following every path of random transducers, one after the other."""
    rng = random.Random(5)

    def made():
        states = range(rng.randint(1, 3))
        arc = lambda: (rng.choice(states), rng.randrange(3), rng.choice([0.5, 1.0, 2.0]))
        return toxicity.Transducer(0, {s: {c: [arc() for _ in range(rng.randint(0, 2))] for c in range(3)} for s in states}, {s: rng.choice([1.0, 3.0]) for s in states if rng.random() < 0.7})

    def paths(of, read):
        """(what is written, weight) of each path."""
        now = [(of.start, (), 1.0)]
        for c in read:
            now = [(to, (*out, o), w * v) for s, out, w in now for to, o, v in of.arcs[s].get(c, [])]
        return [(out, w * of.final[s]) for s, out, w in now if s in of.final]

    for _ in range(400):
        a, b, c = made(), made(), made()
        both, read = toxicity.compose(toxicity.compose(a, b), c), [rng.randrange(3) for _ in range(rng.randint(0, 4))]
        expected = sum(w * v * x for out, w in paths(a, read) for mid, v in paths(b, out) for _, x in paths(c, mid))
        assert toxicity.total(both, [[(s, 1.0)] for s in read]) == pytest.approx(expected)
        assert sum(w for _, w in paths(both, read)) == pytest.approx(expected)


def test_toxicity_patterns_of_several_words():
    g = toxicity.Grammar({"vorg$": 4.0, "grey mould": 3.0})
    clause = lambda text: g.clause(text.split())
    assert clause("a grey mould") == 3.0 and clause("a mould of grey") == clause("grey and mould") == 0
    assert clause("such a vorg") == pytest.approx(4.4) and clause("such a very long tree vorg") == 4.0
    # A threat needs a target before it, an intended one a target on either side.
    assert clause("i kill you") == 0 and clause("they kill trees") == pytest.approx(2.5)
    assert clause("i will kill you") == pytest.approx(2.5) == clause("you will kill trees") and clause("i will kill trees") == 0
    assert clause("i will not kill you") == pytest.approx(2.5 * 0.6)
    assert clause('said " i will not kill you') == pytest.approx(2.5 * 0.5)
    assert clause("") == clause("mould") == 0


def test_toxicity_counts_all_clauses():
    g = toxicity.Grammar({"vorg$": 4.0})
    assert g.evidence("a vorg. " * 80) == pytest.approx(sum(4.0 / (1 + i) for i in range(80)))


def test_toxicity_reads_only_clauses_with_a_match(monkeypatch):
    """The second word of a pair is no match without the first; what is passed over has no weight."""
    rng, calls, total = random.Random(5), [], toxicity.total
    monkeypatch.setattr(toxicity, "total", lambda *x: calls.append(1) or total(*x))
    g = toxicity.Grammar({"vorg$": 4.0, "o'x$": 3.0, "grey mould": 3.0, "mould \"": 2.0, "slim": 2.5})
    assert g.evidence("a mould of grey. Such mould! grey; mould, you") == 0 and not calls
    words = ["vorg", "vorgs", "o'x", "o", "grey", "mould", '"', "slimy", "slim", "kill", "you", "not", "will", "tree7", "_grey"]
    for _ in range(400):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ". ", "\n"]) for _ in range(rng.randrange(12)))
        clauses = [toxicity._WORDS.findall(c) for c in toxicity._CLAUSES.split(text)]
        plain = sorted((total(toxicity.CASCADE, [g.symbols(w, b) for b, w in zip(["", *c], c, strict=False)]) for c in clauses), reverse=True)
        assert g.evidence(text) == sum(x / (1 + i) for i, x in enumerate(plain))


def test_toxicity_odd_rows(spark, edges, frame):
    labels = table(spark, SF, "labels")
    g = toxicity.learn(table(spark, SF, "documents"), labels)
    assert all(0 <= r.score <= 1 for r in toxicity.scored(edges, g).collect())
    assert toxicity.scored(edges, g).count() == edges.count() and toxicity.scored(frame([]), g).count() == 0
    none = toxicity.learn(edges, labels.limit(0))
    assert len({r.score for r in toxicity.scored(edges, none).collect()}) == 1


# 7: near duplicates


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_components(docs, k, percent):
    sets = {i: shingle_set(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(docs, k, percent / 100).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], k, percent)


def test_near_duplicates_large_groups(frame):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[: 55 + i % 5], f"end{i}"]) for i in range(150)] + [" ".join(base)] * 40 + [f"lone {i} text of five words" for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(frame(list(enumerate(texts))), 3, 0.85).collect()}
    assert got == brute_components(list(enumerate(texts)), 3, 85)


def bounded_branches(monkeypatch, most):
    """Small sizes of nodes, and a failure instead of an endless loop; counts the branchings."""
    calls, branches = [], near_dedup.branches

    def counted(*a):
        calls.append(1)
        assert len(calls) <= most, "nodes branch without end"
        return branches(*a)

    monkeypatch.setattr(near_dedup, "branches", counted)
    for name, value in (("SMALL", 8), ("LARGE", 32), ("BLOCK", 16)):
        monkeypatch.setattr(near_dedup, name, value)
    return calls


def test_near_duplicates_nodes_that_never_split(frame, monkeypatch):
    base = [f"w{i}" for i in range(800)]
    texts = [" ".join([*base[: 5 * i], f"own{i}", *base[5 * i + 1 :]]) for i in range(120)] + [f"lone {i} text of five words" for i in range(5)]
    bounded_branches(monkeypatch, 1)
    got = {r.doc_id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(frame(list(enumerate(texts))), 3, 0.85).collect()}
    assert got == brute_components(list(enumerate(texts)), 3, 85)


def test_near_duplicates_large_nodes_of_many_components(frame, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    # 60 pairs that are links; texts of different pairs share about 0.7 and are none.
    texts = [" ".join([*base, *(f"p{i}x{j}" for j in range(35)), *["again"] * (i % 3), f"end{k}"]) for i in range(60) for k in range(2)]
    calls = bounded_branches(monkeypatch, 1)
    monkeypatch.setattr(near_dedup, "LEVELS", 1)
    got = {r.doc_id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(frame(list(enumerate(texts))), 3, 0.85).collect()}
    assert got == brute_components(list(enumerate(texts)), 3, 85) and calls
    assert near_dedup.tree_count(0.85, 0) < near_dedup.tree_count(0.85, near_dedup.LEVELS)


def test_near_duplicates_lose_no_link_at_a_larger_size(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    got = {r.doc_id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(docs, 3, 0.85).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def test_vertices_that_share_nothing_end_at_the_first_branching(frame, monkeypatch):
    """Different texts, and pairs of near copies: no node branches."""
    calls = bounded_branches(monkeypatch, 9)
    words = lambda i: [f"w{i}x{j}" for j in range(60)]
    texts = [" ".join(words(i // 2)[i % 2 :]) for i in range(80)]
    got = {r.doc_id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(frame(list(enumerate(texts))), 3, 0.85).collect()}
    assert got == brute_components(list(enumerate(texts)), 3, 85) and not calls and len({c for _, c in got.values()}) == 40


def test_near_duplicates_odd_rows(edges, frame):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(edges, 3, 0.85).collect()}
    assert got[5].component == got[6].component == got[4].component == 4 and got[8].component == 7
    assert all(got[i].n_shingles == 0 and got[i].component == i and got[i].kept for i in (1, 2, 3))
    kept = near_dedup.distinct_rows(edges, 3, 0.85)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [-5, 1, 2, 3, 4, 7, 9, 10, 11, 12, 13]
    assert near_dedup.distinct_rows(frame([]), 5, 0.8).count() == 0


@pytest.mark.parametrize("hub", [3, 10_000])
def test_components_equal_brute_force(spark, monkeypatch, hub):
    # Hubs, a path, rings, repeated links and loops.
    monkeypatch.setattr(components, "HUB", hub)
    draw = random.Random(3)
    links = [(500, k) for k in range(400, 480)] + [(k, 700) for k in range(470, 490)] + [(k, k + 1) for k in range(1000, 1020)]
    links += [(2000 + k, 2000 + (k + 1) % 7) for k in range(7)] + [(9, 9), (500, 400), (400, 500)] + [(draw.randrange(3000, 3060), draw.randrange(3000, 3060)) for _ in range(40)]
    label = {n: n for a, b in links if a != b for n in (a, b)}
    for _ in range(len(label)):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == label and got.columns == ["node", "component"]


# 9: decontamination


def brute_force_hits(text, items, width=10):
    """Hit words and items of a text, by comparing every place with every window."""
    w, hit, found = decontamination.words((text or "").encode()), set(), set()
    for name, item in items:
        of = decontamination.words((item or "").encode())
        size = min(width, len(of))
        for window in {tuple(of[i : i + size]) for i in range(len(of) - size + 1)} if of else ():
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) == window:
                    hit.update(range(s, s + size))
                    found.add(name)
    return len(w), len(hit), sorted(x for x in found if x is not None)


def test_decontamination_broadcast_and_shuffle_agree(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = rows_of(decontamination.contaminated(docs, items))
    assert rows_of(decontamination.contaminated(docs, items, few=0)) == whole
    clean = {r.doc_id for r in decontamination.clean_rows(docs, items, few=0).collect()}
    assert clean == {r.doc_id for r in decontamination.contaminated(docs, items).where("n_hit = 0").collect()}


@pytest.mark.parametrize("few", [0, 1000])
def test_decontamination_equals_brute_force(spark, frame, monkeypatch, few):
    # Few words and a small bitmap: windows that overlap, repeat, share shingles and collide in the filter.
    monkeypatch.setattr(decontamination, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(decontamination, "RETURNED", 7)
    draw = random.Random(5)
    some = lambda n: "".join(draw.choice(["a", "B", "ab", "ba", "\u00e9", "7"]) + draw.choice([" ", "-", " , ", "\n"]) for _ in range(n))
    items = [(f"i{k}", some(draw.choice([1, 2, 3, 5, 11, 14]))) for k in range(30)] + [(None, "B ab B"), ("none", None), ("empty", " - "), ("twice", "a a a a a a a a a a a a")]
    docs = [(k, some(draw.choice([0, 1, 2, 9, 40, 200]))) for k in range(120)] + [(7, "a " * 40), (None, "B ab B"), (None, None), (8, "aB ab Ba")]
    docs += [(k, " ".join(t for _, t in draw.sample(items[:30], 3))) for k in range(200, 230)]
    got = decontamination.contaminated(frame(docs, clash=True), spark.createDataFrame(items, "item_id string, text string"), few=few).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == sorted(((k, *brute_force_hits(t, items)) for k, t in docs), key=repr)
    assert all(sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_hit and r.spans == sorted(set(r.spans)) for r in got)


def test_decontamination_odd_rows(spark, edges, frame):
    items = spark.createDataFrame([("b1", "ONE"), ("b2", None), ("b3", ""), ("b4", "lazy dog while seven small birds sing about rain and wind"), ("b4", "one")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.contaminated(edges, items).collect()}
    assert got[7] == (1, 1, ["b1", "b4"]) and got[1] == (0, 0, []) and got[4] == (26, 11, ["b4"])
    clean = decontamination.clean_rows(edges, items)
    assert clean.columns == edges.columns and clean.where("doc_id in (4, 5, 6, 7, 8, -5)").count() == 0 and clean.where("doc_id = 12").count() == 1
    assert decontamination.contaminated(frame([]), items).count() == 0
    assert decontamination.clean_rows(edges, items.limit(0)).count() == edges.count()


# 10: Matroska


@pytest.mark.parametrize("n", [0, 1, 192, 1536, 1537, 1536 * 8 + 5, 1536 * 8 * 16 * 2 + 3000])
def test_matroska_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    media = matroska.mux(data)
    got = matroska.demux(media)
    assert got["error"] is None and b"".join(media[p.start : p.start + p.length] for p in got["packets"]) == data
    assert {p.cluster for p in got["packets"]} == {c[2] for c in got["cues"]}
    assert [p.timestamp for p in got["packets"]] == sorted(p.timestamp for p in got["packets"])


@pytest.mark.parametrize("sizes", [[5], [5, 5, 5], [300, 7], [300, 7, 900, 900, 2], [1, 20_000, 3]])
def test_matroska_lacing(sizes):
    frames = [bytes([k]) * n for k, n in enumerate(sizes)]
    flag, head = matroska.lace(frames)
    data = head + b"".join(frames)
    assert matroska.laced(data, 0, len(data), flag) == (len(head), sizes)


def test_media_columns(spark, edges, frame):
    for docs in (table(spark, SF, "documents"), edges):
        pad = lambda t: t + b" " * (-len(t) % 192 if t else 192)
        texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
        want = sorted(((i, len(t), len(p := pad(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for i, t in texts), key=repr)
        assert rows_of(matroska.text_media(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert matroska.text_media(frame([])).count() == 0


def test_packets_of_damaged_media(spark):
    media = matroska.mux(bytes(range(256)) * 100)
    df = spark.createDataFrame([(1, media), (2, media[:-900]), (3, None), (4, b""), (5, b"\x00junk")], "id long, media binary")
    got = matroska.packets(df, "id").groupBy("id").agg({"error": "max"}).collect()
    assert {r.id: r[1] is None for r in got} == {1: True, 2: False}
