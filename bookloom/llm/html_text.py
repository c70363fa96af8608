"""Main text of web pages: structure first, then site templates by recurring subtrees.

Pages are parsed twice. The first pass hashes element subtrees together with their place, the tags and classes
around them: boxes, that is elements other than TEXTUAL ones, and links and spans that stand alone, with no
words beside them. Spark counts in how many different pages of a host (inside articles: in how many different
articles) each stands, and in how many its place occurs at all; a subtree that stands in LEAST_PAGES of them and in
a share of SHARE of those with the place is the host's template, so a large host needs more than five chance
repeats. The second pass leaves out elements that are never article text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) and template subtrees. Running text is never
judged by recurrence alone: headings, paragraphs, list items, tables and their rows are not judged at all, lists
and boxes inside an article only if they hold a link, and a box of text outside an article goes only where nothing
but template stands before it or nothing but template after it. An article is never judged, nor
is a box with over half of its article's text, and a box that recurs with the same whole article counts
once: pages and passages are copied too, and a copied article is still one. Where a page has an article
(or main) element, text is taken from there alone; otherwise from all that is left. Reading a page takes time in
proportion to its length, whatever is nested in what.

Defined results: null and empty html give empty text; a null url has its own host; html of any length
and any mistakes is read to its end, open elements end with their parents; exact copies of a page
count once towards a template; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import materialize, table

#: A subtree is template if it stands in so many different pages of its host, or different articles, and in such a share of those that have its place.
LEAST_PAGES, SHARE = 5, 0.1
#: Hosts' templates are broadcast up to so many hosts; a host of more templates than the second number has them looked up page by page.
BROADCAST_HOSTS, HOST_TEMPLATES = 100_000, 1000

# Elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("head nav header footer aside form script style noscript template svg math canvas iframe object embed applet audio video button select option textarea input dialog menu title noembed noframes datalist".split())
ARTICLE = {"article", "main"}
#: Running text: never judged by recurrence; links and spans inside it are part of it everywhere.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 pre blockquote address dl dt dd li table thead tbody tfoot tr td th caption figcaption summary".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?bar|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|cookies?|consent|gdpr|notice|newsletter|subscribe|popup|modal|overlay"
    r"|\w*comments?|comment-\w+|respond|disqus\w*|replies|share|sharing|social|related|recommend\w*|widget|pagination|pager|login|signup)(?:$|[\s_-])",
    re.I,
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<""", re.S)
#: An odd number, whose powers tell places apart in hashes.
BASE = 0xD6E8FEB86659FD93
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


def described(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is never article text, and its class."""
    if tag in DROPPED or not attributes:
        return tag in DROPPED, ""
    named, gone = "", False
    lenient = tag in ("html", "body", "article", "main") and "comment" not in attributes
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        named = value if name == "class" else named
        gone = gone or not lenient and (name == "hidden" or name == "role" and value.lower() in ROLES or name in ("class", "id") and bool(NAMES.search(value)))
    return gone, named


_powers: list[np.ndarray] = []


def prefix_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sums of code points times powers of an odd number, modulo 2**64, before each place; the inverses of those powers)."""
    if not _powers or len(_powers[0]) <= len(text):
        size = max(len(text) + 1, 1 << 16)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64))]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * _powers[0][: len(points)], out=sums[1:])
    return sums, _powers[1]


class Open(NamedTuple):
    """An open element, and how far things were when it began."""

    tag: str
    begin: int
    dropped: bool
    in_article: bool
    blocks: int
    boxes: int
    run: int
    piece: int
    size: int
    links: int
    place: int


class Page:
    """One reading of a page: blocks of text, and hashes of subtrees at their places, each with its place and the hash of the article around it (None outside)."""

    def __init__(self, source: str, template: frozenset[int] = frozenset(), hashing: bool = True):
        # White space counts as one space everywhere, so that equal subtrees are equal text.
        self.source, self.template, self.hashing = " ".join(source.split()), template, hashing
        if hashing:
            self.sums, self.inverse = prefix_hashes(self.source)
        self.stack: list[Open] = []
        self.where: defaultdict[str, list[int]] = defaultdict(list)  # by tag: places in the stack
        self.outer: list[int] = []  # places in the stack of elements that are not inline
        self.textual = 0  # open elements of running text
        self.blocks: list[tuple[bool, str]] = []
        self.size = 0  # characters in blocks
        self.weak: list[tuple[int, int]] = []  # blocks of boxes of text that recur, as [first, end)
        self.inline: list[str] = []
        self.run = 0  # how many runs of inline text have ended
        self.alone: list[tuple[int, int, int, int, bool]] = []  # links of this run: hash, place, pieces of inline text, in an article
        self.links = 0
        self.has_article = False
        self.hashes: set[tuple[int, int, int | None]] = set()
        self.boxes: list[tuple[int, int, int]] = []  # hashes in the articles that are open, their places, and how much text they have
        self.read()

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][2:4] if self.stack else (False, False)

    def flush(self) -> None:
        if self.alone:
            self.judge_links()
        self.run += 1
        text = " ".join(html.unescape("".join(self.inline)).split())
        if text:
            self.blocks.append((self.state()[1], text))
            self.size += len(text)
        self.inline = []

    def close(self, end: int) -> None:
        x = self.stack[-1]
        if x.tag not in INLINE:
            self.flush()
            self.outer.pop()
        self.stack.pop()
        self.where[x.tag].pop()
        self.textual -= x.tag in TEXTUAL
        if not self.hashing or x.dropped:
            return
        if x.tag in INLINE:
            if x.tag in ("a", "span") and x.run == self.run and not self.textual:
                self.alone.append((self.digest(x, end), x.place, x.piece, len(self.inline), x.in_article))
        elif x.tag in ARTICLE:
            whole, size = self.digest(x, end), self.size - x.size
            self.hashes.update((h, place, whole) for h, place, n in self.boxes[x.boxes :] if 2 * n <= size)
            del self.boxes[x.boxes :]
        elif x.tag not in ("html", "body", "head") and x.tag not in TEXTUAL:
            linked = self.links > x.links
            if linked or not x.in_article and x.tag not in ("ul", "ol"):
                h = self.digest(x, end)
                self.note(h, x.place, self.size - x.size, x.in_article)
                if h in self.template:
                    if linked:
                        del self.blocks[x.blocks :]
                        self.size = x.size
                        while self.weak and self.weak[-1][1] > x.blocks:
                            self.weak.pop()
                    elif len(self.blocks) > x.blocks:
                        self.weak.append((x.blocks, len(self.blocks)))

    def judge_links(self) -> None:
        """Judges the links and spans of a run of inline text that has no words beside them."""
        sizes = np.r_[0, np.cumsum([len(x) for x in self.inline])]
        covered = np.zeros(len(self.inline) + 1, np.int64)
        for _, _, a, b, _ in self.alone:
            covered[a] += 1
            covered[b] -= 1
        if not any(c.isalnum() for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist() for c in self.inline[i]):
            gone = np.zeros(len(self.inline) + 1, np.int64)
            for h, place, a, b, in_article in self.alone:
                self.note(h, place, int(sizes[b] - sizes[a]), in_article)
                if h in self.template:
                    gone[a] += 1
                    gone[b] -= 1
            for i in np.flatnonzero(np.cumsum(gone[:-1])).tolist():
                self.inline[i] = ""
        self.alone = []

    def note(self, h: int, place: int, size: int, in_article: bool) -> None:
        if in_article:
            self.boxes.append((h, place, size))
        else:
            self.hashes.add((h, place, None))

    def digest(self, x: Open, end: int) -> int:
        """A hash of an element's source and place, from sums over prefixes: no element is read again for those around it. An article's place doesn't count."""
        begin, place = x.begin, 0 if x.tag in ARTICLE else x.place
        if end > begin and self.source[end - 1] == " ":
            end -= 1
        return (int(self.sums[end]) - int(self.sums[begin])) * int(self.inverse[begin]) % (1 << 64) ^ (end - begin + (place << 32)) * 0x9E3779B97F4A7C15 % (1 << 64)

    def read(self) -> None:
        s, at, last = self.source, 0, self.source.rfind(">")
        while at <= last:
            m = _TOKEN.search(s, at)
            if not m or m.start() > last:
                break
            if m.start() > at and not self.state()[0]:
                self.inline.append(s[at : m.start()])
            at = m.end()
            if not m[2]:
                if m[0] == "<" and not self.state()[0]:
                    self.inline.append("<")
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag, at, m.start())
                continue
            self.start(tag, m[3], m.start())
            if tag in RAW and not m[3].endswith("/"):
                stop = re.compile(f"</{tag}[^>]*>", re.I).search(s, at)
                if not self.state()[0]:
                    self.inline.append(s[at : stop.start() if stop else len(s)])
                at = stop.end() if stop else len(s)
                self.close(at)
        if at < len(s) and not self.state()[0]:
            self.inline.append(s[at:])
        while self.stack:
            self.close(len(s))
        self.flush()

    def start(self, tag: str, attributes: str, begin: int) -> None:
        if tag not in INLINE:
            self.flush()
            same = CLOSES_SAME.get(tag)
            if tag in CLOSES_P:
                if self.outer and self.stack[self.outer[-1]].tag == "p":
                    for _ in range(len(self.stack) - self.outer[-1]):
                        self.close(begin)
            elif same and self.stack and self.stack[-1].tag in same:
                while self.stack and self.stack[-1].tag in same:
                    self.close(begin)
        if tag in VOID:
            return
        dropped, in_article = self.state()
        gone, named = described(tag, attributes)
        dropped = dropped or gone
        if tag in ARTICLE and not dropped:
            self.has_article = in_article = True
        place = zlib.crc32(f"{tag} {named}".encode("utf-8", "replace"), self.stack[self.outer[-1]].place if self.outer else 0) if self.hashing else 0
        self.where[tag].append(len(self.stack))
        if tag not in INLINE:
            self.outer.append(len(self.stack))
        self.textual += tag in TEXTUAL
        self.links += tag == "a"
        self.stack.append(Open(tag, begin, dropped, in_article, len(self.blocks), len(self.boxes), self.run, len(self.inline), self.size, self.links - (tag == "a"), place))

    def end(self, tag: str, at: int, begin: int) -> None:
        if tag not in INLINE:
            self.flush()
        if not self.where[tag]:
            return
        i = self.where[tag][-1]
        if tag in INLINE and self.outer and self.outer[-1] > i:
            return
        while len(self.stack) > i + 1:
            self.close(begin)
        self.close(at)

    def text(self) -> str:
        """Blocks in order, without boxes of text that recur where only such stand before them, or only such after."""
        marked = np.zeros(len(self.blocks) + 1, np.int64)
        for first, end in self.weak:
            marked[first] += 1
            marked[end] -= 1
        own = np.flatnonzero(np.cumsum(marked[:-1]) == 0)
        first, end = (own[0], own[-1] + 1) if len(own) else (0, 0)
        return " ".join(t for inside, t in (self.blocks if self.has_article else self.blocks[first:end]) if inside or not self.has_article)


def host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, place, hash, within): from (host, page, html), each page's subtrees at their places and what each is counted by: its article, or the page."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, ids, places, found, within = [], [], [], [], []
            for h, p, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for x, place, whole in Page(s).hashes:
                    hosts.append(h)
                    ids.append(p)
                    places.append(place)
                    found.append(x - (1 << 63))
                    within.append(p if whole is None else whole - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (ids, places, found, within))], ["host", "page", "place", "hash", "within"])

    return pages.mapInArrow(hashes, "host string, page long, place long, hash long, within long")


def main_text(pages: DataFrame, url: str = "url", source: str = "html", *keep: str) -> DataFrame:
    """Per row: the columns to keep, and text."""
    n, kept = len(keep), [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*kept, host(url).alias("host"), F.coalesce(F.col(source), F.lit("")).alias("html")).withColumn("page", F.xxhash64("html"))
    seen = materialize(subtrees(rows.select("host", "page", "html")), "subtrees")
    # Different pages are counted as the sums of pages that are each counted once, so that both counts are partial before they are shuffled.
    often = seen.select("host", "place", "hash", "within").distinct().groupBy("host", "place", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    places = seen.select("host", "place", "within").distinct().groupBy("host", "place").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= LEAST_PAGES)
    often = often.join(places, ["host", "place"]).where(F.col("n") >= SHARE * F.col("all"))
    often = materialize(often.select(F.col("host").alias("of"), F.col("hash").alias("template")).distinct(), "often")
    # Few templates of a host go to all its pages; many are looked up for each page, so that none carries more than its own.
    sizes = materialize(often.groupBy("of").agg(F.count(F.lit(1)).alias("size")), "hosts")
    found = materialize(often.join(sizes.where(F.col("size") <= HOST_TEMPLATES).select(F.col("of").alias("few")), F.col("of") == F.col("few")).groupBy("of").agg(F.collect_list("template").alias("template")), "templates")
    few = found.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    columns = [*(f"k{i}" for i in range(n)), "html", "template"]
    many = sizes.where(F.col("size") > HOST_TEMPLATES).select(F.col("of").alias("large"))
    parts = [rows]
    if many.limit(1).count():
        large = F.col("host") == F.col("large")
        own = often.join(many, F.col("of") == F.col("large"), "left_semi").join(seen.select("host", "page", "hash").distinct(), (F.col("of") == F.col("host")) & (F.col("template") == F.col("hash")))
        own = own.groupBy("of", F.col("page").alias("at")).agg(F.collect_list("template").alias("template"))
        parts = [rows.join(many, large, "left_anti"), rows.join(many, large, "left_semi").join(own, (F.col("host") == F.col("of")) & (F.col("page") == F.col("at")), "left").select(*columns)]
    parts[0] = parts[0].join(F.broadcast(found) if few else found, F.col("host") == F.col("of"), "left").select(*columns)
    dealt = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(s, frozenset(x + (1 << 63) for x in t or ()), bool(t)).text() for s, t in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string())], [*(f"k{i}" for i in range(n)), "text"])

    schema = ", ".join([f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["text string"])
    out = dealt.mapInArrow(extract, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), "url", "html", "page_id", "url").withColumn("n_chars", F.char_length("text").cast("long"))
