"""Near duplicates by chosen-path set similarity join.

Every text becomes its set of word shingles and a signature of SIGNATURE minwise tokens. Exact copies
(equal sets) are one vertex from the start. In each of several independent trees a vertex goes down
the path of its minwise tokens at chosen coordinates; vertices that share a path share a node. Nodes
of at most LARGE members are compared exhaustively. In larger ones, members that are not yet connected
with the rest first meet each other in blocks with some PIVOTS members of the node; a node whose members
are then one component is done, and one with at most LARGE others has them compared with all. Only what
remains branches again, at coordinates chosen by the node, and after LEVELS branchings it is compared
exhaustively whatever its size. The number of trees follows from the recall that is asked for a pair at
the threshold: each tree finds it with probability threshold ** DEPTH, and vertices of nodes that branch
stand in as many more trees as make up for the pairs that branching parts (see `survival`).

Nodes of at most SMALL members are compared by signatures, and pairs that pass (a true pair fails with
a probability under 1e-8) are confirmed on the full sets. In nodes above that, members that are not yet
connected with the rest meet all others in blocks of BLOCK by BLOCK full sets; a block returns what
connects its members and never its pairs, and the blocks of one node are dealt to different tasks. Their
number is in proportion to a node's members, but for nodes of over LARGE unconnected ones after LEVELS
branchings, where it is their square.

Scale: tables of (node, vertex) are shuffled, never texts, except for texts of vertices that have a
candidate. No task holds more than two blocks of a node.

Defined results: null and empty texts, and texts of white space, have no shingles and link with
nothing; a text of fewer words than a shingle is one shingle; of rows that share a key `distinct_rows` keeps one,
while each text of such a key is linked by what it says (keys should name one text each);
a row with a null key has the component of an equal set, or else null, and is kept; texts of any
length are read whole; other columns are ignored by `near_duplicates` and kept by `distinct_rows`;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import fresh, materialize, mix, raw, shingles, slices, table, utf8
from bookloom.llm.components import components

SIGNATURE = 64
DEPTH = 3
SMALL, LARGE, BLOCK = 24, 4096, 256
RECALL = 0.99999
#: Members of a large node that all others meet, about; and how often a node branches at most.
PIVOTS, LEVELS = 16, 6
#: What the first trees connect, the others need not compare again.
PARTS = ("tree = 0", "tree BETWEEN 1 AND 3", "tree > 3")
#: Keys whose texts are needed (8 bytes each), and nodes of several components (32), are broadcast up to so many; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_SEEDS = mix(np.arange(1, 2 * SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sets_of(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = shingles(data, off, k)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(key, n, h1, h2, sig): the size and a 128-bit hash of each text's set, and its minwise tokens."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = sets_of(*raw(b.column(1)), k)
            n = np.array([len(s) for s in sets], np.int64)
            h1, h2, sig = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((len(n), SIGNATURE), np.uint32)
            full = np.flatnonzero(n)
            if len(full):
                flat, starts = np.concatenate(sets), (np.cumsum(n) - n)[full]
                h1[full] = np.add.reduceat(mix(flat), starts)
                h2[full] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                for j in range(SIGNATURE):
                    x = (flat ^ _SEEDS[2 * j]) * (_SEEDS[2 * j + 1] | np.uint64(1))
                    sig[full, j] = np.minimum.reduceat(x, starts) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())], ["key", "n", "h1", "h2", "sig"])

    return docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("text")).mapInArrow(sign, "key long, n long, h1 long, h2 long, sig binary")


def as_array(sig: pa.Array) -> np.ndarray:
    return raw(sig)[0].view(np.uint32).reshape(-1, SIGNATURE)


def survival(threshold: float, levels: int) -> float:
    """The least chance that a pair at the threshold, in one node, still shares one after so many branchings, each of 1 / threshold children on average."""
    s = 1.0
    for _ in range(levels):
        s -= threshold * (1 - threshold) * s * s
    return s


def tree_count(threshold: float, levels: int) -> int:
    """How many trees find a pair at the threshold with RECALL where nodes branch up to so many times."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - threshold**DEPTH * survival(threshold, levels)))


def roots(classes: DataFrame, first: int, trees: int) -> DataFrame:
    """(node, v, tree): the nodes at DEPTH in which each vertex stands, one per tree from the first on."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = as_array(b.column(1)).astype(np.uint64)
                for t in range(first, trees):
                    node = np.full(len(sig), t + 1, np.uint64)
                    for d in range(DEPTH):
                        node = mix(node * np.uint64(31) + sig[:, (DEPTH * t + d) % SIGNATURE] + np.uint64(d))
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column(0), pa.array([t] * len(sig), pa.int32())], ["node", "v", "tree"])

    return classes.select("v", "sig").mapInArrow(grow, "node long, v long, tree int")


def branches(members: DataFrame, threshold: float) -> DataFrame:
    """(node, v, tree): the children of large nodes, on average 1 / threshold for each member; a node chooses the coordinates for all its members."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, sig = b.column(0).to_numpy().view(np.uint64), as_array(b.column(3)).astype(np.uint64)
            draw = mix(node ^ np.uint64(0xDA3E39CB94B95BDB))
            twice = (draw >> np.uint64(11)).astype(float) / float(1 << 53) < 1 / threshold - 1
            first = draw % np.uint64(SIGNATURE)
            second = (first + np.uint64(1) + (draw >> np.uint64(8)) % np.uint64(SIGNATURE - 1)) % np.uint64(SIGNATURE)
            for c, rows in ((first, np.arange(len(node))), (second, np.flatnonzero(twice))):
                child = mix(node[rows] * np.uint64(31) + sig[rows, c[rows].astype(np.int64)] + c[rows])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(1).take(pa.array(rows)), b.column(2).take(pa.array(rows))], ["node", "v", "tree"])

    return members.select("node", "v", "tree", "sig").mapInArrow(grow, "node long, v long, tree int").distinct()


def shared_nodes(rows: DataFrame, tag: str) -> DataFrame:
    """(node, v, ..., size) of the nodes with at least two members."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialize(rows.join(sizes, "node"), tag)


def connected(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """For each member of a block: the first one that it is connected with by links inside the block."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, of = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    column, of = rank[column[times[column] > 1]], of[times[column] > 1]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    both = np.zeros((m, m), np.float32)
    width = 4096
    for first in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        part = slice(*np.searchsorted(column, [first, first + width]))
        seen = np.zeros((m, width), np.float32)
        seen[of[part], column[part] - first] = 1
        both += seen @ seen.T
    both = np.rint(both).astype(np.int64)
    link = (both > 0) & (100 * both >= threshold * (sizes[:, None] + sizes[None, :] - both))
    np.fill_diagonal(link, True)
    label = np.arange(m)
    while True:
        near = np.where(link, label[None, :], m).min(axis=1)
        near = near[near]
        if (near == label).all():
            return label
        label = near


class Join:
    """What the rounds of one join share: vertices, texts, and the links found so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, threshold: float, key: str, text: str):
        self.docs, self.classes, self.k, self.threshold = docs.select(F.col(key).cast("long").alias("v"), utf8(text).alias("text")), classes, k, threshold
        self.least = math.floor(SIGNATURE * threshold - 6 * math.sqrt(SIGNATURE * threshold * (1 - threshold)))
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        self.links = links if self.links is None else self.links.unionByName(links)
        self.labels = components(self.links)

    def sets(self, needed: DataFrame) -> DataFrame:
        """(v, set): the full sets of the vertices in needed (v)."""
        k = self.k

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets_of(*raw(b.column(1)), k)], pa.binary())], ["v", "set"])

        texts = self.docs.join(sized(needed), "v")
        return materialize(texts.mapInArrow(cut, "v long, set binary").where(F.length("set") > 0), "sets")

    def confirm(self, pairs: DataFrame) -> None:
        """Adds the pairs (a, b) that are links on their full sets."""
        pairs = materialize(pairs, "pairs")
        sets = self.sets(materialize(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "needed"))
        threshold = round(self.threshold * 100)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "set_b"):
                kept = []
                for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    n = (len(x) + len(y)) // 8
                    both = n - len(np.unique(np.frombuffer(x + y, np.uint64)))
                    if both and 100 * both >= threshold * (n - both):
                        kept.append(i)
                at = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

        rows = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
        self.add(materialize(rows.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long"), "links"))

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows with v's component as far as it is known."""
        if self.labels is None:
            return rows.withColumn("label", F.col("v"))
        known = self.labels.select(F.col("node").alias("of"), F.col("component").alias("label"))
        return rows.join(known, F.col("v") == F.col("of"), "left").drop("of").withColumn("label", F.coalesce("label", "v"))

    def within(self, rows: DataFrame) -> DataFrame:
        """The pairs (a, b) in small nodes whose sizes and signatures allow a link, once each."""
        nodes = rows.join(self.classes.select("v", "n", "sig"), "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("v", "n", "sig"))).alias("m"))
        least, threshold = self.least, self.threshold

        def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a_out, b_out = [], []
                for m in b.column(0).to_pylist():
                    v, n = (np.array([x[c] for x in m]) for c in ("v", "n"))
                    sig = np.frombuffer(b"".join([x["sig"] for x in m]), np.uint32).reshape(len(m), -1)
                    i, j = np.triu_indices(len(m), 1)
                    ok = (v[i] != v[j]) & (np.minimum(n[i], n[j]) >= threshold * 0.999 * np.maximum(n[i], n[j]))
                    i, j = i[ok], j[ok]
                    ok = (sig[i] == sig[j]).sum(axis=1) >= least
                    a_out += v[i[ok]].tolist()
                    b_out += v[j[ok]].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

        return nodes.select("m").mapInArrow(pair, "a long, b long").distinct()

    def standing(self, members: DataFrame) -> DataFrame:
        """(node, v, tree, apart, strays, all): the members of nodes of several components; apart is 1 outside the node's most frequent one, strays counts these and all the members."""
        rows = self.labelled(members)
        home = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("times")).groupBy("node").agg(F.max(F.struct("times", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("times").alias("all")).where("labels > 1")
        home = materialize(home.select("node", F.col("top.label").alias("home"), (F.col("all") - F.col("top.times")).alias("strays"), "all"), "home")
        return materialize(rows.join(sized(home), "node").select("node", "v", "tree", (F.col("label") != F.col("home")).cast("int").alias("apart"), "strays", "all"), "standing")

    def blocks(self, rows: DataFrame) -> None:
        """Adds what connects the members in rows (see `standing`): those apart against all."""
        if not rows.limit(1).count():
            return
        # Blocks are cut by hash, in as many parts as give about BLOCK members each.
        rows = rows.select("node", "v", "apart", F.ceil(F.col("strays") / BLOCK).alias("own"), F.ceil(F.col("all") / BLOCK).alias("all"))
        spread = lambda n: F.pmod(F.xxhash64("v"), F.col(n))
        left = rows.where("apart = 1").select("node", "v", F.lit(0).alias("side"), spread("own").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("j"))
        right = rows.select("node", "v", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("i"), spread("all").alias("j"))
        self.meet(rows, left.unionByName(right).select(F.xxhash64("node", "i", "j").alias("block"), "v"))

    def attach(self, members: DataFrame) -> DataFrame:
        """Adds what connects the members of large nodes, that are apart, with each other in one block each and with the node's pivots; what then stands in nodes of several components."""
        rows = self.standing(members)
        if not rows.limit(1).count():
            return rows
        parts = F.greatest(F.ceil(F.col("strays") / BLOCK), F.lit(1).cast("long"))
        pivot = F.pmod(F.xxhash64("node", "v"), F.greatest(F.floor(F.col("all") / PIVOTS), F.lit(1).cast("long"))) == 0
        own = rows.where("apart = 1").select("node", "v", F.pmod(F.xxhash64("v"), parts).alias("i"))
        shown = rows.where(pivot).select("node", "v", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("i"))
        dealt = materialize(own.unionByName(shown).select(F.xxhash64("node", "i").alias("block"), "v").distinct(), "dealt")
        self.meet(dealt, dealt)
        return self.standing(rows.select("node", "v", "tree"))

    def meet(self, rows: DataFrame, dealt: DataFrame) -> None:
        """Adds what connects the members of each block in dealt (block, v); rows has all their vertices."""
        sets = self.sets(materialize(rows.select("v").distinct(), "needed"))
        threshold = round(self.threshold * 100)

        def compare(t: pa.Table) -> pa.Table:
            v = t.column("v").to_numpy()
            _, first = np.unique(v, return_index=True)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").take(pa.array(first)).to_pylist()]
            v = v[first]
            to = v[connected(sets, threshold)]
            found = to != v
            return pa.table({"a": to[found], "b": v[found]})

        self.add(materialize(dealt.join(sets, "v").groupBy("block").applyInArrow(compare, "a long, b long"), "links"))


def linked(docs: DataFrame, k: int, threshold: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, vertices with v and component)."""
    signed = materialize(signatures(docs, k, key, text), "signatures")
    classes = materialize(signed.where("n > 0 AND key IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("key").alias("v"), F.first("sig").alias("sig")), "classes")
    trees, level = tree_count(threshold, 0), 0
    join = Join(docs, classes, k, threshold, key, text)
    members = shared_nodes(roots(classes, 0, trees), "roots")
    while True:
        join.confirm(join.within(members.where(F.col("size") <= SMALL)))
        middle = members.where((F.col("size") > SMALL) & (F.col("size") <= LARGE)).select("node", "v", "tree")
        for part in PARTS:
            join.blocks(join.standing(middle.where(part)))
        large = members.where(F.col("size") > LARGE).select("node", "v", "tree")
        wide = None
        for part in PARTS if large.limit(1).count() else ():
            rows = join.attach(large.where(part))
            join.blocks(rows if level == LEVELS else rows.where(F.col("strays") <= LARGE))
            rows = rows.where(F.col("strays") > LARGE).select("node", "v", "tree")
            wide = rows if wide is None else wide.unionByName(rows)
        if wide is None or level == LEVELS or not wide.limit(1).count():
            return signed, join.labelled(classes.select("n", "h1", "h2", "v")).withColumnRenamed("label", "component")
        children = branches(wide.join(classes.select("v", "sig"), "v"), threshold)
        if not level:
            more = classes.join(wide.select("v").distinct(), "v", "left_semi")
            children = children.unionByName(roots(more, trees, tree_count(threshold, LEVELS)))
        members, level = shared_nodes(children, "branches"), level + 1


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component (the smallest key it is linked with, itself included) and kept (the row is its component's own)."""
    rows, classes = linked(docs, k, threshold, key, text)
    of = classes.select(F.col("n").alias("n_c"), F.col("h1").alias("h1_c"), F.col("h2").alias("h2_c"), "component")
    got = rows.drop("sig").join(of, (F.col("n") == F.col("n_c")) & (F.col("h1") == F.col("h1_c")) & (F.col("h2") == F.col("h2_c")), "left")
    component = F.coalesce("component", "key")
    return got.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def distinct_rows(docs: DataFrame, k: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key is its component's own, one row per key (rows with null keys all stay), with their columns."""
    of = fresh(docs, "gone")
    found = materialize(near_duplicates(docs, k, threshold, key, text).select(F.col(key).alias("gone"), "kept"), "kept").withColumnRenamed("gone", of)
    # Rows that go, and keys that stand in several rows; either may be few or many.
    gone = materialize(found.where("NOT kept").select(of).distinct(), "gone")
    again = materialize(found.where(F.col("kept") & F.col(of).isNotNull()).groupBy(of).count().where("count > 1").select(of), "again")
    left = docs.join(sized(gone), F.col(key) == F.col(of), "left_anti")
    if not again.limit(1).count():
        return left
    same = sized(again)
    return left.join(same, F.col(key) == F.col(of), "left_anti").unionByName(left.join(same, F.col(key) == F.col(of), "left_semi").dropDuplicates([key]))


def sized(keys: DataFrame) -> DataFrame:
    """keys for broadcast if they are few, else for a join by shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys.hint("shuffle_hash")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 0.85).withColumnRenamed("component", "component_id")
