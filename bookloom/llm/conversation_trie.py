"""Prefix trie of conversations: polynomial rolling fingerprints, verified turn by turn, and a rollup to parents.

`numbered` ranks each conversation's turns. `prefix_trie` gives every prefix of a conversation a fingerprint,
the sum of its turns' hashes times powers of a constant modulo 2**64, by numpy scans over sorted partitions.
Rows of one depth and fingerprint are candidates for one node; each is compared with the turn of the
group's representative (its smallest conversation). Rows that differ have collided: their turn's term is changed
by a second hash, which changes all deeper fingerprints of the conversation too, and the scan is repeated until
no row differs. Since a group whose turns agree at every depth has equal terms at every depth, groups without
differences are exactly the nodes.

Rollup without a loop over depths: a node belongs to its smallest member, and each conversation owns the lower
end of its path, so what a conversation owns adds up by suffix sums, and a node's subtree is what its
members own, less what its owner owns above it. Both are aggregations, whatever the depth of the trie.

Scale: turns are dealt by ranges of (conversation, turn), so a conversation of any length is split, and scans
that cross partitions are joined by offsets (at most two rows for each partition). A node with a large share of all
conversations meets its representative's turn in a join that adaptive execution splits; counts and sums are
partial before they are shuffled; the members that end in a node are put together in pieces of at most 4096
numbers, and their digest takes the pieces in order, one at a time (a SHA-256 has no parts).

Defined results: rows without a conversation's number belong to none and are left out; null turns come first, turns of
equal number follow by role, then text, and repeated rows are turns of their own; null roles and texts are
empty; texts of any length are compared whole; a conversation that is rebuilt to nothing counts at the root; other
columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.llm.common import materialize, mix, partitions, table

_P = 0x9E3779B97F4A7C15
#: Ends of one node are gathered for conversations whose numbers agree but for so many low bits.
PIECE_BITS = 12
#: Suffix sums are made inside blocks of so many turns, and over blocks.
BLOCK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "print"]


def _starts(conv: np.ndarray) -> np.ndarray:
    """Where a sorted column begins a new value."""
    return np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if len(conv) else np.empty(0, np.int64)


def _within(totals: np.ndarray, starts: np.ndarray, carry) -> np.ndarray:
    """Running totals (one more than rows, from 0) counted from each start; the first group goes on from carry."""
    base = np.repeat(totals[starts], np.diff(np.r_[starts, len(totals) - 1]))
    out = totals[1:] - base
    if len(starts):
        out[: starts[1] if len(starts) > 1 else len(out)] += carry
    return out


def numbered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, role, text): every turn with its place in its conversation, from 0."""
    spark = rows.sparkSession
    kept = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    # Ranges are cut at the beginnings of texts, so that samples of whole texts don't go to the driver.
    ranges = [F.col("conv"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64)]
    dealt = kept.repartitionByRange(partitions(spark), *ranges).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column(0).to_numpy()
            starts = _starts(c)
            pos = _within(np.arange(len(c) + 1), starts, carry if c[0] == last else 0) - 1
            last, carry = c[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), b.column(0), pa.array(pos), b.column(1), b.column(2)], ["part", "conv", "pos", "role", "text"])

    ranked = materialize(dealt.select("conv", "role", "text").mapInArrow(rank, "part int, conv long, pos long, role string, text string"), "turns")
    # Only a conversation that goes on in another partition needs an offset: at most one begins in each.
    ends = ranked.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    several = ends.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).where(F.size("parts") > 1)
    before = several.select("conv", F.posexplode("parts").alias("i", "p"), "parts").select("conv", F.col("p.part").alias("part"), F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("before"))
    return ranked.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text")


def _wrapped(a: str, b: Column) -> Column:
    """a + b modulo 2**64."""
    half, whole = F.expr("CAST(9223372036854775808 AS DECIMAL(38, 0))"), F.expr("CAST(18446744073709551616 AS DECIMAL(38, 0))")
    return F.when(b.isNull(), F.col(a)).otherwise((F.pmod(F.col(a).cast("decimal(38,0)") + b.cast("decimal(38,0)") + half, whole) - half).cast("long"))


def fingerprinted(turns: DataFrame) -> DataFrame:
    """turns (conv, pos, hash, ...) with print, the fingerprint up to and with the turn, and above, that of the turns before it."""
    spark, rest = turns.sparkSession, [c for c in turns.columns if c not in ("conv", "pos", "hash")]
    dealt = turns.select("conv", "pos", "hash", *rest).repartitionByRange(partitions(spark), "conv", "pos").sortWithinPartitions("conv", "pos")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, np.uint64(0)
        for b in batches:
            if not b.num_rows:
                continue
            c, pos, h = (b.column(i).to_numpy() for i in range(3))
            term = mix(h.view(np.uint64)) * np.power(np.uint64(_P), pos.astype(np.uint64))
            whole = _within(np.r_[np.uint64(0), np.cumsum(term)], _starts(c), carry if c[0] == last else np.uint64(0))
            last, carry = c[-1], whole[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), *b.columns, pa.array(whole.view(np.int64)), pa.array((whole - term).view(np.int64))], names)

    names = ["part", "conv", "pos", "hash", *rest, "print", "above"]
    kinds = dict(turns.dtypes)
    schema = ", ".join(["part int", *(f"{c} {kinds[c]}" for c in names[1:-2]), "print long", "above long"])
    local = materialize(dealt.mapInArrow(scan, schema), "prints")
    ends = local.groupBy("conv", "part").agg(F.max_by("print", "pos").alias("sum"))
    several = ends.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "sum"))).alias("parts")).where(F.size("parts") > 1)
    before = several.select("conv", F.posexplode("parts").alias("i", "p"), "parts").select("conv", F.col("p.part").alias("part"), F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x["sum"].cast("decimal(38,0)")).cast("decimal(38,0)")).alias("before"))
    return local.join(F.broadcast(before), ["conv", "part"], "left").select(*(c for c in names if c not in ("part", "print", "above")), _wrapped("print", F.col("before")).alias("print"), _wrapped("above", F.col("before")).alias("above"))


def verified(turns: DataFrame, weak_bits: int = 64) -> DataFrame:
    """turns (conv, pos, role, text) with depth, print, above, n_bytes: rows agree in depth and print exactly where their conversations agree up to there.

    weak_bits: how many bits the first round's hashes have, for tests of collisions.
    """
    first = F.xxhash64("role", "text")
    rows = turns.withColumn("hash", first if weak_bits == 64 else F.shiftrightunsigned(first, 64 - weak_bits))
    while True:
        found = materialize(fingerprinted(rows).withColumn("depth", F.col("pos") + 1), "candidates")
        chosen = found.groupBy(*NODE).agg(F.min_by(F.struct("role", "text"), "conv").alias("chosen"))
        apart = found.join(chosen, NODE).where((F.col("role") != F.col("chosen.role")) | (F.col("text") != F.col("chosen.text"))).select("conv", "pos")
        apart = materialize(apart, "collided")
        if apart.isEmpty():
            return found.select("conv", *NODE, "above", F.octet_length("text").cast("long").alias("n_bytes"))
        other = F.xxhash64(F.lit(_P % (1 << 31)), "text", "role", "hash")
        rows = found.join(apart.withColumn("split", F.lit(True)), ["conv", "pos"], "left").select("conv", "pos", "role", "text", F.when(F.col("split"), other).otherwise(F.col("hash")).alias("hash"))


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, print, ends): the SHA-256 of the numbers of conversations (depth, print, conv) that end in a node."""
    pieces = ends.groupBy(*NODE, F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        kinds = [pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            out = []
            for *now, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)], [*NODE, "ends"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), kinds, strict=True)], [*NODE, "ends"])

    return dealt.mapInArrow(digest, "depth long, print long, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame, weak_bits: int = 64) -> DataFrame:
    """The trie of turns (conv, pos, role, text); convs (conv, total) has every conversation, those without turns too.

    Per node: conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, the bytes of the last text for each member but one) and ends_sha256.
    """
    rows = materialize(verified(turns, weak_bits), "paths")
    nodes = rows.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n"), F.min("n_bytes").alias("n_bytes"), F.min("above").alias("above"))
    root = convs.agg(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("above"))
    nodes = materialize(nodes.unionByName(root.where("n > 0")), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("print")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = nodes.join(kids, NODE, "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    nodes = nodes.withColumns({"leaf": (F.col("kids") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("n_bytes")})
    # What an owner owns from a depth on: inside a block of its path, and in the blocks after it.
    block = F.floor(F.col("depth") / BLOCK)
    nodes = materialize(nodes.withColumn("block", block), "owned")
    blocks = nodes.groupBy("owner", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    later = W.partitionBy("owner").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("owner", "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("leaf", "saved")))
    below = W.partitionBy("owner", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    nodes = nodes.select("*", *(F.sum(c).over(below).alias(f"below_{c}") for c in ("leaf", "saved"))).join(blocks, ["owner", "block"])
    nodes = nodes.withColumns({f"below_{c}": F.col(f"below_{c}") + F.col(f"later_{c}") for c in ("leaf", "saved")})
    nodes = materialize(nodes.select(*NODE, "owner", "n", "above", "kids", "below_leaf", "below_saved"), "suffixes")
    # The last of them is all that its owner owns.
    owned = nodes.groupBy("owner").agg(F.min_by(F.struct("below_leaf", "below_saved"), "depth").alias("x")).select(F.col("owner").alias("conv"), F.col("x.below_leaf").alias("leaf"), F.col("x.below_saved").alias("saved"))
    paths = rows.select(*NODE, "conv").unionByName(convs.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), "conv"))
    sums = paths.join(owned, "conv").groupBy(*NODE).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    last = paths.join(convs, "conv").where(F.col("depth") == F.col("total")).select(*NODE, "conv")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("above"), F.col("owner").alias("parent"))
    own = owned.select(F.col("conv").alias("owner"), F.col("leaf").alias("own_leaf"), F.col("saved").alias("own_saved"))
    full = nodes.join(sums, NODE).join(own, "owner").join(parents, ["depth", "above"], "left").join(_ends(last), NODE, "left")
    return full.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        (F.col("leaf") - F.col("own_leaf") + F.col("below_leaf")).alias("n_leaves"), (F.col("saved") - F.col("own_saved") + F.col("below_saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations (conv, pos, role, text) and (conv, total): each begins with the first turns of the one whose number is its own less the remainder by 5 (as in SQL, with the sign of the number)."""
    turns = materialize(turns, "ranked")
    base = F.col("conv") - F.col("conv") % 5
    convs = turns.groupBy("conv").agg((F.max("pos") + 1).alias("len")).withColumns({"base": base, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % 9})
    lengths = convs.select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    convs = convs.join(lengths, "base", "left").withColumn("k", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = materialize(convs.select("conv", "base", "h", "k", (F.col("k") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total")), "convs")
    own = turns.join(convs, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "role", "text")
    heads = turns.where("conv % 5 = 0 AND pos < 8").withColumnRenamed("conv", "base")
    shared = heads.join(convs, "base").where("pos < h").select("conv", "pos", "role", "text")
    return materialize(own.unionByName(shared), "rebuilt"), convs.select("conv", "total")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))


#: A checksum of decimal digits by its definition, bit by bit; prefixes as lists, subtrees by the prefixes of each node's list.
OP13_SQL = """WITH
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(x ORDER BY i) AS xs FROM t GROUP BY c),
k AS (SELECT c, xs, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda p, q: CASE WHEN p % 2 = 1 THEN xor(p >> 1, 3988292384::BIGINT) ELSE p >> 1 END)), 4294967295::BIGINT) % 9 AS h FROM l),
r AS (SELECT k.c, list_concat(coalesce(b.xs, [])[1:k.h], k.xs[k.h + 1:]) AS p FROM k LEFT JOIN l b ON b.c = k.c - k.c % 5),
m AS (SELECT c, unnest(range(0, len(p) + 1)) AS d, p FROM r),
n0 AS (SELECT d, p[1:d] AS p, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(m.p) = d), '')) AS ends FROM m GROUP BY d, p[1:d]),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS kids FROM n0 WHERE d > 0 GROUP BY ALL),
n AS (SELECT n0.*, coalesce(kids, 0) AS kids, CASE WHEN n0.d = 0 THEN 0 ELSE (n - 1) * octet_length(encode(n0.p[n0.d].t)) END AS saved FROM n0 LEFT JOIN kids ON kids.d = n0.d AND kids.p = n0.p),
u AS (SELECT unnest(range(0, d + 1)) AS a, p, kids, saved FROM n),
s AS (SELECT a AS d, p[1:a] AS p, count(*) FILTER (kids = 0) AS leaves, CAST(sum(saved) AS BIGINT) AS saved FROM u GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, n.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.p = n.p LEFT JOIN n0 up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]"""
