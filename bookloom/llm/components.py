"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import BROADCAST_KEYS, materialize

#: A node's links meet its label in parts of about so many.
HUB = 2048


def components(links: DataFrame, label: str = "component") -> DataFrame:
    """(node, label) for every node of links (a, b: long): the smallest node it is connected with.

    Each round every node takes the smallest label among its neighbours, then the label of its label,
    until no label changes; labels jump, so the rounds grow with the logarithm of the longest path. A
    round's table is written to the shared folder. The links of a node with more than HUB are dealt to
    parts by their other end, and the node's label is repeated for each part; the minima of a group are
    partial before they are shuffled.
    """
    edges = links.where("a <> b").select("a", "b").distinct()
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    near = edges.groupBy("a").agg(F.min("b").alias("near"), F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts"))
    nodes = materialize(near.select(F.col("a").alias("node"), F.least("a", "near").alias("label"), "parts"), "labels")
    hubs = nodes.where("parts > 1").select(F.col("node").alias("hub"), "parts")
    some = hubs.limit(BROADCAST_KEYS + 1).count()
    if some:
        edges = edges.join(F.broadcast(hubs) if some <= BROADCAST_KEYS else hubs, F.col("b") == F.col("hub"), "left")
        edges = materialize(edges.select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")), "edges")
    while True:
        ends = nodes.select(F.col("node").alias("b"), "label", "parts")
        if some:
            seen = edges.join(ends.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["b", "part"])
        else:
            seen = edges.join(ends, "b")
        seen = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = nodes.join(seen, "node").select("node", "parts", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = nodes.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = hooked.join(of, F.col("label") == F.col("at"), "left").select("node", "parts", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        after = materialize(jumped, "labels")
        changed = after.where("label <> old").limit(1).count()
        nodes = after.select("node", "label", "parts")
        if not changed:
            return nodes.select("node", F.col("label").alias(label))
