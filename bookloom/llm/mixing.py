"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

Each source gets a share of the mix by its weight, at most `most` times its size; what it can't take
is shared again by weight. A source's whole copies are certain; the rest is a sample: documents are
ranked by random odds divided by inclusion odds, and taken in that order until their words reach the
rest. A document's inclusion odds are those of its source (rest to what is not taken) times its size by the
source's mean size, within 1 / SPREAD and SPREAD: long documents are likelier, in proportion to their words.
Random numbers come from a hash of seed and key, so reruns agree.

A source may hold most rows, so its order is never sorted in one task: documents fall into buckets of
about BUCKET (at most SPREAD times that on average) by their rank, words are summed per bucket, and only the
bucket in which the target is reached is ordered row by row. Four passes over that bucket fill what is left
with documents that fit; what none of them fits stays open, half a document of that bucket at most.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source, last
in order; a null key hashes as the text 'null'; rows that agree in source, key and size are taken or
left together; other columns are kept by `mixed` and ignored by `shares`; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.llm.common import materialize, table

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, 7
BUCKET = 4096
#: How far a document's inclusion odds may be from its source's, either way.
SPREAD = 16
#: Sources, and documents chosen inside buckets, are broadcast up to so many.
BROADCAST_ROWS = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def draw(key: str) -> Column:
    """A number in (0, 1) that depends on seed and key alone."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(totals: DataFrame) -> DataFrame:
    """(source, size, n) with each source's target: a row per source goes through two small windows."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = totals.withColumn("weight", weight.cast("double")).withColumn("full", (F.col("size") * MOST).cast("double"))
    by_level = W.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    t = t.withColumn("level", (F.sum("size").over(whole) * SHARE - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("free", F.col("level") < F.col("full") / F.col("weight"))
    t = t.withColumn("level", F.max(F.when(F.col("free"), F.col("level"))).over(whole))
    return t.withColumn("target", F.when(F.col("free"), F.col("level") * F.col("weight")).otherwise(F.col("full")))


def plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (source, key, size, draw): a row per source with its copies and the bucket where its target is reached; and the keys taken inside those buckets."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    s = targets(totals).withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int"))
    s = s.withColumn("rest", F.col("target") - F.col("copies") * F.col("size")).withColumn("buckets", F.ceil(F.col("n") / BUCKET))
    s = materialize(s.select("source", F.col("size").alias("source_size"), "target", "copies", "rest", "buckets", (F.col("size") / F.col("n")).alias("mean")), "sources")
    dealt = sizes.join(small(s.select(F.col("source").alias("of"), "rest", "buckets", "source_size", "mean"), s), F.col("source").eqNullSafe(F.col("of"))).withColumn("scaled", scaled()).withColumn("bucket", bucket())
    summed = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    reached = summed.withColumn("end", running).where(F.col("end") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("end") - F.col("words")).alias("before"))).alias("at"))
    reached = reached.select(F.col("source").alias("in"), F.col("at.bucket").alias("edge"), F.col("at.before").alias("before"))
    s = materialize(s.join(reached, F.col("source").eqNullSafe(F.col("in")), "left").drop("in"), "edges")
    edges = small(s.select(F.col("source").alias("in"), "edge", "before"), s)
    units = dealt.join(edges, F.col("source").eqNullSafe(F.col("in")) & (F.col("bucket") == F.col("edge")))
    units = units.groupBy("source", "key", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words"), *(F.first(c).alias(c) for c in ("scaled", "rest", "source_size", "before")))
    chance = F.col("rest") / F.col("source_size")
    units = units.withColumn("rank", F.when(chance > 0, F.col("scaled") / (chance / (1 - chance)))).withColumn("left", F.col("rest") - F.col("before")).withColumn("taken", F.lit(False))
    order = W.partitionBy("source").orderBy(F.col("rank").asc_nulls_last(), F.col("key").asc_nulls_last(), "size")
    for _ in range(3):
        fits = ~F.col("taken") & (F.col("words") <= F.col("left"))
        units = units.withColumn("run", F.sum(F.when(fits, F.col("words")).otherwise(0)).over(order))
        units = units.withColumn("now", fits & (F.col("run") <= F.col("left"))).withColumn("taken", F.col("taken") | F.col("now"))
        units = units.withColumn("left", F.col("left") - F.sum(F.when(F.col("now"), F.col("words")).otherwise(0)).over(W.partitionBy("source")))
    close = ~F.col("taken") & (F.col("words") < 2 * F.col("left"))
    units = units.withColumn("last", close & (F.sum(F.when(close, 1).otherwise(0)).over(order) == 1))
    chosen = units.where((F.col("taken") | F.col("last")) & (F.col("words") > 0)).select(F.col("source").alias("c_source"), F.col("key").alias("c_key"), F.col("size").alias("c_size"))
    return s, materialize(chosen, "chosen")


def scaled() -> Column:
    """Random odds by a document's odds against its source's: the rank but for a factor of the source."""
    odds = F.col("draw") / (1 - F.col("draw"))
    return odds / F.greatest(F.least(F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(1.0), F.lit(float(SPREAD))), F.lit(1.0 / SPREAD))


def bucket() -> Column:
    """By rank, about even where sizes are."""
    return F.least(F.floor(F.col("scaled") / (1 + F.col("scaled")) * F.col("buckets")), F.col("buckets") - 1)


def small(df: DataFrame, counted: DataFrame) -> DataFrame:
    """df, of as many rows as counted, for broadcast where these are few; else Spark joins by its own choice."""
    return F.broadcast(df) if counted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def decided(rows: DataFrame, sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds `copies` of each row to rows with source, key, size and draw, and its source's size and target. No shuffle of rows while sources are few."""
    s = sources.select(F.col("source").alias("of"), "source_size", "target", F.col("copies").alias("whole"), "buckets", "edge", "mean")
    rows = rows.join(small(s, sources), F.col("source").eqNullSafe(F.col("of"))).withColumn("scaled", scaled()).withColumn("bucket", bucket())
    same = F.col("source").eqNullSafe(F.col("c_source")) & F.col("key").eqNullSafe(F.col("c_key")) & (F.col("size") == F.col("c_size"))
    rows = rows.join(small(chosen, chosen), same, "left")
    more = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)) | F.col("c_size").isNotNull()
    return rows.withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0)).drop("of", "whole", "buckets", "edge", "mean", "scaled", "bucket", "c_source", "c_key", "c_size")


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(source).alias("source"), F.col(key).alias("key"), word_count(text).alias("size"), draw(key).alias("draw"))


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: key, size (words), source_size, target (of its source), copies, taken (words, repeats counted)."""
    sizes = materialize(sized(docs, key, text, source), "sizes")
    got = decided(sizes, *plan(sizes)).withColumn("taken", F.col("copies") * F.col("size"))
    return got.select(F.col("key").alias(key), "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its columns alone."""
    sizes = materialize(sized(docs, key, text, source), "sizes")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(own, F.col(source).alias("source"), F.col(key).alias("key"), word_count(text).alias("size"), draw(key).alias("draw"))
    got = decided(rows, *plan(sizes)).where(F.col("copies") > 0)
    return got.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"))


#: The same mix in DuckDB.
OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
  FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
s2 AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS w,
         CAST(source_size * {MOST} AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE}::DOUBLE
                  - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2
       WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
s4 AS (SELECT *, max(CASE WHEN level < cap / w THEN level END) OVER () AS flat FROM s3),
s5 AS (SELECT source, source_size, n, CASE WHEN level < cap / w THEN flat * w ELSE cap END AS target FROM s4),
s AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole,
        CAST(ceil(n / {BUCKET}::DOUBLE) AS BIGINT) AS buckets FROM s5),
b0 AS (SELECT d.*, s.source_size, s.target, s.whole, target - whole * s.source_size AS rest, buckets,
        u / (1 - u) / greatest(least(CASE WHEN s.source_size > 0 THEN size / (s.source_size / n::DOUBLE) ELSE 1 END, {SPREAD}.0::DOUBLE), 1 / {SPREAD}.0::DOUBLE) AS x
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
b AS (SELECT *, least(CAST(floor(x / (1 + x) * buckets) AS BIGINT), buckets - 1) AS bucket FROM b0),
g AS (SELECT source, bucket, sum(size) AS words, any_value(rest) AS rest FROM b GROUP BY source, bucket),
r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS stop FROM g),
e AS (SELECT source, min(bucket) AS edge, arg_min(stop - words, bucket) AS before FROM r WHERE stop > rest GROUP BY source),
u0 AS (SELECT b.source, doc_id, size, count(*) * size AS words, any_value(x) AS x, any_value(rest) / any_value(source_size) AS chance,
         any_value(rest) - any_value(before) AS gap
       FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source AND bucket = edge GROUP BY b.source, doc_id, size),
u1 AS (SELECT *, CASE WHEN chance > 0 THEN x / (chance / (1 - chance)) END AS rank FROM u0),
a1 AS (SELECT *, words <= gap AND sum(CASE WHEN words <= gap THEN words ELSE 0 END) OVER o <= gap AS t1 FROM u1
       WINDOW o AS (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)),
b1 AS (SELECT *, gap - sum(CASE WHEN t1 THEN words ELSE 0 END) OVER (PARTITION BY source) AS g1 FROM a1),
a2 AS (SELECT *, NOT t1 AND words <= g1 AND sum(CASE WHEN NOT t1 AND words <= g1 THEN words ELSE 0 END) OVER o <= g1 AS t2 FROM b1
       WINDOW o AS (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)),
b2 AS (SELECT *, g1 - sum(CASE WHEN t2 THEN words ELSE 0 END) OVER (PARTITION BY source) AS g2 FROM a2),
a3 AS (SELECT *, NOT (t1 OR t2) AND words <= g2 AND sum(CASE WHEN NOT (t1 OR t2) AND words <= g2 THEN words ELSE 0 END) OVER o <= g2 AS t3 FROM b2
       WINDOW o AS (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)),
b3 AS (SELECT *, g2 - sum(CASE WHEN t3 THEN words ELSE 0 END) OVER (PARTITION BY source) AS g3 FROM a3),
a4 AS (SELECT *, NOT (t1 OR t2 OR t3) AND words < 2 * g3
         AND sum(CASE WHEN NOT (t1 OR t2 OR t3) AND words < 2 * g3 THEN 1 ELSE 0 END) OVER o = 1 AS t4 FROM b3
       WINDOW o AS (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)),
c AS (SELECT source, doc_id, size FROM a4 WHERE (t1 OR t2 OR t3 OR t4) AND words > 0)
SELECT b.doc_id, b.size, b.source_size, b.target, copies, CAST(copies * b.size AS BIGINT) AS taken
FROM (SELECT b.*, CAST(b.whole + CASE WHEN coalesce(b.bucket < e.edge, false) OR c.size IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS copies
      FROM b LEFT JOIN e ON b.source IS NOT DISTINCT FROM e.source
      LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source AND b.doc_id IS NOT DISTINCT FROM c.doc_id AND b.size = c.size) b
"""
