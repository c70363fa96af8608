"""Scans over the histories of keys in two levels, so that no task holds a history.

A history is cut into blocks by ranges of (key, order); each block is folded alone, the few totals of blocks are
put in order, and each block's rows are then given what stood before it. Sums and counts are folded by windows;
recurrences whose step is an affine map of the state, x -> a * x + b, are folded by numpy scans, since maps
compose: a block's map is known before its start is. A block has as many rows as Spark's ranges give it, whatever
the sizes of histories; what crosses blocks is a row for each block and key in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.tables import cut

#: The column that says in which block a row is.
BLOCK = "__block"


def blocks(df: DataFrame, key: str, order: list[str], count: int | None = None) -> DataFrame:
    """df with the number of each row's block, written once: blocks are ranges of (key, order) in ascending order."""
    count = count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(count, key, *order).withColumn(BLOCK, F.spark_partition_id()), "blocks")


def a_task_each(df: DataFrame, count: int | None) -> DataFrame:
    """Blocks dealt to a task each by their numbers, however many they are: by a hash, some tasks would get several, and more of them the more blocks there are."""
    return df.repartitionById(count, BLOCK) if count else df


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], count: int | None = None) -> DataFrame:
    """Adds, for each name, the sum of a Column over the key's rows up to and with the row. order must tell rows of a key apart."""
    cols = df.columns
    df = blocks(df.select("*", *(x.cast("long").alias(f"__{n}") for n, x in sums.items())), key, order, count)
    inside = W.partitionBy(BLOCK, key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = df.groupBy(key, BLOCK).agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in sums))
    before = W.partitionBy(key).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    # Keys that lie in one block need nothing from others; those that do not are two for each block at most.
    crossing = totals.select(F.col(key).alias("__key"), F.col(BLOCK).alias("__of"), *(F.sum(f"__{n}").over(before).alias(f"__before_{n}") for n in sums)).where(F.col(f"__before_{next(iter(sums))}").isNotNull())
    df = a_task_each(df, count)
    out = df.select(*cols, BLOCK, *(F.sum(f"__{n}").over(inside).alias(n) for n in sums)).join(F.broadcast(crossing), F.col(key).eqNullSafe(F.col("__key")) & (F.col(BLOCK) == F.col("__of")), "left")
    return out.select(*cols, *((F.col(n) + F.coalesce(f"__before_{n}", F.lit(0))).alias(n) for n in sums))


def affine_block(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The compositions of x -> a[i] * x + b[i] for i = 0..k, for every k, by doubling."""
    a, b, n, width = a.copy(), b.copy(), len(a), 1
    while width < n:
        b[width:] += a[width:] * b[:-width]
        a[width:] = a[width:] * a[:-width]
        width *= 2
    return a, b


def affine_scan(df: DataFrame, key: str, order: list[str], maps: dict[str, tuple[Column, Column]], count: int | None = None) -> DataFrame:
    """Adds, for each name, the state after the row of x -> a * x + b along the key's rows, from 0. maps: name -> (a, b); a row with a = 0 starts afresh at b.

    Three steps: blocks are folded in parallel (numpy scans in which maps are composed pairwise), the maps of whole blocks
    are composed in order for the few keys that cross blocks, and each block's rows are finished with its start.
    """
    names, cols = list(maps), df.columns
    wide = df.select("*", *(x.cast("double").alias(f"__{p}_{n}") for n, ab in maps.items() for p, x in zip("ab", ab, strict=True)))
    wide = wide.repartitionByRange(count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, *order).sortWithinPartitions(key, *order)
    pairs = [f"__{p}_{n}" for n in names for p in "ab"]
    kinds = dict(wide.dtypes)
    schema = ", ".join([f"{BLOCK} int", *(f"`{c}` {kinds[c]}" for c in [*cols, *pairs])])
    at = cols.index(key)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, carry = TaskContext.get().partitionId(), None, [(1.0, 0.0)] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at)
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            goes_on = last is not None and keys[0].as_py() == last
            out = []
            for i in range(len(names)):
                a, b = (np.array(batch.column(len(cols) + 2 * i + j).to_numpy(zero_copy_only=False), float) for j in range(2))
                # The first row of a key in a block keeps its map; a later key's scan must not see the keys before it.
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
                    a[s:e], b[s:e] = affine_block(a[s:e], b[s:e])
                if goes_on:
                    e = starts[1] if len(starts) > 1 else len(a)
                    b[:e] += a[:e] * carry[i][1]
                    a[:e] = a[:e] * carry[i][0]
                carry[i] = (float(a[-1]), float(b[-1]))
                out += [pa.array(a), pa.array(b)]
            last = keys[len(keys) - 1].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int32)), *batch.columns[: len(cols)], *out], [BLOCK, *cols, *pairs])

    folded = cut(wide.mapInArrow(fold, schema), "folded")
    ends = folded.groupBy(key, BLOCK).agg(F.max_by(F.struct(*pairs), F.struct(*order)).alias("m"))
    crossing = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(BLOCK), "m"))).alias("parts")).where(F.size("parts") > 1)
    crossing = crossing.select(key, F.posexplode("parts").alias("__i", "p"), "parts")

    def start(n: str) -> Column:
        return F.aggregate(F.slice("parts", 1, F.col("__i")), F.lit(0.0), lambda x, p: p["m"][f"__a_{n}"] * x + p["m"][f"__b_{n}"])

    starts = crossing.select(key, F.col("p")[BLOCK].alias(BLOCK), *(start(n).alias(f"__start_{n}") for n in names))
    out = folded.join(F.broadcast(starts), [key, BLOCK], "left")
    return out.select(*cols, *((F.col(f"__a_{n}") * F.coalesce(f"__start_{n}", F.lit(0.0)) + F.col(f"__b_{n}")).alias(n) for n in names))


def time_averages(df: DataFrame, key: str, order: list[str], fresh: Column, dt: Column, averages: dict[str, tuple[Column, float]], most_dt: float, count: int | None = None) -> DataFrame:
    """Adds exponential averages that forget half in each half-life: name -> (sample, half-life in ms). A fresh row seeds them; a null sample leaves them as they were (and must not be fresh)."""
    def one(x: Column, half_life: float) -> tuple[Column, Column]:
        keep = F.exp(-float(np.log(2.0)) * F.least(F.greatest(dt, F.lit(0.0)), F.lit(float(most_dt))) / float(half_life))
        return F.when(fresh, 0.0).when(x.isNull(), 1.0).otherwise(keep), F.when(fresh, x).when(x.isNull(), 0.0).otherwise((1 - keep) * x)

    return affine_scan(df, key, order, {n: one(x, h) for n, (x, h) in averages.items()}, count)


def lagged(df: DataFrame, key: str, order: list[str], columns: dict[str, str], count: int | None = None) -> DataFrame:
    """Adds, for each new name, the column's value in the key's row before (null in its first). order must tell rows of a key apart."""
    cols = df.columns
    df = blocks(df, key, order, count)
    inside = W.partitionBy(BLOCK, key).orderBy(*order)
    # Dealt before it is grouped: rows of so many types are sorted for it, which should be a block's, not those of all files that a task reads.
    ends = a_task_each(df.select(key, BLOCK, *dict.fromkeys([*order, *columns.values()])), count).groupBy(key, BLOCK).agg(F.max_by(F.struct(*columns.values()), F.struct(*order)).alias("__last"))
    halo = ends.select(key, BLOCK, F.lag("__last").over(W.partitionBy(key).orderBy(BLOCK)).alias("__halo")).where("__halo IS NOT NULL")
    df = a_task_each(df, count)
    out = df.select(*cols, BLOCK, F.row_number().over(inside).alias("__n"), *(F.lag(c).over(inside).alias(n) for n, c in columns.items())).join(F.broadcast(halo), [key, BLOCK], "left")
    return out.select(*cols, *(F.when(F.col("__n") == 1, F.col("__halo")[c]).otherwise(F.col(n)).alias(n) for n, c in columns.items()))
