"""Order statistics of the last rows of a key, at every row.

A key's rows are numbered by a two-level count and cut into blocks of BLOCK rows; each block is given the rows before it that
its first windows reach back to, and is read alone, in order, beside a sorted list of the window's values into which one
value is put and out of which one is taken at each row. No task holds more than a block and a window of rows.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.operators.scan import running

BLOCK = 65_536


class Window:
    """The last `size` values in order of arrival and in order of size."""

    def __init__(self, size: int):
        self.size, self.recent, self.sorted = size, deque(), []

    def add(self, x: float) -> None:
        if len(self.recent) == self.size:
            del self.sorted[bisect.bisect_left(self.sorted, self.recent.popleft())]
        self.recent.append(x)
        bisect.insort(self.sorted, x)

    def rank(self, f: float) -> float:
        """The value at floor(n * f) of the sorted ones."""
        return self.sorted[min(len(self.sorted) - 1, int(len(self.sorted) * f))]


def sliding_percentiles(df: DataFrame, key: str, order: str, value: str, size: int = 8192, block: int = BLOCK) -> DataFrame:
    """(key, order, n, p50, p90, p99, most) at every row with a value: of the last `size` values of its key. order must tell rows of a key apart."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(value).cast("double").alias("x"))
    rows = running(rows, "key", ["at"], {"place": F.lit(1)}).withColumn("block", F.floor((F.col("place") - 1) / block))
    # The last size - 1 rows before a block are read by it too, but not told again.
    reach = F.floor((F.col("place") + size - 2) / block)
    rows = rows.withColumn("part", F.explode(F.sequence(F.col("block"), reach)))
    key_type, at_type = (df.schema[c].dataType.simpleString() for c in (key, order))

    def tell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, window = None, Window(size)
        for b in parts:
            out = []
            for k, at, x, own, part in zip(b["key"], b["at"], b["x"], b["block"], b["part"], strict=True):
                if (k, part) != group:
                    group, window = (k, part), Window(size)
                window.add(x)
                if own == part:
                    out.append((k, at, len(window.sorted), window.rank(0.5), window.rank(0.9), window.rank(0.99), window.sorted[-1]))
            yield pd.DataFrame(out, columns=["key", "at", "n", "p50", "p90", "p99", "most"])

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "place")
    found = dealt.select("key", "at", "x", "block", "part").mapInPandas(tell, f"key {key_type}, at {at_type}, n bigint, p50 double, p90 double, p99 double, most double")
    return found.withColumnsRenamed({"key": key, "at": order})
