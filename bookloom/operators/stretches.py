"""Histories dealt in stretches that start where the stream starts afresh, so that no task holds a token's history.

What a row owes to the rows before it ends where a segment starts, but where that is depends on the rows before. So a token with
many rows is cut into blocks by its order; a gate, which knows only what rows are held against, reads a few columns of all blocks
side by side, each from what the last rows of the block before leave behind; and the blocks' ends are put in order, one row for each.
A block whose start was guessed wrong is read again from the right one, until all starts are the ends of the blocks before: then
they are those of one pass in order. What a block ends with from a start is kept, so that a wrong guess spoils no block after it; and
as rows that are rejected one and all leave a block's end as its start, blocks after a wrong one are read from its start too, twice
as many each time. A stretch is what lies between the first fresh rows of two blocks, or a block without accepted rows; its first
row carries the gate's state before it.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.operators.batches import plain
from bookloom.tables import cut, dealt_to, tasks

#: A row's stretch, and on a stretch's first row, unless it is its token's: struct(state, idx, segment).
STRETCH, RESUME = "stretch", "resume"
#: Rows of a block, and of its end from which the next block's start is guessed.
ROWS, TAIL = 8_192, 64
#: Orders up to here are exact as doubles.
EXACT = 9e15
#: How often blocks with wrong starts are read again side by side, besides once for each doubling of the blocks after them.
ROUNDS = 3
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


class Gate:
    """What decides where a stream starts afresh. core: what rows are held against; pending: whether the next row accepted starts a segment; idx, segment: rows accepted and starts so far; gap_clock: when the last gap was."""

    core: Any = None
    pending = False
    idx = segment = 0
    gap_clock: float | None = None

    def takes(self, *values) -> bool:
        """Reads a row; whether it is accepted and starts a segment."""
        raise NotImplementedError

    @property
    def place(self) -> tuple:
        return self.core, self.idx, self.segment, self.gap_clock

    @place.setter
    def place(self, value: tuple) -> None:
        self.core, self.idx, self.segment, self.gap_clock = value


def moved(place: tuple, guessed: tuple, real: tuple) -> tuple:
    """A place reached from a guessed start, which has no gap_clock, as reached from the real one."""
    core, idx, segment, clock = place
    return core, idx - guessed[1] + real[1], segment - guessed[2] + real[2], real[3] if clock is None else clock


def stretched(df: DataFrame, inputs: list[str | Column], gate: Callable[[], Gate], order: str = "seq", where: str = "true", counted: bool = False) -> tuple[DataFrame, int | None]:
    """df with STRETCH and RESUME, and how many tasks to deal it to (None: as it comes). Tokens of up to ROWS rows, and all where the order is no number, are one stretch each. where: which rows are wanted; it is asked of the written table, so that its columns are computed once. counted: tell a number of tasks where no token has more rows, too."""
    whole = df.where(where).withColumns({STRETCH: F.lit(0).cast("long"), RESUME: F.lit(None).cast("struct<state: binary, idx: bigint, segment: bigint>")})
    if dict(df.dtypes)[order] not in NUMBERS:
        return whole, None
    at = F.col(order).cast("double")
    sizes = df.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    large = (F.col("n") > ROWS) & (F.col("high") > F.col("low")) & (F.col("high") < EXACT) & (F.col("low") > -EXACT)
    # A token here has over ROWS rows, so these are few.
    found = sizes.agg(F.sum("n").alias("rows"), F.collect_list(F.when(large, F.struct(F.col("token").alias("__token"), F.col("low").alias("__low"), F.expr(f"(high - low + 1) / ceil(n / {ROWS})").alias("__width")))).alias("large"))
    rows, known = found.first()
    if not known:
        return whole, dealt_to(df.sparkSession, rows or 0) if counted else None
    spark = df.sparkSession
    df = cut(df, "unsequenced").where(where)
    block = F.floor((at - F.col("__low")) / F.col("__width"))
    large = F.broadcast(spark.createDataFrame(known, "__token string, __low double, __width double"))
    # The remainder of a division would be rounded otherwise than its floor: a block's first row could be taken for one of its last.
    part = (at - F.col("__low")) / F.col("__width")
    narrow = df.join(large, F.col("token").eqNullSafe(F.col("__token"))).select("token", F.coalesce(block, F.lit(0)).alias("block"), F.col(order).alias("at"), (part - F.floor(part) >= 1 - TAIL / ROWS).alias("last"), *((F.col(c) if isinstance(c, str) else c).alias(f"__{i}") for i, c in enumerate(inputs)))
    count = tasks(df)

    def read(rows: DataFrame, starts: dict, in_turn: bool = False) -> dict:
        """(token, block) -> where the gate is at its end, the order and the place before its first fresh row, where it started, and the order of its first row. in_turn: a token's blocks one after the other, in one task."""
        def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, g, fresh, first, out = None, gate(), None, None, []
            start = g.place
            for b in batches:
                for token, block, at, _, *values in zip(*map(plain, b.columns), strict=True):
                    if (token, block) != key:
                        if key is not None:
                            out.append((*key, pickle.dumps((g.place, fresh, start, first))))
                        if not in_turn or key is None or key[0] != token:
                            g = gate()
                        key, fresh, first = (token, block), None, at
                        if key in starts:
                            g.place = starts[key]
                        start = g.place
                    if fresh is not None:
                        g.takes(*values)
                        continue
                    before = g.place
                    if g.takes(*values):
                        fresh = at, before
            if key is not None:
                out.append((*key, pickle.dumps((g.place, fresh, start, first))))
            tokens, blocks, ends = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(blocks, pa.int64()), pa.array(ends, pa.binary())], ["token", "block", "end"])

        dealt = rows.repartition(count, *(["token"] if in_turn else ["token", "block"])).sortWithinPartitions("token", "block", "at")
        return {(r.token, r.block): pickle.loads(r.end) for r in dealt.mapInArrow(feed, "token string, block bigint, end binary").collect()}

    fresh = gate().place
    tails = read(narrow.where("last"), {})
    starts = {(t, b + 1): (*end[0][:3], None) for (t, b), end in tails.items()}
    # For each block, what was read from each core it was started from; the first is the guess.
    known = {k: {repr(end[2][0]): end} for k, end in read(narrow, starts).items()}
    keys = sorted(known, key=lambda k: (k[0] or "", k[1]))
    for rounds in itertools.count():
        real, ends, wrong, last = {}, {}, [], None
        for i, k in enumerate(keys):
            real[k] = moved(ends[last][0], ends[last][2], real[last]) if last is not None and last[0] == k[0] else fresh
            core = repr(real[k][0])
            if core not in known[k]:
                wrong.append((i, core))
            ends[k] = known[k].get(core) or next(iter(known[k].values()))
            last = k
        if not wrong:
            break
        if rounds == ROUNDS + len(keys).bit_length():
            # Where the ends of many blocks in a row are neither their starts nor guessed: a pass of a few columns in order.
            for k, end in read(narrow, {}, in_turn=True).items():
                known[k][repr(end[2][0])] = end
            continue
        starts = {keys[i]: (*real[keys[i]][:3], None) for i, _ in wrong}
        for i, core in wrong:
            for k in keys[i + 1 : i + 2**rounds]:
                if k[0] == keys[i][0] and core not in known[k]:
                    starts.setdefault(k, starts[keys[i]])
        again = F.broadcast(spark.createDataFrame(list(starts), "__t string, __b bigint"))
        for k, end in read(narrow.join(again, F.col("token").eqNullSafe(F.col("__t")) & (F.col("block") == F.col("__b"))).drop("__t", "__b"), starts).items():
            known[k][repr(end[2][0])] = end
    rows, home, last, g = [], 0, None, gate()
    for k in keys:
        home = home if last is not None and last[0] == k[0] else 0
        last, (end, found, start, first) = k, ends[k]
        g.place = real[k]
        if found is None and first is not None and (g.pending or end == start):
            # None of its rows is accepted. Rows after it go on with it if what they are accepted by starts afresh, else, as it changed nothing, with what was before it.
            rows.append((*k, float(first), home, k[1] + 1, (pickle.dumps(real[k]), real[k][1], real[k][2])))
            home = k[1] + 1 if g.pending else home
            continue
        if found is None or moved(found[1], start, real[k])[1] == 0:
            rows.append((*k, None, home, home, None))
            continue
        at_, place = found[0], moved(found[1], start, real[k])
        rows.append((*k, float(at_), home, k[1] + 1, (pickle.dumps(place), place[1], place[2])))
        home = k[1] + 1
    told = spark.createDataFrame(rows, "__t string, __b bigint, __at double, __before bigint, __then bigint, __resume struct<state: binary, idx: bigint, segment: bigint>")
    cols = df.columns
    df = df.join(large, F.col("token").eqNullSafe(F.col("__token")), "left").withColumn("__block", F.when(F.col("__width").isNotNull(), F.coalesce(block, F.lit(0))))
    df = df.join(F.broadcast(told), F.col("token").eqNullSafe(F.col("__t")) & (F.col("__block") == F.col("__b")), "left")
    stretch = F.coalesce(F.when(F.col("__at").isNull() | (at < F.col("__at")) | at.isNull(), F.col("__before")).otherwise(F.col("__then")), F.lit(0))
    return df.select(*cols, stretch.cast("long").alias(STRETCH), F.when(at == F.col("__at"), F.col("__resume")).alias(RESUME)), count
