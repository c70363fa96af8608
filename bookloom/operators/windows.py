"""Rolling statistics over a token's segment: by window functions, which use one partitioning and order, so that Spark plans one exchange, and by one pass of numpy over rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.config import Engine
from bookloom.functions.scalar import apart, clamp
from bookloom.operators.batches import numbers
from bookloom.operators.book import survival


def frame(size: int, past: bool = False) -> W:
    """The last `size` rows of the segment, with the current one or strictly before it."""
    w = W.partitionBy("token", "segment").orderBy("seq")
    return w.rowsBetween(-size, -1) if past else w.rowsBetween(-(size - 1), 0)


def rolling_mean(x, size: int, past: bool = False) -> Column:
    return F.avg(x).over(frame(size, past))


def rolling_variance(x, size: int, past: bool = False) -> Column:
    """Unbiased, 0 under two samples."""
    return F.coalesce(F.greatest(F.var_samp(x).over(frame(size, past)), F.lit(0.0)), F.lit(0.0))


def rolling_sd(x, size: int, past: bool = False) -> Column:
    return F.sqrt(rolling_variance(x, size, past))


def samples(x, size: int, past: bool = False) -> Column:
    return F.count(x).over(frame(size, past))


def position_of(x: str, size: int) -> Column:
    """Where x stands between the rolling minimum and maximum, 0.5 when they agree."""
    low, high = F.min(x).over(frame(size)), F.max(x).over(frame(size))
    return F.when(high > low, clamp((F.col(x) - low) / F.when(high > low, high - low), 0, 1)).otherwise(0.5)


def age(x: str, n: int) -> Column:
    """The value n rows back, null before that."""
    return F.lag(x, n).over(W.partitionBy("token", "segment").orderBy("seq"))


def evicted(x: str, capacity: int) -> Column:
    return age(x, capacity)


def fill_ratio(x: str, capacity: int) -> Column:
    return samples(x, capacity) / float(capacity)


def mid_in_ticks() -> Column:
    """The mid in ticks, from whole paise where the tick is whole paise: halves of ticks are exact, so sums of moves don't depend on their order."""
    paise = F.rint(F.col("tick") * 100)
    exact = (F.get("bids", 0)["price_paise"] + F.get("asks", 0)["price_paise"]) / (2 * paise)
    return F.when((paise >= 1) & (F.abs(F.col("tick") * 100 - paise) < 1e-9), exact).otherwise(F.col("mid") / F.col("tick"))


def sampled(df: DataFrame, cfg: Engine) -> DataFrame:
    """Adds what the shared statistics are made of, but for what a row owes to the one before it."""
    df = df.withColumn("mid_ticks", mid_in_ticks())
    tick_paise = F.greatest(F.lit(1.0), F.rint(F.col("tick") * 100))
    still = lambda prev, side: F.abs(F.get(side, 0)["price_paise"] - F.coalesce(F.col(prev)["price_paise"], F.lit(0))) <= tick_paise
    df = df.withColumn("touch_still", F.when(~F.col("is_first"), (still("prev_bid", "bids") & still("prev_ask", "asks")).cast("double")))
    df = df.withColumn("bid_kept", survival("prev_bid", "bids", cfg.features.persistence_tolerance)).withColumn("ask_kept", survival("prev_ask", "asks", cfg.features.persistence_tolerance))
    return df.withColumn("traded", F.when(~F.col("is_first"), F.greatest(F.col("delta_volume"), F.lit(0)).cast("double")))


def told(df: DataFrame, cfg: Engine, of: Callable[..., Column], columns: list[str | Column], **more: Column) -> DataFrame:
    """These columns and the shared statistics. of(what, column, size, past=False): a column's n (values that aren't null), mean, sd, sum, range or first over a frame."""
    c, t, r, f = cfg.confidence, cfg.threshold, cfg.regime, cfg.features
    path = of("sum", "mid_path", r.window)
    ready = (of("n", "mid_ticks", r.window) >= 3) & (of("n", "mid_path", r.window) >= 2) & (path > 0)
    reference = F.expm1(of("mean", "depth_log", c.liquidity_window))
    enough = (of("n", "depth_log", c.liquidity_window) >= 8) & (reference > 0)
    touch = F.when(of("n", "touch_still", c.stability_window) >= 4, of("mean", "touch_still", c.stability_window)).otherwise(0.5)
    kept = of("mean", "bid_kept", f.persistence_window) - of("mean", "ask_kept", f.persistence_window)
    return df.select(
        *columns,
        of("sd", "mid_move", c.volatility_window).alias("mid_volatility"), (of("n", "mid_move", c.volatility_window) >= 8).alias("mid_ready"),
        of("mean", "spread_ticks", t.reference_window).alias("spread_mean"), of("sd", "spread_ticks", t.reference_window).alias("spread_sd"), (of("n", "spread_ticks", t.reference_window) >= 8).alias("spread_ready"),
        of("range", "spread_ticks", c.stability_window).alias("spread_range"),
        F.when(enough, F.col("depth") / F.when(enough, reference)).otherwise(1.0).alias("relative_depth"), (of("n", "depth_log", c.liquidity_window) >= 8).alias("depth_ready"),
        touch.alias("touch_stability"), of("mean", "traded", c.liquidity_window).alias("mean_traded"),
        F.when(of("n", "obi", t.reference_window, True) >= 2, of("sd", "obi", t.reference_window, True)).otherwise(0.0).alias("obi_sd"),
        F.when(ready, F.least(F.abs(F.col("mid_ticks") - of("first", "mid_ticks", r.window)) / F.when(path > 0, path), F.lit(1.0))).otherwise(0.0).alias("efficiency_ratio"),
        F.least(F.col("row") / float(cfg.quality.warmup_snapshots), F.lit(1.0)).alias("warmup_ratio"),
        F.when(F.col("prev_bid").isNotNull() & (of("n", "bid_kept", f.persistence_window) >= f.persistence_min_samples), clamp(kept, -1, 1)).alias("persistence_value"),
        *(c.alias(n) for n, c in more.items()),
    )


#: Columns that a frame reads and no row has.
DERIVED = {"mid_path": lambda: F.abs("mid_move"), "depth_log": lambda: F.log1p("depth")}


def over_frame(what: str, x: str, size: int, past: bool = False) -> Column:
    """One of `told`'s statistics as a window function."""
    c = DERIVED[x]() if x in DERIVED else F.col(x)
    if what == "sd":
        return rolling_sd(c, size, past)
    if what == "range":
        return F.max(c).over(frame(size, past)) - F.min(c).over(frame(size, past))
    return {"n": F.count, "mean": F.avg, "sum": F.sum, "first": F.first}[what](c).over(frame(size, past))


def shared_statistics(df: DataFrame, cfg: Engine) -> DataFrame:
    """Adds the statistics that several scores read, by window functions, of which Spark leaves out those that nobody reads; needs the columns of a sequenced stream with its local features."""
    order = W.partitionBy("token", "segment").orderBy("seq")
    df = sampled(df, cfg)
    # A move counts only where it isn't a segment's first and isn't held against a row before a gap.
    df = df.withColumn("mid_move", F.when(~F.col("is_first") & (F.col("row") > 1), F.col("mid_ticks") - F.lag("mid_ticks").over(order)))
    return told(df, cfg, over_frame, df.columns)


# Spark reads a whole sliding frame again at every row, a value at a time: frames of hundreds of rows took most of the engine's time.
# `rolled` has numpy read the frames of many rows at once. A statistic is still made from its frame's own rows alone, not from running sums.

#: Rows whose frames are read at once.
CHUNK = 256
#: Columns of whole numbers, whose sums are exact in any order: differences of running sums give their means.
WHOLE = {"touch_still", "traded", "bid_kept", "ask_kept"}


def over_rows(columns: dict[str, tuple[np.ndarray, np.ndarray, set[str]]], place: np.ndarray, size: int, past: bool) -> dict[tuple[str, str], np.ndarray]:
    """Statistics of frames of the last `size` rows (or of those before) for each of the last len(place) ones, whose places in their segments are given (from 0).

    columns: name -> (values, where they aren't null (they are 0 elsewhere), which statistics), all of more than `size` rows more than place has. Nulls where no row of a frame has a value, but for n and sd.
    """
    rows, back, out = len(place), np.arange(size), {}
    at = len(next(iter(columns.values()))[0]) - rows + np.arange(rows) + (not past)
    low = at - np.minimum(place + (not past), size)
    start, read = int(at[0]) - size, []
    for c, (x, known, what) in columns.items():
        sums = lambda y: (t := np.concatenate(([0.0], np.cumsum(y))))[at] - t[low]
        n = sums(known)
        more = {k: np.zeros(rows) for k in what - {"n", "first"}}
        if c in WHOLE and what <= {"n", "mean"}:
            more = {"mean": sums(x) / np.where(n, n, np.nan)}
        elif more:
            view = lambda y: sliding_window_view(y[start : start + rows + size - 1], size)
            read.append((view(x), None if known[start:].all() else view(known.astype(float)), n, more))
        out |= {(c, k): y for k, y in more.items()} | ({(c, "n"): n} if "n" in what else {}) | ({(c, "first"): x[low]} if "first" in what else {})
    for a in range(0, rows if read else 0, CHUNK):
        part = slice(a, a + CHUNK)
        whole = (back >= (size - (at - low)[part])[:, None]).astype(float)
        for values, known, n_, more in read:
            v, m, n = values[part], whole if known is None else whole * known[part], n_[part]
            some = np.where(n, n, np.nan)
            total = np.einsum("ij,ij->i", v, m)
            if "sd" in more:
                d = v - (total / np.maximum(n, 1))[:, None]
                d *= m
                more["sd"][part] = np.sqrt(np.einsum("ij,ij->i", d, d) / np.maximum(n - 1, 1))
            if "range" in more:
                more["range"][part] = np.where(n, np.where(m, v, -np.inf).max(axis=1) - np.where(m, v, np.inf).min(axis=1), np.nan)
            if "mean" in more:
                more["mean"][part] = total / some
            if "sum" in more:
                more["sum"][part] = np.where(n, total, np.nan)
    return out


def frames(cfg: Engine) -> dict[tuple[str, int, bool], set[str]]:
    """(column, size, past) -> which of its statistics `told` and the dispersions read."""
    c, t, r, f = cfg.confidence, cfg.threshold, cfg.regime, cfg.features
    read = [
        ("mid_move", c.volatility_window, False, "n", "sd"), ("spread_ticks", t.reference_window, False, "n", "mean", "sd"), ("spread_ticks", c.stability_window, False, "range"), ("depth_log", c.liquidity_window, False, "n", "mean"),
        ("touch_still", c.stability_window, False, "n", "mean"), ("traded", c.liquidity_window, False, "mean"), ("obi", t.reference_window, True, "n", "sd"), ("mid_ticks", r.window, False, "n", "first"), ("mid_path", r.window, False, "n", "sum"),
        ("bid_kept", f.persistence_window, False, "n", "mean"), ("ask_kept", f.persistence_window, False, "mean"), *((x, f.dispersion_window, True, "n", "sd") for x in ("momentum", "acceleration")),
    ]
    found: dict[tuple[str, int, bool], set[str]] = {}
    for *key, what in ((x, size, past, w) for x, size, past, *all_ in read for w in all_):
        found.setdefault(tuple(key), set()).add(what)
    return found


def rolled(df: DataFrame, cfg: Engine, in_order: bool = False) -> DataFrame:
    """`shared_statistics` and the dispersions of momentum and acceleration (see `scoring.dispersions`), all in one pass over a segment's rows. in_order: a kernel left whole segments in order in each task."""
    name = lambda what, x, size, past=False: f"__{what}_{x}_{size}{'_past' if past else ''}"
    df = sampled(df, cfg)
    columns = [(*k, sorted(v)) for k, v in sorted(frames(cfg).items())]
    given = ["mid_ticks", "is_first", "row", *dict.fromkeys(x for x, *_ in columns if x not in ("mid_ticks", "mid_move", "mid_path"))]
    schema = T.StructType([T.StructField("kept", df.schema), T.StructField("mid_move", T.DoubleType()), *(T.StructField(name(w, x, size, past), T.DoubleType()) for x, size, past, what in columns for w in what)])
    reach = max(size for _, size, _, _ in columns) + 1
    sent = [c for c in given if c in DERIVED]
    packed = (df if in_order else df.repartition("token", "segment").sortWithinPartitions("token", "segment", "seq")).select(F.struct(*df.columns).alias("kept"), *(DERIVED[c]().alias(f"__{c}") for c in sent))

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {x: (np.zeros(reach), np.zeros(reach, bool)) for x, *_ in columns}
        for b in batches:
            if not b.num_rows:
                continue
            read = {c: numbers(b.column(1 + sent.index(c)) if c in sent else b.column(0).field(c)) for c in given}
            place = read["row"][0].astype(int) - 1
            ticks, known = (np.r_[old[-1:], new] for old, new in zip(before["mid_ticks"], read["mid_ticks"], strict=True))
            moved = (read["is_first"][0] == 0) & (place > 0) & known[1:] & known[:-1]
            move = np.where(moved, np.diff(ticks), 0.0)
            read |= {"mid_move": (move, moved), "mid_path": (np.abs(move), moved)}
            before = {x: tuple(np.r_[old, new] for old, new in zip(before[x], read[x], strict=True)) for x in before}
            found = {}
            for size, past in {k[1:3]: None for k in columns}:
                these = {x: (*before[x], set(what)) for x, n, p, what in columns if (n, p) == (size, past)}
                found |= {(x, size, past, w): y for (x, w), y in over_rows(these, place, size, past).items()}
            out = [pa.array(y, mask=np.isnan(y)) for y in (found[x, size, past, w] for x, size, past, what in columns for w in what)]
            before = {x: tuple(a[-reach:] for a in pair) for x, pair in before.items()}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(move, mask=~moved), *out], schema.names)

    of = lambda *key: F.col(name(*key))
    past = lambda x: F.when(of("n", x, cfg.features.dispersion_window, True) >= 8, of("sd", x, cfg.features.dispersion_window, True)).otherwise(0.0)
    out = packed.mapInArrow(feed, schema).select("kept.*", *schema.names[1:])
    return told(out, cfg, of, [*(apart(c) if c == "token" else c for c in df.columns), "mid_move"], momentum_sd=past("momentum"), acceleration_sd=past("acceleration"))
