"""Row-local operators on snapshots: structural validation, derived prices, ladder arithmetic; and the
native sequencing of clean streams by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.config import Engine
from bookloom.functions.scalar import clamp, is_tick_aligned, linear_scale, safe_div
from bookloom.operators.stretches import RESUME, STRETCH, Gate, stretched


#: Levels of a ladder on each side; a longer one is malformed.
LEVELS = 5

# Ladder arithmetic is SQL text written out level by level, so that it is compiled. HotSpot leaves methods of over
# 8000 bytes uncompiled, and whole-stage code puts a projection into one method: a projection of much
# arithmetic therefore holds a lambda (see `leading`), which makes Spark compile each of its expressions apart.


def at(side: str, i: int, field: str) -> str:
    return f"get({side}, {i}).{field}"


def instruments(raw: DataFrame, cfg: Engine) -> DataFrame:
    """Adds tick and lot: each instrument's tick size and quantity from its settings, else the engine's. The settings are a small table by construction and are broadcast."""
    tick, lot = F.lit(float(cfg.tick_size)), F.lit(int(cfg.quantity)).cast("long")
    if all((s.tick_size, s.quantity) == (cfg.tick_size, cfg.quantity) for s in cfg.symbols):
        return raw.withColumns({"tick": tick, "lot": lot})
    own = raw.sparkSession.createDataFrame([(s.token, float(s.tick_size), int(s.quantity)) for s in cfg.symbols], "__of string, __tick double, __lot bigint")
    raw = raw.join(F.broadcast(own), F.col("token") == F.col("__of"), "left")
    return raw.withColumns({"tick": F.coalesce("__tick", tick), "lot": F.coalesce("__lot", lot)}).drop("__of", "__tick", "__lot")


def level_faults(side: str, descending: bool) -> Column:
    """The first fault of a ladder in level order, or null."""
    worse = ">=" if descending else "<="
    fault = f"CASE WHEN x.quantity < 0 THEN 'NEGATIVE_QUANTITY' WHEN x.orders < 0 THEN 'NEGATIVE_ORDERS' WHEN x.price_paise <= 0 AND x.quantity > 0 THEN 'INVALID_PRICE' WHEN i > 0 AND x.price_paise {worse} get({side}, i - 1).price_paise THEN 'UNSORTED_DEPTH' END"
    return F.expr(f"get(filter(transform({side}, (x, i) -> {fault}), x -> x IS NOT NULL), 0)")


def structural(raw: DataFrame, cfg: Engine) -> DataFrame:
    """Adds tick, lot, mid, spread, spread_ticks and structural_reason: the first check that a snapshot fails on its own, or null."""
    v, tick = cfg.validation, F.col("tick")
    bid, ask = F.get("bids", 0), F.get("asks", 0)
    raw = instruments(raw, cfg).withColumns({"mid": (bid["price"] + ask["price"]) / 2, "spread": ask["price"] - bid["price"], "spread_ticks": (ask["price"] - bid["price"]) / tick})
    empty = lambda side: F.coalesce(F.size(side), F.lit(0)) <= 0
    touch = F.when(empty("bids") | empty("asks"), "MISSING_L1").when((F.size("bids") > LEVELS) | (F.size("asks") > LEVELS), "MALFORMED_PAYLOAD").when(bid["quantity"] == 0, "ZERO_BID").when(ask["quantity"] == 0, "ZERO_ASK")
    prices = F.when((bid["price"] < v.min_price) | (ask["price"] < v.min_price), "INVALID_PRICE")
    if v.require_tick_alignment:
        prices = prices.when(~is_tick_aligned(bid["price"], tick) | ~is_tick_aligned(ask["price"], tick), "TICK_MISALIGNED")
    prices = prices.when(ask["price_paise"] < bid["price_paise"], "CROSSED_BOOK")
    if not v.allow_locked_book:
        prices = prices.when(ask["price_paise"] == bid["price_paise"], "LOCKED_BOOK")
    if v.require_ltp:
        prices = prices.when(F.col("last_traded_price") <= 0, "INVALID_LTP")
    prices = prices.when(F.col("spread_ticks") > v.max_spread_ticks, "SPREAD_TOO_WIDE")
    if "gap_notice" in raw.columns:
        touch = F.coalesce(F.when(F.col("gap_notice"), "GAP_NOTICE"), touch)
    return raw.withColumn("structural_reason", F.coalesce(touch, level_faults("bids", True), level_faults("asks", False), prices))


def level_at(side: str, paise) -> Column:
    """The level of a ladder at a price in paise, or null."""
    return F.get(F.filter(side, lambda x: x["price_paise"] == paise), 0)


def depth(side: str, k: int) -> Column:
    return F.expr(" + ".join(f"coalesce({at(side, i, 'quantity')}, 0)" for i in range(k)))


def leading(side: str, good: str) -> str:
    """How many levels x from the top are good."""
    return f"aggregate({side}, 0, (n, x) -> if(n >= 0 AND {good}, n + 1, if(n < 0, n, -1 - n)), n -> if(n < 0, -1 - n, n))"


def usable_levels(side: str, min_orders: int = 0) -> Column:
    """How many levels from the top hold quantity, a price and enough orders."""
    return F.expr(leading(side, "x.quantity > 0 AND x.price_paise > 0" + (f" AND x.orders >= {min_orders}" if min_orders else "")))


def weighted_mass(side: str, first: int, count: int, cfg: Engine) -> Column:
    """Quantity discounted exponentially by distance from the mid in ticks, down to the first empty level."""
    mass = "0D"
    for i in reversed(range(first - 1, min(LEVELS, first - 1 + count))):
        quantity, price = at(side, i, "quantity"), at(side, i, "price")
        mass = f"CASE WHEN {quantity} > 0 AND {at(side, i, 'price_paise')} > 0 THEN {quantity} * exp(-(abs({price} - mid) / tick) / {float(cfg.features.obi_decay_ticks)}D) + {mass} ELSE 0D END"
    return F.expr(mass)


def ols_sums(side: str, good: str, logs: str, levels: int) -> Column:
    """struct(n, x, y, xx, xy): sums over the good levels of distance x from the best price in ticks and y = ln(quantity + 1). good: how many there are, logs: the logarithms' columns."""
    use = range(min(LEVELS, levels))
    d = [f"(abs({at(side, i, 'price')} - {at(side, 0, 'price')}) / tick)" for i in use]
    total = lambda values: " + ".join(f"CASE WHEN {good} > {i} THEN {v} ELSE 0D END" for i, v in enumerate(values))
    x, y, xx, xy = total(d), total([f"{logs}{i}" for i in use]), total([f"{v} * {v}" for v in d]), total([f"{v} * {logs}{i}" for i, v in enumerate(d)])
    return F.expr(f"named_struct('n', CAST(least({good}, {len(use)}) AS DOUBLE), 'x', {x}, 'y', {y}, 'xx', {xx}, 'xy', {xy})")


def slope_of(sums: str) -> str:
    """The least-squares slope; null under three levels."""
    bottom = f"({sums}.n * {sums}.xx - {sums}.x * {sums}.x)"
    return f"CASE WHEN {sums}.n >= 3 AND {bottom} > 0 THEN ({sums}.n * {sums}.xy - {sums}.x * {sums}.y) / nullif({bottom}, 0D) END"


def depth_walk(side: str, quantity) -> Column:
    """What a market order of this quantity gets: struct(price, filled, levels)."""
    quantity = (quantity if isinstance(quantity, Column) else F.lit(quantity)).cast("long")
    start = F.struct(quantity.alias("left"), F.lit(0.0).alias("paid"), F.lit(0).alias("levels"), F.lit(True).alias("on"))

    def step(a, x):
        on = a["on"] & (a["left"] > 0) & (x["quantity"] > 0)
        take = F.when(on, F.least(x["quantity"], a["left"])).otherwise(F.lit(0).cast("long"))
        return F.struct((a["left"] - take).alias("left"), (a["paid"] + take * x["price"]).alias("paid"), (a["levels"] + on.cast("int")).alias("levels"), on.alias("on"))

    def done(a):
        filled = quantity - a["left"]
        price = F.when(filled > 0, a["paid"] / F.when(filled > 0, filled)).otherwise(F.get(side, 0)["price"])
        return F.struct(price.alias("price"), filled.alias("filled"), a["levels"].alias("levels"))

    return F.aggregate(side, start, step, done)


def local_features(df: DataFrame, cfg: Engine) -> DataFrame:
    """Adds what depends on one snapshot alone: spread value, microprice tilt, weighted imbalance, depth slope, depth and usable levels."""
    f, names, sides = cfg.features, df.columns, ("bids", "asks")
    (b, a), (bq, aq) = ([at(s, 0, field) for s in sides] for field in ("price", "quantity"))
    rest = f.obi_deep_levels - f.obi_primary_levels
    # What later columns name several times comes first, so that it is computed once.
    first = {f"__near_{s}": weighted_mass(s, 1, f.obi_primary_levels, cfg) for s in sides} | {f"__deep_{s}": weighted_mass(s, f.obi_primary_levels + 1, rest, cfg) for s in sides}
    first |= {f"__good_{s}": usable_levels(s) for s in sides} | {f"__log_{s}_{i}": F.expr(f"ln({at(s, i, 'quantity')} + 1D)") for s in sides for i in range(LEVELS)}
    first["spread_value"] = linear_scale(-F.col("spread_ticks"), -f.spread_wide_ticks, -f.spread_tight_ticks)
    first["tilt"] = F.expr(f"CASE WHEN {bq} + {aq} > 0 AND spread > 0 THEN ({b} * {aq} + {a} * {bq}) / nullif({bq} + {aq}, 0) - mid END")
    balance = lambda x, y: f"CASE WHEN {x} + {y} > 0 THEN ({x} - {y}) / nullif({x} + {y}, 0D) END"

    def decay(s: str) -> str:
        (p0, q0, c0), (p1, q1, c1) = ([at(s, i, x) for x in ("price", "quantity", "price_paise")] for i in range(2))
        return f"CASE WHEN {q0} > 0 AND {q1} > 0 AND {c1} > 0 AND {c1} <> {c0} THEN ln(({q1} + 1D) / ({q0} + 1D)) / nullif(abs({p1} - {p0}) / tick, 0D) END"

    buy, sell = "total_buy_quantity", "total_sell_quantity"
    second = {
        "tilt_value": "if(tilt IS NULL, NULL, greatest(-1D, least(1D, tilt / nullif(spread / 2, 0D))))", "obi": balance("__near_bids", "__near_asks"), "obi_deep": balance("__deep_bids", "__deep_asks"),
        "obi_total": f"CASE WHEN {buy} > 0 AND {sell} > 0 AND greatest({buy}, {sell}) <= {float(f.obi_aggregate_max_ratio)}D * least({buy}, {sell}) THEN {balance(buy, sell)} END", "slope": f"{decay('bids')} - {decay('asks')}",
    }
    orders = cfg.quality.min_orders_per_level
    sums = {f"__sums_{s}": ols_sums(s, f"__good_{s}", f"__log_{s}_", f.obi_deep_levels) for s in sides}
    df = df.withColumns(first).withColumns({k: F.expr(v) for k, v in second.items()} | sums | {"usable": F.least(usable_levels("bids", orders), usable_levels("asks", orders))})
    agreed = lambda other, weight: f"coalesce(1 - {float(weight)}D * (1 - {other} * if(obi < 0, -1, 1)) / 2, 1D)"
    deep = f"tanh(({slope_of('__sums_bids')} - {slope_of('__sums_asks')}) / {float(f.slope_scale)}D)" if f.slope_use_deep_levels else "CAST(NULL AS DOUBLE)"
    df = df.withColumns({
        "obi_local": clamp(F.expr(f"{agreed('obi_deep', f.obi_deep_weight)} * {agreed('obi_total', f.obi_aggregate_weight)}"), 0, 1), "slope_value": F.expr(f"tanh(slope / {float(f.slope_scale)}D)"),
        "slope_deep": F.expr(deep), "depth": (depth("bids", 2) + depth("asks", 2)).cast("double"),
    })
    df = df.withColumn("slope_local", F.expr("coalesce(1 - 0.4D * (1 - slope_deep * sign(slope_value)) / 2, 1D)"))
    return df.select(*names, "spread_value", "tilt", "tilt_value", "obi", "obi_deep", "obi_total", "obi_local", "slope", "slope_value", "slope_deep", "slope_local", "depth", "usable")


class CleanGate(Gate):
    """Where segments start in a stream without rejected rows: at every other one of the gaps in a row."""

    def __init__(self, cfg: Engine):
        v = cfg.validation
        self.limits, self.core = (v.max_snapshot_gap_ms, v.max_price_gap_ticks), (None, False)

    def takes(self, ts, mid, seq, tick) -> bool:
        before, was_gap = self.core
        (p_ts, p_mid, p_seq), (most_ms, most_ticks) = before or (None,) * 3, self.limits
        late = ts is not None and p_ts is not None and ts - p_ts > most_ms
        jump = mid is not None and p_mid is not None and bool(tick) and abs(mid - p_mid) / tick > most_ticks
        gap = not was_gap and (late or jump or bool(seq and p_seq and seq < p_seq))
        self.core = (ts, mid, seq), gap
        self.idx += 1
        self.segment += gap
        return gap


def clean_stretches(df: DataFrame, cfg: Engine) -> tuple[DataFrame, int | None]:
    """Structurally accepted rows in stretches that start where a CleanGate's segments do, and how many tasks they want."""
    return stretched(df, ["exchange_timestamp_ms", "mid", "sequence_number", "tick"], lambda: CleanGate(cfg), where="structural_reason IS NULL")


def clean_sequence(df: DataFrame, cfg: Engine, tasks: int | None = None) -> DataFrame:
    """Sequences structurally accepted rows by window functions: idx, gap, is_first, segment, row (in the segment), dt_ms, delta_volume and prev_* columns.

    Exact where no row is rejected for its time, volume or as a duplicate (see `kernel` for the rest).
    A gap row starts a segment and clears what the next row would be held against, so of raw gaps in a
    row only every other one counts. Windows share one exchange and sort by stretch of a token's history, and one by segment
    (a single one by token where no token has more than a stretch). tasks: as clean_stretches gave it, where df is in stretches.
    """
    v = cfg.validation
    if STRETCH not in df.columns:
        df, tasks = clean_stretches(df, cfg)
    # The touches are taken before the exchange, so that whole ladders pass it only where something behind needs them.
    df = df.where(F.col("structural_reason").isNull()).withColumns({"touch_bid": F.get("bids", 0), "touch_ask": F.get("asks", 0)})
    keys = ["token", STRETCH] if tasks else ["token"]
    df = df.repartition(tasks, *keys) if tasks else df
    token = W.partitionBy(*keys).orderBy("seq")
    run = token.rowsBetween(W.unboundedPreceding, 0)
    past = lambda c: F.lag(c).over(token)
    # What stood before a stretch is on its first row alone.
    stood = lambda c: F.sum(F.coalesce(F.col(RESUME)[c], F.lit(0))).over(run) if tasks else F.lit(0)
    df = df.withColumn("idx", F.row_number().over(token).cast("long") + stood("idx")).withColumn("p_ts", past("exchange_timestamp_ms")).withColumn("p_mid", past("mid")).withColumn("p_seq", past("sequence_number")).withColumn("p_volume", past("volume_traded_today"))
    backwards = (F.col("sequence_number") != 0) & (F.col("p_seq") != 0) & (F.col("sequence_number") < F.col("p_seq"))
    jump = F.abs(F.col("mid") - F.col("p_mid")) / F.col("tick") > v.max_price_gap_ticks
    df = df.withColumn("raw_gap", F.col(RESUME).isNotNull() | F.coalesce((F.col("exchange_timestamp_ms") - F.col("p_ts") > v.max_snapshot_gap_ms) | jump | backwards, F.lit(False)))
    df = df.withColumn("calm", F.sum((~F.col("raw_gap")).cast("int")).over(run))
    df = df.withColumn("gap", F.col("raw_gap") & (F.sum(F.col("raw_gap").cast("int")).over(W.partitionBy(*keys, "calm").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)) % 2 == 1))
    df = df.withColumn("segment", F.sum(F.col("gap").cast("int")).over(run) + stood("segment")).withColumn("is_first", F.col("p_ts").isNull() | F.col("gap") | F.coalesce(F.lag("gap").over(token), F.lit(False)))
    df = df.withColumn("dt_ms", F.when(F.col("is_first"), 0.0).otherwise((F.col("exchange_timestamp_ms") - F.col("p_ts")).cast("double")))
    df = df.withColumn("delta_volume", F.when(F.col("is_first"), F.lit(0).cast("long")).otherwise(F.col("volume_traded_today") - F.col("p_volume")))
    df = df.drop(STRETCH, RESUME, "p_ts", "p_mid", "p_seq", "p_volume", "raw_gap", "calm")
    df = df.repartition(tasks, "token", "segment") if tasks else df
    segment = W.partitionBy("token", "segment").orderBy("seq")
    df = df.withColumn("row", F.row_number().over(segment).cast("long"))
    df = df.withColumn("prev_bid", F.lag("touch_bid").over(segment)).withColumn("prev_ask", F.lag("touch_ask").over(segment))
    return df.drop("touch_bid", "touch_ask")


def survival(prev: str, side: str, tolerance: float) -> Column:
    """1 if the previous best level still holds enough at its price, else 0; null without a previous row."""
    now = F.coalesce(level_at(side, F.col(prev)["price_paise"])["quantity"], F.lit(0))
    return F.when(F.col(prev).isNotNull(), (now >= F.col(prev)["quantity"] * (1 - tolerance)).cast("double"))


def microprice_identity(df: DataFrame) -> DataFrame:
    """The tilt over half the spread next to the plain imbalance of the touch, which it equals."""
    b, a = F.get("bids", 0)["quantity"], F.get("asks", 0)["quantity"]
    return df.withColumn("touch_imbalance", safe_div((b - a).cast("double"), b + a))
