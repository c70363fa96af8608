"""Deterministic market scenarios as DataFrames: rising, falling, noisy and random books.

The first two have no randomness. The others draw from a hash of seed, scenario and row, so rows can
be made in any order on any number of tasks and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.config import Composite, Confidence, Engine, Features, Quality, Regime, StateMachine, Threshold

SCENARIOS = ("UPWARD", "DOWNWARD", "NOISE", "RANDOM")
# The size of an order at the touch and how it grows with depth; the noisy scenario's cycles, and quantities by depth.
ORDER_SIZE, ORDER_GROWTH = 150.0, 25.0
STEPS, SPREADS, PROFILE = (4, -7, 6, -5, 7, -6, 3, -2), (1, 3, 2, 4, 1, 4, 2, 3), (1.0, 0.82, 0.67, 0.55, 0.45)
LEAST_SCALE, QUANTITY, TRADE, START, TICK, FIRST_MS, STEP_MS, SEED = 0.12, 1200, 120, 80000, 5, 1_753_500_000_000, 200, 20260726

#: Short windows and quick confirmations, under which 600 rows trade.
AUDIT = Engine(
    quality=Quality(warmup_snapshots=25, min_relative_depth=0.2),
    confidence=Confidence(liquidity_window=60, volatility_window=60, stability_window=20),
    regime=Regime(window=40, min_samples=20, min_dwell=2, confirm=2),
    threshold=Threshold(reference_window=60, base=0.22, min_entry=0.15),
    composite=Composite(min_features=3, min_confidence=0.05, smoothing_half_life_ms=300.0),
    state_machine=StateMachine(entry_confirmations=1, min_watch_confidence=0.05, min_entry_confidence=0.10, exit_confidence=0.02, watch_timeout_ms=30_000.0, max_hold_ms=120_000.0, cooldown_ms=200.0),
    features=Features(dispersion_window=40, momentum_warmup=4, persistence_window=15, persistence_min_samples=5),
)


def unit(*parts) -> Column:
    """A number in [0, 1) from a hash of the seed, the scenario, the row and what it is for."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "token", "seq", *map(F.lit, parts)), 11) / float(1 << 53)


def scenario_rows(spark: SparkSession, count: int, scenarios: tuple[str, ...] = SCENARIOS) -> DataFrame:
    """Raw snapshots (see schema.RAW) of each scenario under its name as token, with seq and clock_ms."""
    rows = spark.range(1, count + 1).select(F.col("id").alias("seq"), F.explode(F.array(*map(F.lit, scenarios))).alias("token"))
    at = ((F.col("seq") - 1) % len(STEPS)).cast("int")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    noisy, random = F.col("token") == "NOISE", F.col("token") == "RANDOM"
    rows = rows.withColumn("step", F.when(F.col("token") == "UPWARD", 1).when(F.col("token") == "DOWNWARD", -1).when(noisy, pick(STEPS, at)).otherwise(pick((-2, -1, -1, 0, 0, 1, 1, 2), F.floor(unit("step") * 8).cast("int"))))
    drawn = F.greatest(F.lit(-0.9), F.least(F.lit(0.9), 0.22 * F.col("step") + (unit("pressure") * 1.16 - 0.58)))
    rows = rows.withColumn("pressure", F.when(noisy, F.when(F.col("step") > 0, 0.88).otherwise(-0.88)).when(random, drawn).otherwise(0.78 * F.col("step")))
    rows = rows.withColumn("ticks", F.when(noisy, pick(SPREADS, at)).when(random & (unit("wide") >= 0.78), pick((2, 3, 4), F.floor(unit("spread") * 3).cast("int"))).otherwise(1))
    rows = rows.withColumn("traded", F.when(noisy, TRADE + ((F.col("seq") - 1) % 5) * 17).when(random, F.floor(TRADE / 3 + unit("traded") * (2 * TRADE - TRADE / 3))).otherwise(TRADE).cast("long"))
    moved = F.when((F.col("seq") > 1) | noisy | random, F.col("step")).otherwise(0)
    run = W.partitionBy("token").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("bid", F.greatest(F.lit(START) + TICK * F.sum(moved).over(run), F.lit(TICK * 6))).withColumn("volume", 100_000 + F.sum("traded").over(run)).withColumn("ask", F.col("bid") + TICK * F.col("ticks"))

    def ladder(best: str, step: int, pressure: Column) -> Column:
        scale = F.greatest(F.lit(LEAST_SCALE), 1 + pressure)
        jitter = lambda i: F.when(noisy | random, 0.92 + 0.16 * unit(best, i)).otherwise(1.0)

        def level(i: int, share: float) -> Column:
            quantity, paise = F.greatest(F.lit(1.0), F.rint(QUANTITY * share * scale * jitter(i))), F.col(best) + step * i
            orders = F.greatest(F.lit(1.0), F.rint(quantity / (ORDER_SIZE + ORDER_GROWTH * i)))
            return F.struct(paise.cast("long").alias("price_paise"), (paise / 100.0).alias("price"), quantity.cast("long").alias("quantity"), orders.cast("long").alias("orders"))

        return F.array(*(level(i, share) for i, share in enumerate(PROFILE)))

    rows = rows.withColumn("bids", ladder("bid", -TICK, F.col("pressure"))).withColumn("asks", ladder("ask", TICK, -F.col("pressure")))
    rows = rows.withColumn("last", F.when(F.col("pressure") >= 0, F.col("ask")).otherwise(F.col("bid")))
    last = F.col("last") / 100.0
    high, low = F.greatest(F.lit(START + TICK), F.max("last").over(run)) / 100.0, F.least(F.lit(START), F.min("last").over(run)) / 100.0
    total = lambda side: 6.0 * F.aggregate(side, F.lit(0).cast("long"), lambda a, x: a + x["quantity"])
    ts = (FIRST_MS + STEP_MS * F.col("seq")).cast("long")
    return rows.select(
        "token", F.col("token").alias("symbol"), F.lit(1).alias("exchange_type"), ts.alias("exchange_timestamp_ms"), F.col("seq").alias("sequence_number"), last.alias("last_traded_price"), F.col("traded").alias("last_traded_quantity"),
        ((F.col("bid") + F.col("ask")) / 200.0).alias("average_traded_price"), F.col("volume").alias("volume_traded_today"), total("bids").alias("total_buy_quantity"), total("asks").alias("total_sell_quantity"),
        F.lit(START / 100).alias("open_price"), high.alias("high_price"), low.alias("low_price"), F.lit(START / 100).alias("close_price"), "bids", "asks", "seq", ts.cast("double").alias("clock_ms"),
    )
