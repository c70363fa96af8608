"""A second book derived from the events table by integer arithmetic, in which trading happens.

Tokens are groups of users, so their number grows with the table. Each token's rows go through PHASES of LENGTH rows in a
cycle that starts at another place for each token: rising under bids, holding, a drop under asks, falling, asks that turn to
bids, a slower rise, a restless balance, and bids
in a book whose best bid turns thin (even tokens) or whose spread turns wide (odd ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.operators.scan import running
from bookloom.sources.derived import level

USERS, PHASES, LENGTH = 5, 8, 24
# Fixed values: (quantity of a balanced level, v's factor, event_id's factor, modulus) by level.
QUANTITIES = ((600, 31, 17, 150), (450, 13, 29, 120), (340, 7, 11, 100), (250, 3, 5, 80), (190, 1, 1, 60))

# One text for both engines: expressions over seq, tok, v and event_id.
_PHASE = f"CAST(floor((seq - 1) / {LENGTH}) + tok AS BIGINT) % {PHASES}"
_STEP = "CASE phase WHEN 0 THEN 1 WHEN 2 THEN CASE WHEN j = 0 THEN -9 ELSE 0 END WHEN 3 THEN -1 WHEN 5 THEN 1 - j % 2 WHEN 6 THEN v % 3 - 1 ELSE 0 END"
_PRESSURE = "CASE WHEN phase IN (0, 1, 5, 7) THEN 1 WHEN phase IN (2, 3) THEN -1 WHEN phase = 4 THEN CASE WHEN j < 12 THEN -1 ELSE 1 END ELSE CASE WHEN v % 2 = 0 THEN 1 ELSE -1 END * (v % 3 - 1) END"
_SPREAD = "CASE WHEN phase = 7 AND tok % 2 = 1 AND j >= 10 THEN 6 WHEN phase = 6 AND v % 5 = 0 THEN 2 ELSE 1 END"
_THIN = "phase = 7 AND tok % 2 = 0 AND j >= 10"
_TS = "1753500000000 + 200 * seq + (event_id * 37) % 90 + 4000 * CAST(floor(seq / 251) AS BIGINT)"


def _quantity(side: int, i: int) -> str:
    base, a, b, m = QUANTITIES[i]
    full = f"{base} * (2 + {side} * pressure) + (v * {a} + event_id * {b + (side < 0)}) % {m}"
    return f"CASE WHEN {_THIN} THEN 45 ELSE {full} END" if i == 0 and side > 0 else full


def trading_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw snapshots (see schema.RAW) plus seq and clock_ms, one per event. Places and running sums are two-level, so no task holds a token's history."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.floor(F.col("user_id") / USERS).alias("tok"), F.rint(F.col("value") * 100).cast("long").alias("v"))
    e = running(e, "tok", ["event_id"], {"seq": F.lit(1)})
    e = e.withColumns({"phase": F.expr(_PHASE), "j": F.expr(f"(seq - 1) % {LENGTH}")})
    e = e.withColumns({"step": F.expr(_STEP), "pressure": F.expr(_PRESSURE), "traded": F.expr("80 + (v % 5) * 20")})
    e = running(e, "tok", ["event_id"], {"moved": F.col("step"), "volume": F.col("traded")})
    e = e.withColumns({"bid": 80000 + 5 * F.col("moved"), "ask": F.expr(f"80000 + 5 * moved + 5 * ({_SPREAD})")})
    ladder = lambda best, side: F.array(*(level(F.col(best) - side * 5 * i, F.expr(_quantity(side, i))) for i in range(len(QUANTITIES))))
    e = e.withColumns({"bids": ladder("bid", 1), "asks": ladder("ask", -1), "ts": F.expr(_TS)})
    total = lambda side: 6.0 * F.aggregate(side, F.lit(0).cast("long"), lambda a, x: a + x["quantity"])
    ltp = F.expr("CASE WHEN pressure >= 0 THEN ask ELSE bid END") / 100.0
    return e.select(
        F.col("tok").cast("string").alias("token"), F.concat(F.lit("GRP"), F.col("tok")).alias("symbol"), F.lit(1).alias("exchange_type"), F.col("ts").alias("exchange_timestamp_ms"), F.col("seq").alias("sequence_number"),
        ltp.alias("last_traded_price"), F.lit(1).cast("long").alias("last_traded_quantity"), ltp.alias("average_traded_price"), F.col("volume").alias("volume_traded_today"),
        total("bids").alias("total_buy_quantity"), total("asks").alias("total_sell_quantity"), F.lit(800.0).alias("open_price"), F.lit(801.0).alias("high_price"), F.lit(799.0).alias("low_price"), F.lit(800.0).alias("close_price"),
        "bids", "asks", "seq", F.col("ts").cast("double").alias("clock_ms"),
    )


def _list(side: int) -> str:
    return "[" + ", ".join(_quantity(side, i) for i in range(len(QUANTITIES))) + "]"


#: The same book in DuckDB, with the columns of derived.BOOK_SQL.
TRADING_SQL = f"""
e0 AS (SELECT event_id, CAST(floor(user_id / {USERS}) AS BIGINT) AS tok, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events),
e1 AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY event_id) AS seq FROM e0),
e2 AS (SELECT *, {_PHASE} AS phase, (seq - 1) % {LENGTH} AS j FROM e1),
e3 AS (SELECT *, {_STEP} AS step, {_PRESSURE} AS pressure FROM e2),
e4 AS (SELECT *, 80000 + 5 * CAST(sum(step) OVER o AS BIGINT) AS bid, CAST(sum(80 + (v % 5) * 20) OVER o AS BIGINT) AS volume FROM e3 WINDOW o AS (PARTITION BY tok ORDER BY event_id)),
e5 AS (SELECT *, bid + 5 * ({_SPREAD}) AS ask, {_list(1)} AS bq, {_list(-1)} AS aq FROM e4),
book AS (SELECT CAST(tok AS VARCHAR) AS token, seq, {_TS} AS ts, bid, ask, bq, aq, volume, (CASE WHEN pressure >= 0 THEN ask ELSE bid END) / 100.0::DOUBLE AS ltp, 6.0::DOUBLE * list_sum(bq) AS total_buy, 6.0::DOUBLE * list_sum(aq) AS total_sell FROM e5)
"""
