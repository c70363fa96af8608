"""An order book derived from the events table by integer arithmetic, so that any engine derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.operators.scan import running
from bookloom.tables import tasks

# Fixed values: (v's factor, event_id's factor, modulus) of each level's quantity.
BID_QUANTITIES = ((31, 17, 1500), (13, 29, 1200), (7, 11, 1000), (3, 5, 800), (1, 1, 600))
ASK_QUANTITIES = ((37, 19, 1500), (17, 23, 1200), (5, 13, 1000), (11, 7, 800), (2, 1, 600))
TOKENS = 4


def derived_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw snapshots (see schema.RAW) plus seq and clock_ms, one per event. Places and running sums are two-level, so no task holds a token's history."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    count = tasks(e)
    e = e.select("event_id", "event_type", (F.col("user_id") % TOKENS).alias("tok"), F.rint(F.col("value") * 100).cast("long").alias("v"))
    e = running(e, "tok", ["event_id"], {"seq": F.lit(1), "moved": F.expr("CASE v % 4 WHEN 0 THEN -1 WHEN 3 THEN 1 ELSE 0 END"), "volume": (F.col("v") % 5) * 80}, count)
    e = e.withColumn("bid", F.lit(80000) + 5 * F.col("moved"))
    ticks = F.when((F.col("event_type") == "error") & (F.col("v") % 50 == 0), -1).when(F.col("v") % 20 == 7, 3).otherwise(1)
    e = e.withColumn("ask", F.col("bid") + 5 * ticks)
    ladder = lambda best, step, spec: F.array(*(level(F.col(best) + step * i, 100 + (F.col("v") * a + F.col("event_id") * b) % m) for i, (a, b, m) in enumerate(spec)))
    e = e.withColumn("bids", ladder("bid", -5, BID_QUANTITIES)).withColumn("asks", ladder("ask", 5, ASK_QUANTITIES))
    total = lambda side: 6.0 * F.aggregate(side, F.lit(0).cast("long"), lambda a, x: a + x["quantity"])
    ltp = F.when(F.col("event_type").isin("click", "view"), F.col("ask")).otherwise(F.col("bid")) / 100.0
    ts = F.lit(1753500000000) + 200 * F.col("seq") + (F.col("event_id") * 37) % 90 + 4000 * F.floor(F.col("seq") / 211)
    return e.select(
        F.col("tok").cast("string").alias("token"), F.concat(F.lit("SYM"), F.col("tok")).alias("symbol"), F.lit(1).alias("exchange_type"), ts.alias("exchange_timestamp_ms"), F.col("seq").alias("sequence_number"),
        ltp.alias("last_traded_price"), F.lit(1).cast("long").alias("last_traded_quantity"), ltp.alias("average_traded_price"), F.col("volume").alias("volume_traded_today"),
        total("bids").alias("total_buy_quantity"), total("asks").alias("total_sell_quantity"), F.lit(800.0).alias("open_price"), F.lit(801.0).alias("high_price"), F.lit(799.0).alias("low_price"), F.lit(800.0).alias("close_price"),
        "bids", "asks", "seq", ts.alias("clock_ms"),
    )


def level(paise, quantity):
    return F.struct(paise.cast("long").alias("price_paise"), (paise / 100.0).alias("price"), quantity.cast("long").alias("quantity"), (1 + F.floor(quantity / 150)).cast("long").alias("orders"))


def _sql_quantity(spec) -> str:
    return ", ".join(f"100 + (v * {a} + event_id * {b}) % {m}" for a, b, m in spec)


#: The same book in DuckDB as flat columns and lists: token, seq, ts, bid, ask (paise), bq, aq (quantities by level), volume, ltp, total_buy, total_sell.
BOOK_SQL = f"""
e0 AS (SELECT event_id, event_type, user_id % {TOKENS} AS tok, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events),
e1 AS (SELECT *, row_number() OVER o AS seq, 80000 + 5 * CAST(sum(CASE v % 4 WHEN 0 THEN -1 WHEN 3 THEN 1 ELSE 0 END) OVER o AS BIGINT) AS bid, CAST(sum((v % 5) * 80) OVER o AS BIGINT) AS volume
       FROM e0 WINDOW o AS (PARTITION BY tok ORDER BY event_id)),
e2 AS (SELECT *, bid + 5 * CASE WHEN event_type = 'error' AND v % 50 = 0 THEN -1 WHEN v % 20 = 7 THEN 3 ELSE 1 END AS ask,
         [{_sql_quantity(BID_QUANTITIES)}] AS bq, [{_sql_quantity(ASK_QUANTITIES)}] AS aq FROM e1),
book AS (SELECT CAST(tok AS VARCHAR) AS token, seq, 1753500000000 + 200 * seq + (event_id * 37) % 90 + 4000 * CAST(floor(seq / 211) AS BIGINT) AS ts, bid, ask, bq, aq, volume,
         (CASE WHEN event_type IN ('click', 'view') THEN ask ELSE bid END) / 100.0::DOUBLE AS ltp, 6.0::DOUBLE * list_sum(bq) AS total_buy, 6.0::DOUBLE * list_sum(aq) AS total_sell FROM e2)
"""
