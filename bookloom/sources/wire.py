"""Wire messages and JSON records: parsing with aliases and coercion, and the record form of a snapshot.

Everything is Column expressions; rows that can't be parsed keep their reason in parse_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.schema import LEVEL, RAW

# Key spellings by field, in order of preference.
ALIASES = {
    "token": ("token", "tk", "instrument_token"),
    "exchange_type": ("exchange_type", "exchange", "e"),
    "exchange_timestamp_ms": ("exchange_timestamp", "exchange_feed_time_epoch_millis", "exchange_feed_time", "ft"),
    "sequence_number": ("sequence_number", "seq", "sequence"),
    "last_traded_price": ("last_traded_price", "ltp", "lp"),
    "last_traded_quantity": ("last_traded_quantity", "ltq"),
    "average_traded_price": ("average_traded_price", "avg_traded_price", "ap"),
    "volume_traded_today": ("volume_trade_for_the_day", "volume_traded_today", "volume", "v"),
    "total_buy_quantity": ("total_buy_quantity", "total_buy_quant", "tbq"),
    "total_sell_quantity": ("total_sell_quantity", "total_sell_quant", "tsq"),
    "open_price": ("open_price_of_the_day", "open_price", "open", "o"),
    "high_price": ("high_price_of_the_day", "high_price", "high", "h"),
    "low_price": ("low_price_of_the_day", "low_price", "low", "l"),
    "close_price": ("closed_price", "close_price", "close", "c"),
    "bids": ("best_5_buy_data", "best_five_buy", "bids"),
    "asks": ("best_5_sell_data", "best_five_sell", "asks"),
    "price": ("price", "p"),
    "quantity": ("quantity", "qty", "q"),
    "orders": ("no of orders", "no_of_orders", "orders", "no_of_order"),
}
#: Wire prices per unit of currency by exchange type; 100 for all others.
DIVISORS = {13: 10_000_000}
PRICES = ("last_traded_price", "average_traded_price", "open_price", "high_price", "low_price", "close_price")


def heartbeat(text: str | Column) -> Column:
    """Keep-alive frames: nothing, one of a few words, or anything that isn't an object or list."""
    t = F.col(text) if isinstance(text, str) else text
    word = F.lower(F.trim(F.regexp_replace(F.trim(t), '^"+|"+$', "")))
    return t.isNull() | word.isin("", "ping", "pong", "ok") | ~F.trim(t).rlike(r"^[\{\[]")


def first_present(m: Column, field: str) -> Column:
    """The value of the first key spelling that a map has, even if it is null."""
    out = F.lit(None).cast("string")
    for key in reversed(ALIASES[field]):
        out = F.when(F.map_contains_key(m, key), F.try_element_at(m, F.lit(key))).otherwise(out)
    return out


def as_int(x: Column, default: int = 0) -> Column:
    """'12.7' is 12, whole numbers keep all their digits; true, false and bad text are the default."""
    text = F.trim(x)
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def as_float(x: Column) -> Column:
    return F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0))


def ladder(text: Column, divisor: Column, descending: bool) -> Column:
    """The first five levels in wire order that have a price and a quantity, best first."""
    levels = F.coalesce(F.from_json(text, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))

    def level(m):
        wire = as_int(first_present(m, "price"))
        paise = F.when(divisor == 100, wire).otherwise(F.rint(wire * 100 / divisor).cast("bigint"))
        return F.struct(paise.alias("price_paise"), (wire / divisor).alias("price"), as_int(first_present(m, "quantity")).alias("quantity"), F.greatest(as_int(first_present(m, "orders"), 1), F.lit(1).cast("bigint")).alias("orders"))

    # By the price as sent: in a fine-grained segment a small one may round to no paise.
    good = F.filter(levels, lambda m: (as_int(first_present(m, "price")) > 0) & (as_int(first_present(m, "quantity")) > 0))
    return ranked(F.transform(F.slice(good, 1, 5), level), descending)


def ranked(levels: Column, descending: bool) -> Column:
    s = -1 if descending else 1
    return F.array_sort(levels, lambda a, b: (F.signum((a["price_paise"] - b["price_paise"]).cast("double")) * s).cast("int"))


#: How deep lists may stand in lists.
NESTING = 4


def messages(text: Column) -> Column:
    """The messages of a payload as text: an object is one, a list holds messages or lists of them, NESTING deep at most. What is deeper or no JSON stays as it is."""
    inner = lambda x: F.when(F.ltrim(x).startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.array(x))).otherwise(F.array(x))
    out = F.array(text)
    for _ in range(NESTING):
        out = F.flatten(F.transform(out, inner))
    return out


def parse(df: DataFrame, payload: str) -> DataFrame:
    """Raw snapshots from payloads of text or bytes, one row per message in each (see `messages`); heartbeats, and maps without any token key (control frames), give none. Adds parse_error; bytes that aren't UTF-8 are one."""
    binary = df.schema[payload].dataType.simpleString() == "binary"
    text = F.try_validate_utf8(F.col(payload).cast("string")) if binary else F.col(payload)
    garbled = F.col(payload).isNotNull() & text.isNull() if binary else F.lit(False)
    # What an explosion gives is computed once, and the plan doesn't repeat a payload's own expression below.
    df = df.withColumn("__garbled", garbled).withColumn("__text", F.explode(F.array(F.trim(text)))).where(F.col("__garbled") | ~heartbeat("__text"))
    both = F.transform(messages(F.col("__text")), lambda x: F.struct(x.alias("t"), F.when(F.ltrim(x).startswith("{"), F.from_json(x, "map<string,string>")).alias("m")))
    df = df.withColumn("__p", F.explode_outer(both)).where(F.col("__garbled") | ~heartbeat(F.col("__p.t")))
    m = F.col("__p.m")
    named = [F.map_contains_key(m, k) for k in ALIASES["token"]]
    df = df.where(m.isNull() | named[0] | named[1] | named[2])
    get = {f: first_present(m, f) for f in ALIASES if f not in ("price", "quantity", "orders")}
    kind = as_int(get["exchange_type"], 1).cast("int")
    divisor = F.lit(100)
    for k, d in DIVISORS.items():
        divisor = F.when(kind == k, d).otherwise(divisor)
    df = df.withColumns({"__d": divisor, "exchange_type": kind, "token": F.trim(get["token"]), "symbol": F.trim(get["token"])})
    df = df.withColumns({f: as_float(get[f]) / F.col("__d") for f in PRICES} | {f: as_float(get[f]) for f in ("total_buy_quantity", "total_sell_quantity")} | {f: as_int(get[f]) for f in ("exchange_timestamp_ms", "sequence_number", "last_traded_quantity", "volume_traded_today")})
    df = df.withColumns({"bids": ladder(get["bids"], F.col("__d"), True), "asks": ladder(get["asks"], F.col("__d"), False)})
    error = F.when(F.col("__garbled"), "not UTF-8").when(m.isNull(), F.when(F.ltrim(F.col("__p.t")).startswith("["), "not JSON, or nested too deep").otherwise("not JSON")).when(F.col("token").isNull() | (F.col("token") == ""), "no token").when((F.size("bids") == 0) & (F.size("asks") == 0), "no depth")
    return df.withColumn("parse_error", error).drop("__p", "__d", "__text", "__garbled", payload)


def to_record() -> Column:
    """A snapshot as one line of JSON: all fields of schema.RAW, levels as price, quantity and orders."""
    short = lambda side: F.transform(side, lambda x: F.struct(x["price"].alias("price"), x["quantity"].alias("quantity"), x["orders"].alias("orders"))).alias(side)
    plain = [c.split(" ")[0] for c in RAW.split(", bids")[0].split(", ")]
    return F.to_json(F.struct(*plain, short("bids"), short("asks")))


def from_record(df: DataFrame, line: str) -> DataFrame:
    """Raw snapshots from lines of JSON: levels without price or quantity go, prices get their paise (halves to even), ladders are sorted. Adds parse_error."""
    short = "array<struct<price: double, quantity: bigint, orders: bigint>>"
    schema = RAW.replace(f"array<{LEVEL}>", short)
    names = [c.split(" ")[0] for c in RAW.split(", bids")[0].split(", ")]
    df = df.withColumn("__r", F.from_json(line, schema))

    def full(side: str, descending: bool) -> Column:
        levels = F.filter(F.coalesce(F.col(f"__r.{side}"), F.array().cast(short)), lambda x: (x["price"] > 0) & (x["quantity"] > 0))
        return ranked(F.transform(levels, lambda x: F.struct(F.rint(x["price"] * 100).cast("bigint").alias("price_paise"), x["price"].alias("price"), x["quantity"].alias("quantity"), F.greatest(F.coalesce(x["orders"], F.lit(1)), F.lit(1)).alias("orders"))), descending)

    df = df.select(*(c for c in df.columns if c not in (line, "__r", *names)), *(F.col(f"__r.{n}").alias(n) for n in names), full("bids", True).alias("bids"), full("asks", False).alias("asks"))
    error = F.when(F.coalesce(F.trim("token"), F.lit("")) == "", "no token").when((F.size("bids") == 0) & (F.size("asks") == 0), "no depth")
    return df.withColumn("parse_error", error)


def sample_payloads(book: DataFrame) -> DataFrame:
    """Wire messages that say what a book says, for tests and queries."""
    wire = lambda side: F.transform(side, lambda x: F.create_map(F.lit("price"), x["price_paise"].cast("string"), F.lit("quantity"), x["quantity"].cast("string"), F.lit("no of orders"), x["orders"].cast("string"))).alias(f"best_5_{'buy' if side == 'bids' else 'sell'}_data")
    return book.select(F.to_json(F.struct("token", "exchange_type", F.col("exchange_timestamp_ms").alias("exchange_timestamp"), "sequence_number", F.rint(F.col("last_traded_price") * 100).cast("long").alias("ltp"), F.col("volume_traded_today").alias("volume_trade_for_the_day"), "total_buy_quantity", "total_sell_quantity", wire("bids"), wire("asks"))).alias("payload"))
