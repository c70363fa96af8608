"""The registered queries of the order-book engine and, where there is one, the SQL that gives the same rows.

Queries run on the book derived from `events` (see sources.derived) and on `orders` and `lineitem`.
Doubles are rounded to 6 decimals on both sides, as sums are made in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom import tables
from bookloom.config import Engine, Threshold
from bookloom.functions import scalar
from bookloom.operators import book, execution, reports, scoring, windows
from bookloom.plans import engine
from bookloom.sources import connector, jsonl, scenarios, wire
from bookloom.sources.derived import BOOK_SQL, derived_book

CFG = Engine()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEQ_SQL = f"""{BOOK_SQL.strip()},
f AS (SELECT *, bid / 100.0::DOUBLE AS bp, ask / 100.0::DOUBLE AS ap, (bid / 100.0::DOUBLE + ask / 100.0::DOUBLE) / 2 AS mid, (ask - bid) / 100.0::DOUBLE AS spread, (ask / 100.0::DOUBLE - bid / 100.0::DOUBLE) / 0.05::DOUBLE AS spread_ticks FROM book WHERE ask > bid),
g0 AS (SELECT *, row_number() OVER t AS idx, lag(ts) OVER t AS p_ts, lag(volume) OVER t AS p_volume, coalesce(ts - lag(ts) OVER t > 3000, false) AS raw_gap FROM f WINDOW t AS (PARTITION BY token ORDER BY seq)),
g1 AS (SELECT *, sum(CASE WHEN raw_gap THEN 0 ELSE 1 END) OVER (PARTITION BY token ORDER BY seq) AS calm FROM g0),
g2 AS (SELECT *, raw_gap AND (sum(CAST(raw_gap AS INT)) OVER (PARTITION BY token, calm ORDER BY seq)) % 2 = 1 AS gap FROM g1),
g3 AS (SELECT *, CAST(sum(CAST(gap AS INT)) OVER t AS BIGINT) AS segment, p_ts IS NULL OR gap OR coalesce(lag(gap) OVER t, false) AS is_first FROM g2 WINDOW t AS (PARTITION BY token ORDER BY seq)),
s AS (SELECT *, row_number() OVER w AS rn, CASE WHEN is_first THEN 0.0::DOUBLE ELSE CAST(ts - p_ts AS DOUBLE) END AS dt_ms, CASE WHEN is_first THEN 0 ELSE volume - p_volume END AS delta_volume, (bid + ask) / 10.0::DOUBLE AS mid_ticks,
        lag(bid) OVER w AS p_bid, lag(ask) OVER w AS p_ask, lag(bq[1]) OVER w AS p_bq, lag(aq[1]) OVER w AS p_aq, lag(mid) OVER w AS p_mid
      FROM g3 WINDOW w AS (PARTITION BY token, segment ORDER BY seq))"""
_OBI = "(({b}) - ({a})) / (({b}) + ({a}))"
_MASS = "list_sum(list_transform(range({i}, {j}), lambda i: {q}[i] * exp(-abs(({p}) / 100.0::DOUBLE - mid) / 0.05::DOUBLE / 2.5::DOUBLE)))"


def _mass(side: str, i: int, j: int) -> str:
    return _MASS.format(i=i, j=j, q=f"{side[0]}q", p="bid - 5 * (i - 1)" if side == "bid" else "ask + 5 * (i - 1)")


OBI_SQL = _OBI.format(b=_mass("bid", 1, 3), a=_mass("ask", 1, 3))
TILT_SQL = "((bp * aq[1] + ap * bq[1]) / (bq[1] + aq[1]) - mid)"
#: Averages that forget with time, by recursion over each segment.
EMA_SQL = (
    SEQ_SQL
    + f""",
x AS (SELECT token, segment, rn, seq, dt_ms, spread_ticks, mid_ticks, greatest(-1, least(1, {TILT_SQL} / (spread / 2))) AS tilt, {OBI_SQL} AS obi, ltp, mid, spread FROM s),
r AS (SELECT token, segment, rn, seq, dt_ms, spread_ticks AS sf, spread_ticks AS ss, mid_ticks AS tf, mid_ticks AS ts_, tilt AS mi, obi AS mf, obi AS ms, ltp AS lt, NULL::DOUBLE AS lt_before FROM x WHERE rn = 1
      UNION ALL
      SELECT x.token, x.segment, x.rn, x.seq, x.dt_ms, """
    + ", ".join(
        f"r.{v} + (1 - exp(-ln(2) * least(greatest(x.dt_ms, 0), 5000) / {h}::DOUBLE)) * (x.{c} - r.{v})"
        for v, c, h in (("sf", "spread_ticks", 500), ("ss", "spread_ticks", 4000), ("tf", "mid_ticks", 1500), ("ts_", "mid_ticks", 8000), ("mi", "tilt", 200), ("mf", "obi", 600), ("ms", "obi", 3000), ("lt", "ltp", 1200))
    )
    + """, r.lt FROM r JOIN x ON x.token = r.token AND x.segment = r.segment AND x.rn = r.rn + 1)"""
)




def register(name: str, sql: str | None = None, ctes: str = SEQ_SQL):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = (f"WITH RECURSIVE {ctes} " if ctes is EMA_SQL else f"WITH {ctes} " if ctes else "") + sql
        return f

    return keep


def r6(x) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def q6(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.local_features(book.structural(derived_book(spark, sf_dir), CFG), CFG)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows with their own features, which are computed before the exchange by token, in as many tasks as read the book."""
    accepted, count = book.clean_stretches(book.structural(derived_book(spark, sf_dir), CFG), CFG)
    return book.clean_sequence(book.local_features(accepted, CFG), CFG, count)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shared_statistics(clean(spark, sf_dir), CFG)


KEYS = ["token", "seq"]


@register("derived_book", "SELECT token, seq, ts AS exchange_timestamp_ms, bid, ask, volume, bq[1] AS bid_qty, aq[5] AS ask_qty5, total_buy FROM book", BOOK_SQL)
def q_book(spark, sf):
    b = derived_book(spark, sf)
    return b.select(*KEYS, "exchange_timestamp_ms", F.get("bids", 0)["price_paise"].alias("bid"), F.get("asks", 0)["price_paise"].alias("ask"), F.col("volume_traded_today").alias("volume"), F.get("bids", 0)["quantity"].alias("bid_qty"), F.get("asks", 4)["quantity"].alias("ask_qty5"), F.col("total_buy_quantity").alias("total_buy"))


@register("structural_rejects", "SELECT token, seq, CASE WHEN ask < bid THEN 'CROSSED_BOOK' WHEN ask = bid THEN 'LOCKED_BOOK' END AS reject_reason FROM book", BOOK_SQL)
def q_structural(spark, sf):
    return book.structural(derived_book(spark, sf), CFG).select(*KEYS, F.col("structural_reason").alias("reject_reason"))


@register("reject_histogram", "SELECT token, 'CROSSED_BOOK' AS reject_reason, count(*) AS n FROM book WHERE ask < bid GROUP BY token", BOOK_SQL)
def q_histogram(spark, sf):
    return reports.reject_histogram(engine.sequence(derived_book(spark, sf), CFG))


@register("segment_ids", "SELECT token, seq, idx, gap, segment, is_first, rn AS row_in_segment, dt_ms, CAST(delta_volume AS BIGINT) AS delta_volume FROM s")
def q_segments(spark, sf):
    df = engine.sequence(derived_book(spark, sf), CFG).where("reject_reason IS NULL")
    return df.select(*KEYS, "idx", "gap", "segment", "is_first", F.col("row").alias("row_in_segment"), "dt_ms", "delta_volume")


@register("clean_sequence", "SELECT token, seq, idx, gap, segment, is_first, rn AS row_in_segment, dt_ms, CAST(delta_volume AS BIGINT) AS delta_volume FROM s")
def q_clean(spark, sf):
    return clean(spark, sf).select(*KEYS, "idx", "gap", "segment", "is_first", F.col("row").alias("row_in_segment"), "dt_ms", "delta_volume")


@register("duplicate_filter", "SELECT * FROM (SELECT user_id AS k, event_id AS seq, event_type AS x, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR x <> before", "")
def q_duplicates(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.col("event_type").alias("x"))
    return reports.without_repeats(d, "k", "seq", ["x"])


@register("mid_spread", f"SELECT token, seq, {q6('mid', 'mid')}, {q6('spread', 'spread')}, {q6('spread_ticks', 'spread_ticks')} FROM f")
def q_mid(spark, sf):
    return book.structural(derived_book(spark, sf), CFG).where("structural_reason IS NULL").select(*KEYS, r6("mid").alias("mid"), r6("spread").alias("spread"), r6("spread_ticks").alias("spread_ticks"))


@register("depth_sum_topk_levels", "SELECT token, seq, CAST(list_sum(bq[1:2]) AS BIGINT) AS bid2, CAST(list_sum(aq[1:4]) AS BIGINT) AS ask4, 5 AS usable FROM book", BOOK_SQL)
def q_depth(spark, sf):
    return derived_book(spark, sf).select(*KEYS, book.depth("bids", 2).alias("bid2"), book.depth("asks", 4).alias("ask4"), book.usable_levels("bids", 1).alias("usable"))


@register("level_at_prev_best", "SELECT token, seq, CASE WHEN p_bid IS NOT NULL AND p_bid <= bid AND (bid - p_bid) // 5 < 5 THEN bq[1 + (bid - p_bid) // 5] END AS quantity FROM s")
def q_level(spark, sf):
    return clean(spark, sf).select(*KEYS, book.level_at("bids", F.col("prev_bid")["price_paise"])["quantity"].alias("quantity"))


_WALK = "SELECT *, least(aq[1], 1500) AS t1, least(aq[2], greatest(0, 1500 - aq[1])) AS t2, least(aq[3], greatest(0, 1500 - aq[1] - aq[2])) AS t3, least(aq[4], greatest(0, 1500 - aq[1] - aq[2] - aq[3])) AS t4, least(aq[5], greatest(0, 1500 - aq[1] - aq[2] - aq[3] - aq[4])) AS t5 FROM book"


@register("vwap_depth_walk", f"SELECT token, seq, {q6('(t1 * ask + t2 * (ask + 5) + t3 * (ask + 10) + t4 * (ask + 15) + t5 * (ask + 20)) / 100.0::DOUBLE / (t1 + t2 + t3 + t4 + t5)', 'price')}, CAST(t1 + t2 + t3 + t4 + t5 AS BIGINT) AS filled, CAST((t1 > 0)::INT + (t2 > 0)::INT + (t3 > 0)::INT + (t4 > 0)::INT + (t5 > 0)::INT AS INTEGER) AS levels FROM ({_WALK})", BOOK_SQL)
def q_walk(spark, sf):
    walked = derived_book(spark, sf).withColumn("w", book.depth_walk("asks", 1500))
    return walked.select(*KEYS, r6("w.price").alias("price"), "w.filled", "w.levels")


@register("tick_rounding", "SELECT o_orderkey, round_even(round_even(o_totalprice / 0.05::DOUBLE, 0) * 0.05::DOUBLE, 6) AS on_grid, abs(o_totalprice / 0.05::DOUBLE - round_even(o_totalprice / 0.05::DOUBLE, 0)) <= 1e-6 AS aligned FROM orders", "")
def q_ticks(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", scalar.round_to_tick("o_totalprice", 0.05).alias("on_grid"), scalar.is_tick_aligned("o_totalprice", 0.05).alias("aligned"))


_N = "OVER (PARTITION BY token, segment ORDER BY seq ROWS BETWEEN {a} PRECEDING AND {b})"


def over(size: int, past: bool = False) -> str:
    return _N.format(a=size if past else size - 1, b="1 PRECEDING" if past else "CURRENT ROW")


@register("rolling_mean", f"SELECT token, seq, {q6(f'avg(spread_ticks) {over(20)}', 'mean')}, count(spread_ticks) {over(20)} >= 8 AS ready FROM s")
def q_mean(spark, sf):
    return clean(spark, sf).select(*KEYS, r6(windows.rolling_mean("spread_ticks", 20)).alias("mean"), (windows.samples("spread_ticks", 20) >= 8).alias("ready"))


@register("rolling_var", f"SELECT token, seq, {q6(f'coalesce(var_samp(spread_ticks) {over(20)}, 0)', 'variance')} FROM s")
def q_var(spark, sf):
    return clean(spark, sf).select(*KEYS, r6(windows.rolling_variance("spread_ticks", 20)).alias("variance"))


@register("rolling_minmax_range_position", f"SELECT token, seq, {q6('hi - lo', 'range')}, {q6('CASE WHEN hi > lo THEN (mid_ticks - lo) / (hi - lo) ELSE 0.5 END', 'position')} FROM (SELECT token, seq, mid_ticks, max(mid_ticks) {over(60)} AS hi, min(mid_ticks) {over(60)} AS lo FROM s)")
def q_minmax(spark, sf):
    df = clean(spark, sf).withColumn("mid_ticks", windows.mid_in_ticks())
    span = F.max("mid_ticks").over(windows.frame(60)) - F.min("mid_ticks").over(windows.frame(60))
    return df.select(*KEYS, r6(span).alias("range"), r6(windows.position_of("mid_ticks", 60)).alias("position"))


@register("ring_age_lag", f"SELECT token, seq, CAST(lag(volume, 3) OVER w AS BIGINT) AS age3, CAST(lag(volume, 40) OVER w AS BIGINT) AS evicted, CAST(first_value(volume) {over(40)} AS BIGINT) AS oldest, {q6(f'count(volume) {over(40)} / 40.0', 'fill')} FROM s WINDOW w AS (PARTITION BY token, segment ORDER BY seq)")
def q_ring(spark, sf):
    v = "volume_traded_today"
    return clean(spark, sf).select(*KEYS, windows.age(v, 3).alias("age3"), windows.evicted(v, 40).alias("evicted"), F.first(v).over(windows.frame(40)).alias("oldest"), r6(windows.fill_ratio(v, 40)).alias("fill"))


@register("welford_session", f"SELECT token, segment, count(*) AS n, {q6('avg(mid)', 'mean')}, {q6('coalesce(stddev_samp(mid), 0)', 'sd')} FROM s GROUP BY token, segment")
def q_welford(spark, sf):
    return clean(spark, sf).groupBy("token", "segment").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("mid")).alias("mean"), r6(F.coalesce(F.stddev_samp("mid"), F.lit(0.0))).alias("sd"))


_MOVE = "SELECT *, CASE WHEN NOT is_first AND rn > 1 THEN mid_ticks - lag(mid_ticks) OVER (PARTITION BY token, segment ORDER BY seq) END AS mv FROM s"


@register("mid_volatility", f"SELECT token, seq, {q6(f'sqrt(coalesce(var_samp(mv) {over(240)}, 0))', 'volatility')}, count(mv) {over(240)} >= 8 AS ready FROM ({_MOVE})")
def q_volatility(spark, sf):
    return stats(spark, sf).select(*KEYS, r6("mid_volatility").alias("volatility"), F.col("mid_ready").alias("ready"))


_STILL = "SELECT *, CASE WHEN NOT is_first THEN CASE WHEN abs(bid - coalesce(p_bid, 0)) <= 5 AND abs(ask - coalesce(p_ask, 0)) <= 5 THEN 1.0 ELSE 0.0 END END AS still FROM s"


@register("touch_stability", f"SELECT token, seq, {q6(f'CASE WHEN count(still) {over(60)} >= 4 THEN avg(still) {over(60)} ELSE 0.5 END', 'stability')} FROM ({_STILL})")
def q_stability(spark, sf):
    return stats(spark, sf).select(*KEYS, r6("touch_stability").alias("stability"))


@register("relative_depth_geomean", f"SELECT token, seq, {q6(f'CASE WHEN count(d) {over(240)} >= 8 THEN d / (exp(avg(ln(1 + d)) {over(240)}) - 1) ELSE 1 END', 'relative_depth')} FROM (SELECT *, CAST(bq[1] + bq[2] + aq[1] + aq[2] AS DOUBLE) AS d FROM s)")
def q_relative(spark, sf):
    return stats(spark, sf).select(*KEYS, r6("relative_depth").alias("relative_depth"))


@register("efficiency_ratio", f"SELECT token, seq, {q6('CASE WHEN n >= 3 AND m >= 2 AND path > 0 THEN least(1, abs(mid_ticks - first) / path) ELSE 0 END', 'ratio')} FROM (SELECT *, count(mid_ticks) {over(90)} AS n, count(mv) {over(90)} AS m, sum(abs(mv)) {over(90)} AS path, first_value(mid_ticks) {over(90)} AS first FROM ({_MOVE}))")
def q_efficiency(spark, sf):
    return stats(spark, sf).select(*KEYS, r6("efficiency_ratio").alias("ratio"))


@register("feat_spread", f"SELECT token, seq, {q6('spread_ticks', 'raw')}, {q6('greatest(0, least(1, (6 - spread_ticks) / 5))', 'value')} FROM s")
def q_spread(spark, sf):
    return clean(spark, sf).select(*KEYS, r6("spread_ticks").alias("raw"), r6("spread_value").alias("value"))


@register("microprice_identity", f"SELECT token, seq, abs({TILT_SQL} / (spread / 2) - (bq[1] - aq[1]) / CAST(bq[1] + aq[1] AS DOUBLE)) < 1e-9 AS same, {q6('(bq[1] - aq[1]) / CAST(bq[1] + aq[1] AS DOUBLE)', 'touch_imbalance')} FROM s")
def q_identity(spark, sf):
    df = book.microprice_identity(clean(spark, sf))
    return df.select(*KEYS, (F.abs(F.col("tilt_value") - F.col("touch_imbalance")) < 1e-9).alias("same"), r6("touch_imbalance").alias("touch_imbalance"))


_DEEP = _OBI.format(b=_mass("bid", 3, 6), a=_mass("ask", 3, 6))


@register("feat_weighted_obi", f"SELECT token, seq, {q6('obi', 'value')}, {q6('(1 - 0.35 * (1 - deep * sg) / 2) * (CASE WHEN greatest(total_buy, total_sell) <= 12 * least(total_buy, total_sell) THEN 1 - 0.2 * (1 - (total_buy - total_sell) / (total_buy + total_sell) * sg) / 2 ELSE 1 END)', 'local_confidence')} FROM (SELECT *, CASE WHEN obi < 0 THEN -1 ELSE 1 END AS sg FROM (SELECT *, {OBI_SQL} AS obi, {_DEEP} AS deep FROM s))")
def q_obi(spark, sf):
    return clean(spark, sf).select(*KEYS, r6("obi").alias("value"), r6("obi_local").alias("local_confidence"))


_OLS = "(5 * list_sum(list_transform(range(1, 6), lambda i: (i - 1) * ln({q}[i] + 1.0::DOUBLE))) - 10 * list_sum(list_transform(range(1, 6), lambda i: ln({q}[i] + 1.0::DOUBLE)))) / 50.0"


@register("feat_depth_slope_ols", f"SELECT token, seq, {q6('slope', 'raw')}, {q6('tanh(slope / 0.9)', 'value')}, {q6('1 - 0.4 * (1 - tanh(deep / 0.9) * sign(slope)) / 2', 'local_confidence')} FROM (SELECT *, ln((bq[2] + 1.0::DOUBLE) / (bq[1] + 1)) / (abs((bid - 5) / 100.0::DOUBLE - bp) / 0.05::DOUBLE) - ln((aq[2] + 1.0::DOUBLE) / (aq[1] + 1)) / (abs((ask + 5) / 100.0::DOUBLE - ap) / 0.05::DOUBLE) AS slope, {_OLS.format(q='bq')} - {_OLS.format(q='aq')} AS deep FROM s)")
def q_slope(spark, sf):
    return clean(spark, sf).select(*KEYS, r6("slope").alias("raw"), r6("slope_value").alias("value"), r6("slope_local").alias("local_confidence"))


_KEPT = "CASE WHEN p_bid IS NOT NULL THEN CASE WHEN coalesce(CASE WHEN p_bid <= bid AND (bid - p_bid) // 5 < 5 THEN bq[1 + (bid - p_bid) // 5] END, 0) >= p_bq * 0.85::DOUBLE THEN 1.0 ELSE 0.0 END END AS kb, CASE WHEN p_ask IS NOT NULL THEN CASE WHEN coalesce(CASE WHEN p_ask >= ask AND (p_ask - ask) // 5 < 5 THEN aq[1 + (p_ask - ask) // 5] END, 0) >= p_aq * 0.85::DOUBLE THEN 1.0 ELSE 0.0 END END AS ka"


@register("feat_queue_persistence", f"SELECT token, seq, CASE WHEN n >= 10 THEN round(CAST(v AS DOUBLE), 6) + 0.0::DOUBLE END AS value FROM (SELECT token, seq, count(kb) {over(40)} AS n, avg(kb) {over(40)} - avg(ka) {over(40)} AS v FROM (SELECT *, {_KEPT} FROM s))")
def q_persistence(spark, sf):
    return stats(spark, sf).select(*KEYS, r6("persistence_value").alias("value"))


def recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.sequence(derived_book(spark, sf_dir), CFG).where("reject_reason IS NULL")


@register("ema_time_aware", f"SELECT token, seq, {q6('greatest(-1, least(1, mi))', 'value')} FROM r", EMA_SQL)
def q_ema(spark, sf):
    return recurrent(spark, sf).select(*KEYS, r6("micro").alias("value"))


@register("ema_pair_trend", f"SELECT token, seq, CASE WHEN rn >= 4 THEN round(tf - ts_, 6) + 0.0::DOUBLE END AS trend FROM r", EMA_SQL)
def q_trend(spark, sf):
    return recurrent(spark, sf).select(*KEYS, r6("trend").alias("trend"))


@register("feat_spread_compression", f"SELECT token, seq, CASE WHEN rn >= 4 THEN round(ss - sf, 6) + 0.0::DOUBLE END AS raw, CASE WHEN rn >= 4 THEN round(greatest(0, least(1, 0.5 * (1 + tanh((ss - sf) / 0.5)))), 6) + 0.0::DOUBLE END AS value FROM r", EMA_SQL)
def q_compression(spark, sf):
    value = scalar.clamp(0.5 * (1 + F.tanh(F.col("compression") / 0.5)), 0, 1)
    return recurrent(spark, sf).select(*KEYS, r6("compression").alias("raw"), r6(F.when(F.col("compression").isNotNull(), value)).alias("value"))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.feature_values(windows.shared_statistics(engine.accepted(derived_book(spark, sf_dir), CFG)[0], CFG), CFG)


@register("feat_momentum", f"SELECT token, seq, {q6('m', 'raw')}, CASE WHEN rn >= 6 THEN round(tanh(m / (greatest(sd, 0.02) * 2)), 6) + 0.0::DOUBLE END AS value FROM (SELECT *, CASE WHEN count(m) {over(120, True)} >= 8 THEN coalesce(stddev_samp(m) {over(120, True)}, 0) ELSE 0 END AS sd FROM (SELECT *, mf - ms AS m FROM r))", EMA_SQL)
def q_momentum(spark, sf):
    return featured(spark, sf).select(*KEYS, r6("momentum").alias("raw"), r6("feat_momentum").alias("value"))


@register("feat_ltp_confirmation", f"SELECT r.token, r.seq, CASE WHEN r.rn >= 2 THEN round((ltp - lt_before) / 0.05::DOUBLE, 6) + 0.0::DOUBLE END AS raw, CASE WHEN r.rn >= 2 THEN round(greatest(-1, least(1, 0.5 * tanh((ltp - lt_before) / 0.05::DOUBLE / 1.5) + 0.5 * greatest(-1, least(1, (ltp - mid) / (spread * 0.5))))), 6) + 0.0::DOUBLE END AS value FROM r JOIN x ON r.token = x.token AND r.seq = x.seq", EMA_SQL)
def q_ltp(spark, sf):
    return featured(spark, sf).select(*KEYS, r6("ltp_drift").alias("raw"), r6("feat_ltp_confirmation").alias("value"))


@register("feat_microprice", f"SELECT r.token, r.seq, {q6('greatest(-1, least(1, mi))', 'value')} FROM r JOIN x ON r.token = x.token AND r.seq = x.seq", EMA_SQL)
def q_microprice(spark, sf):
    return featured(spark, sf).select(*KEYS, r6("feat_microprice").alias("value"))


ACCEL_SQL = (
    EMA_SQL
    + """,
d0 AS (SELECT token, segment, rn, seq, dt_ms, (mf - ms - lag(mf - ms) OVER (PARTITION BY token, segment ORDER BY rn)) / (greatest(dt_ms, 20) / 1000.0::DOUBLE) AS d FROM r WHERE rn >= 6),
a AS (SELECT token, segment, rn, seq, d AS sm FROM d0 WHERE rn = 7
      UNION ALL
      SELECT d0.token, d0.segment, d0.rn, d0.seq, a.sm + (1 - exp(-ln(2) * least(greatest(d0.dt_ms, 0), 5000) / 500.0::DOUBLE)) * (d0.d - a.sm) FROM a JOIN d0 ON d0.token = a.token AND d0.segment = a.segment AND d0.rn = a.rn + 1)"""
)


@register("feat_acceleration", None)
def q_acceleration(spark, sf):
    return featured(spark, sf).where("acceleration IS NOT NULL").select(*KEYS, r6("acceleration").alias("raw"), r6("feat_acceleration").alias("value"))


ORACLE["feat_acceleration"] = f"WITH RECURSIVE {ACCEL_SQL} SELECT token, seq, {q6('sm', 'raw')}, CASE WHEN rn >= 9 THEN round(tanh(sm / (greatest(CASE WHEN n >= 8 THEN sd ELSE 0 END, 0.05) * 2)), 6) + 0.0::DOUBLE END AS value FROM (SELECT *, count(sm) {over(120, True)} AS n, stddev_samp(sm) {over(120, True)} AS sd FROM a)"


@register("feat_refill")
def q_refill(spark, sf):
    return featured(spark, sf).select(*KEYS, r6("refill").alias("raw"), r6("feat_refill").alias("value"))


@register("symbol_join", "SELECT token, coalesce('NAME' || CASE WHEN token IN ('0', '1', '2') THEN token END, token) AS display, count(*) AS n FROM book GROUP BY ALL", BOOK_SQL)
def q_join(spark, sf):
    names = spark.createDataFrame([(str(i), f"NAME{i}") for i in range(3)], "token string, name string")
    return reports.with_names(derived_book(spark, sf), names).groupBy("token", "display").agg(F.count(F.lit(1)).alias("n"))


@register("unknown_token_anti", "SELECT token, count(*) AS n FROM book WHERE token NOT IN ('0', '1') GROUP BY token", BOOK_SQL)
def q_unknown(spark, sf):
    return reports.unknown_tokens(derived_book(spark, sf), spark.createDataFrame([("0",), ("1",)], "token string"))


@register("counters", "SELECT book.token, count(*) FILTER (ask > bid) AS accepted, count(*) FILTER (ask <= bid) AS rejected, any_value(gaps) AS gaps, any_value(gaps) AS resets FROM book JOIN (SELECT token, CAST(sum(CAST(gap AS INT)) AS BIGINT) AS gaps FROM s GROUP BY token) USING (token) GROUP BY book.token")
def q_counters(spark, sf):
    return reports.counters(engine.sequence(derived_book(spark, sf), CFG))


@register("latest_per_token", "SELECT token, max(seq) AS seq, CAST(arg_max(bid, seq) AS BIGINT) AS bid FROM book GROUP BY token", BOOK_SQL)
def q_latest(spark, sf):
    last = reports.latest_per(derived_book(spark, sf), "token", "seq")
    return last.select("token", "seq", F.get("bids", 0)["price_paise"].alias("bid"))


@register("latency_percentiles_nearest_rank", "SELECT event_type, count(*) AS n, max(CASE WHEN k = n // 2 THEN value END) AS p50, max(CASE WHEN k = least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) THEN value END) AS p90, max(CASE WHEN k = least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) THEN value END) AS p99, max(value) AS most FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type", "")
def q_percentiles(spark, sf):
    return reports.nearest_rank(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"], "value")


@register("book_pressure", f"SELECT token, seq, {q6('obi', 'obi')}, {q6('tilt', 'tilt')}, {q6('spread_ticks', 'spread_ticks')} FROM (SELECT token, seq, spread_ticks, {OBI_SQL} AS obi, {TILT_SQL} AS tilt FROM f) ORDER BY round(abs(obi), 6) DESC, token, seq LIMIT 100")
def q_pressure(spark, sf):
    df = local(spark, sf).where("structural_reason IS NULL")
    top = df.select(*KEYS, r6("obi").alias("obi"), r6("tilt").alias("tilt"), r6("spread_ticks").alias("spread_ticks"), F.round(F.abs("obi"), 6).alias("size"))
    return top.orderBy(F.desc("size"), *KEYS).limit(100).drop("size")


_GRID = "round_even(round_even(({p}) / 0.05::DOUBLE, 0) * 0.05::DOUBLE, 6)"


@register("entry_exit_quotes", f"SELECT token, seq, {q6('greatest(' + _GRID.format(p='ap + mid * 3 / 10000') + ', ap)', 'entry_long')}, {q6('least(' + _GRID.format(p='bp - mid * 3 / 10000') + ', bp)', 'entry_short')}, {q6('least(' + _GRID.format(p='bp - mid / 10000') + ', bp)', 'exit_long')} FROM f")
def q_quotes(spark, sf):
    df = local(spark, sf).where("structural_reason IS NULL").withColumn("feat_ltp_confirmation", F.lit(None).cast("double"))
    return scoring.quotes(df, CFG).select(*KEYS, r6("entry_long").alias("entry_long"), r6("entry_short").alias("entry_short"), r6("exit_long").alias("exit_long"))


_LEGS = "least({t} * 3e-4::DOUBLE, 20)"


@register("round_trip_cost", f"SELECT token, seq, {q6('rupees', 'rupees')}, {q6('rupees * 10000 / ((buy + sell) / 2)', 'bps')} FROM (SELECT *, (br + (buy + sell) * 2.97e-5::DOUBLE + (buy + sell) * 1e-6::DOUBLE) * 1.18::DOUBLE + sell * 2.5e-4::DOUBLE + buy * 3e-5::DOUBLE AS rupees FROM (SELECT *, {_LEGS.format(t='buy')} + {_LEGS.format(t='sell')} AS br FROM (SELECT token, seq, ap * 100 AS buy, bp * 100 AS sell FROM f)))")
def q_cost(spark, sf):
    df = book.structural(derived_book(spark, sf), CFG).where("structural_reason IS NULL")
    cost = execution.round_trip(F.get("asks", 0)["price"], F.get("bids", 0)["price"], F.lit(100), CFG)
    return df.withColumn("c", cost).select(*KEYS, r6("c.rupees").alias("rupees"), r6("c.bps").alias("bps"))


@register("cost_gate", "SELECT token, seq, 12 * 0.05::DOUBLE * 10000 / mid >= (rupees * 10000 / ((buy + sell) / 2) + spread_ticks * 0.05::DOUBLE * 10000 / mid) * 1.5 AS clears FROM (SELECT *, (3e-4::DOUBLE * (buy + sell) + (buy + sell) * 2.97e-5::DOUBLE + (buy + sell) * 1e-6::DOUBLE) * 1.18::DOUBLE + sell * 2.5e-4::DOUBLE + buy * 3e-5::DOUBLE AS rupees FROM (SELECT *, ap * 1 AS buy, bp * 1 AS sell FROM f))")
def q_gate(spark, sf):
    return book.structural(derived_book(spark, sf), CFG).where("structural_reason IS NULL").select(*KEYS, execution.TOUCH.clears(CFG).alias("clears"))


@register("wire_parse_ladder", "SELECT token, seq, CAST(5 AS INTEGER) AS n_bids, CAST(bid AS BIGINT) AS bid, CAST(bq[5] AS BIGINT) AS quantity5, CAST(ask AS BIGINT) AS ask, volume FROM book", BOOK_SQL)
def q_wire(spark, sf):
    parsed = wire.parse(wire.sample_payloads(derived_book(spark, sf)), "payload")
    return parsed.where("parse_error IS NULL").select("token", F.col("sequence_number").alias("seq"), F.size("bids").alias("n_bids"), F.get("bids", 0)["price_paise"].alias("bid"), F.get("bids", 4)["quantity"].alias("quantity5"), F.get("asks", 0)["price_paise"].alias("ask"), F.col("volume_traded_today").alias("volume"))


@register("jsonl_roundtrip", "SELECT token, seq, CAST(ask + 20 AS BIGINT) AS ask5, CAST(1 + floor(aq[5] / 150) AS BIGINT) AS orders5, ltp FROM book", BOOK_SQL)
def q_jsonl(spark, sf):
    back = wire.from_record(derived_book(spark, sf).select("seq", wire.to_record().alias("line")), "line")
    return back.select("token", "seq", F.get("asks", 4)["price_paise"].alias("ask5"), F.get("asks", 4)["orders"].alias("orders5"), F.col("last_traded_price").alias("ltp"))


@register("recorded_stream", "SELECT token, seq, CAST(ask + 20 AS BIGINT) AS ask5, CAST(1 + floor(aq[5] / 150) AS BIGINT) AS orders5, ltp FROM book", BOOK_SQL)
def q_recorded(spark, sf):
    """The book's lines as files, streamed into a sink that records each micro-batch once, and read back."""
    connector.register(spark)
    lines, kept, log = (tables.folder(spark, tag) for tag in ("lines", "recorded", "log"))
    jsonl.write(derived_book(spark, sf), lines)
    rows = spark.readStream.format(connector.NAME).option("path", lines).load().select("value")
    rows.writeStream.format(connector.NAME).option("path", kept).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    back = wire.from_record(spark.read.format(connector.NAME).option("path", kept).load(), "value")
    return back.select("token", F.col("sequence_number").alias("seq"), F.get("asks", 4)["price_paise"].alias("ask5"), F.get("asks", 4)["orders"].alias("orders5"), F.col("last_traded_price").alias("ltp"))


@register("quality_gate")
def q_quality(spark, sf):
    df = scoring.quality(featured(spark, sf), CFG)
    return df.select(*KEYS, F.array_join("blocks", "+").alias("blocks"), "tradable", r6("book_quality").alias("book_quality"), r6("liquidity_score").alias("liquidity_score"))


ORACLE["quality_gate"] = (
    f"WITH {SEQ_SQL}, "
    + f"c AS (SELECT *, max(CASE WHEN gap THEN ts END) OVER (PARTITION BY token ORDER BY seq) AS last_gap, count(d) {over(240)} AS n, CASE WHEN count(d) {over(240)} >= 8 THEN d / (exp(avg(ln(1 + d)) {over(240)}) - 1) ELSE 1 END AS rel FROM (SELECT *, CAST(bq[1] + bq[2] + aq[1] + aq[2] AS DOUBLE) AS d FROM s)), "
    + "e AS (SELECT *, list_filter([CASE WHEN rn < 60 THEN 'WARMUP' END, CASE WHEN spread_ticks > 4 THEN 'SPREAD_TOO_WIDE' END, CASE WHEN n >= 8 AND rel < 0.35 THEN 'LIQUIDITY_BELOW_THRESHOLD' END, CASE WHEN ts - last_gap < 2000 THEN 'FEED_GAP' END], lambda x: x IS NOT NULL) AS b, greatest(0, least(1, (rel - 0.175) / 0.825)) AS liq FROM c) "
    + f"SELECT token, seq, array_to_string(b, '+') AS blocks, len(b) = 0 AS tradable, {q6('greatest(0, least(1, (6 - spread_ticks) / 5)) * liq * least(1, rn / 60.0::DOUBLE)', 'book_quality')}, {q6('liq', 'liquidity_score')} FROM e"
)


@register("feature_confidence")
def q_confidence(spark, sf):
    df = scoring.confidence(scoring.quality(featured(spark, sf), CFG), CFG)
    return df.select(*KEYS, *(r6(c).alias(c) for c in df.columns if c.startswith(("factor_", "base_"))))


@register("composite_score")
def q_composite(spark, sf):
    df = engine.decided(derived_book(spark, sf), CFG, columns=[*KEYS, "regime", "composite_valid", "score", "smoothed", "composite_confidence"])
    return df.select(*KEYS, "regime", "composite_valid", r6("score").alias("score"), r6("smoothed").alias("smoothed"), r6("composite_confidence").alias("confidence"))


@register("regime_hysteresis")
def q_regime(spark, sf):
    df = engine.decided(derived_book(spark, sf), CFG, columns=[*KEYS, "proposed", "regime", "dwell"])
    return df.select(*KEYS, "proposed", "regime", "dwell")


@register("adaptive_threshold")
def q_threshold(spark, sf):
    df = scoring.threshold(stats(spark, sf), CFG)
    return df.select(*KEYS, r6("entry").alias("entry"), r6("watch").alias("watch"), r6("exit").alias("exit"))


def threshold_sql(t: Threshold) -> str:
    return (
        f"WITH {SEQ_SQL}, v AS (SELECT *, {OBI_SQL} AS obi FROM ({_MOVE})), "
        + f"y AS (SELECT v.*, coalesce(stddev_samp(spread_ticks) {over(240)}, 0) AS sd, avg(spread_ticks) {over(240)} AS mean, coalesce(stddev_samp(mv) {over(240)}, 0) AS vol, coalesce(stddev_samp(obi) {over(240, True)}, 0) AS osd, count(mv) {over(240)} >= 8 AND count(spread_ticks) {over(240)} >= 8 AS ready, CASE WHEN count(still) {over(60)} >= 4 THEN avg(still) {over(60)} ELSE 0.5 END AS calm_touch FROM (SELECT *, CASE WHEN NOT is_first THEN CASE WHEN abs(bid - coalesce(p_bid, 0)) <= 5 AND abs(ask - coalesce(p_ask, 0)) <= 5 THEN 1.0 ELSE 0.0 END END AS still FROM v) v), "
        + f"z AS (SELECT *, CASE WHEN ready THEN greatest({t.min_entry}::DOUBLE, least({t.max_entry}::DOUBLE, {t.base}::DOUBLE * (1 + 0.45 * sd / greatest(mean, 1) + 0.4 * vol / greatest(mean, 1) + 0.35 * osd / 0.25 + 0.3 * (1 - calm_touch)))) ELSE {t.max_entry}::DOUBLE END AS e FROM y) "
        + f"SELECT token, seq, {q6('e', 'entry')}, {q6('e * 0.6', 'watch')}, {q6('e * 0.5', 'exit')} FROM z"
    )


ORACLE["adaptive_threshold"] = threshold_sql(CFG.threshold)


def traded(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    """The whole engine over the whole derived book."""
    return engine.run_batch(derived_book(spark, sf), CFG, columns=columns)


@register("full_pipeline")
def q_full(spark, sf):
    df = traded(spark, sf)
    return df.select(*KEYS, "idx", "segment", "regime", "previous_state", "state", "composite_valid", r6("smoothed").alias("smoothed"), r6("composite_confidence").alias("confidence"), r6("entry").alias("entry"), "reason", F.array_join("reasons", "; ").alias("reasons"))


@register("state_machine")
def q_states(spark, sf):
    df = traded(spark, sf, [*KEYS, "previous_state", "state", "reason"])
    return df.select("token", "seq", "previous_state", "state", "reason", "direction", r6("entry_price").alias("entry_price"), r6("exit_price").alias("exit_price"), "opened", "closed")


@register("position_pnl")
def q_pnl(spark, sf):
    df = traded(spark, sf, [*KEYS, "reason"]).where("closed")
    return df.select("token", "seq", "reason", *(r6(f"pnl.{c}").alias(c) for c in ("gross_ticks", "gross_rupees", "cost_rupees", "net_rupees", "net_bps", "holding_ms")))


@register("scenario_audit")
def q_audit(spark, sf):
    """Of generated rows, not of the tables: 600 of each scenario, under settings that let them trade."""
    return reports.scenario_report(engine.run_batch(scenarios.scenario_rows(spark, 600), scenarios.AUDIT))


@register("feature_audit")
def q_feature_audit(spark, sf):
    return reports.feature_report(traded(spark, sf))


@register("invariants")
def q_invariants(spark, sf):
    return reports.invariants(traded(spark, sf))


@register("display_rows", "SELECT token, seq, strftime(make_timestamp((ts + 19800000) * 1000), '%H:%M:%S.%g') AS at FROM book", BOOK_SQL)
def q_display(spark, sf):
    return derived_book(spark, sf).select(*KEYS, scalar.exchange_time("exchange_timestamp_ms").alias("at"))


# Row-local rules that the derived book alone never meets: each row of it is damaged in one way, by its place.

_FAULTS = 16
_FAULT_SQL = "CASE seq % 16 WHEN 1 THEN 'MISSING_L1' WHEN 2 THEN 'MISSING_L1' WHEN 3 THEN 'MALFORMED_PAYLOAD' WHEN 4 THEN 'ZERO_BID' WHEN 5 THEN 'ZERO_ASK' WHEN 6 THEN 'NEGATIVE_QUANTITY' WHEN 7 THEN 'NEGATIVE_ORDERS' WHEN 8 THEN 'INVALID_PRICE' WHEN 9 THEN 'UNSORTED_DEPTH' WHEN 10 THEN 'UNSORTED_DEPTH' WHEN 11 THEN 'INVALID_PRICE' WHEN 12 THEN 'LOCKED_BOOK' WHEN 13 THEN CASE WHEN ask < bid THEN 'CROSSED_BOOK' ELSE 'INVALID_LTP' END WHEN 14 THEN 'SPREAD_TOO_WIDE' WHEN 15 THEN 'CROSSED_BOOK' ELSE CASE WHEN ask < bid THEN 'CROSSED_BOOK' END END"


def damaged(df: DataFrame) -> DataFrame:
    """The derived book with one fault in 15 of 16 rows, for the structural checks."""
    level = lambda side, i, **other: f"named_struct('price_paise', {other.get('p', f'{side}[{i}].price_paise')}, 'price', {other.get('c', f'{side}[{i}].price')}, 'quantity', {other.get('q', f'{side}[{i}].quantity')}, 'orders', {other.get('n', f'{side}[{i}].orders')})"
    swap = lambda side, i, **other: f"concat(slice({side}, 1, {i}), array({level(side, i, **other)}), slice({side}, {i + 2}, 5))"
    shifted = lambda side, by: f"transform({side}, x -> named_struct('price_paise', x.price_paise + {by}, 'price', (x.price_paise + {by}) / 100D, 'quantity', x.quantity, 'orders', x.orders))"
    gap = "(asks[0].price_paise - bids[0].price_paise)"
    bids = {1: "slice(bids, 1, 0)", 4: swap("bids", 0, q="0L"), 6: swap("bids", 2, q="-1L"), 8: swap("bids", 4, p="0L"), 9: "concat(slice(bids, 1, 1), slice(bids, 3, 1), slice(bids, 2, 1))", 11: f"array({level('bids', 0, c='0.001D')})"}
    asks = {2: "slice(asks, 1, 0)", 3: "concat(asks, slice(asks, 5, 1))", 5: swap("asks", 0, q="0L"), 7: swap("asks", 1, n="-1L"), 10: "concat(slice(asks, 1, 2), slice(asks, 2, 1))", 12: shifted("asks", f"(-{gap})"), 14: shifted("asks", f"(150 - {gap})"), 15: shifted("asks", f"(-5 - {gap})")}
    pick = lambda side, cases: F.expr(f"CASE seq % {_FAULTS} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {side} END")
    return df.withColumns({"bids": pick("bids", bids), "asks": pick("asks", asks), "last_traded_price": F.expr(f"CASE WHEN seq % {_FAULTS} = 13 THEN 0D ELSE last_traded_price END")})


@register("structural_faults", f"SELECT token, seq, {_FAULT_SQL} AS reject_reason FROM book", BOOK_SQL)
def q_faults(spark, sf):
    return book.structural(damaged(derived_book(spark, sf)), CFG).select(*KEYS, F.col("structural_reason").alias("reject_reason"))


@register("fault_histogram", f"SELECT token, reject_reason, count(*) AS n FROM (SELECT token, {_FAULT_SQL} AS reject_reason FROM book) WHERE reject_reason IS NOT NULL GROUP BY ALL", BOOK_SQL)
def q_fault_histogram(spark, sf):
    return reports.reject_histogram(book.structural(damaged(derived_book(spark, sf)), CFG).withColumnRenamed("structural_reason", "reject_reason"))


@register("scalar_functions", f"SELECT o_orderkey, {q6('1 - exp(-ln(2) * least(o_orderkey % 7000, 5000) / 600.0::DOUBLE)', 'alpha')}, {q6('tanh((o_totalprice - 150000) / 100000.0::DOUBLE)', 'squashed')}, {q6('tanh((o_totalprice - 150000) / (greatest(o_orderkey % 90000, 20000) * 2.0::DOUBLE))', 'robust')}, {q6('ln((o_custkey + 1.0::DOUBLE) / (o_orderkey + 1.0::DOUBLE))', 'log_ratio')}, {q6('(o_orderkey % 41) * 0.05::DOUBLE', 'price')}, {q6('o_totalprice / 0.05::DOUBLE', 'ticks')}, CASE WHEN o_totalprice > 200000 THEN 1 WHEN o_totalprice < 100000 THEN -1 ELSE 0 END AS sg, {q6('CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_totalprice / (o_custkey % 3) END', 'ratio')}, {q6('3 / 10000.0::DOUBLE * o_totalprice / 0.05::DOUBLE', 'offset_ticks')}, {q6('12 * 0.05::DOUBLE * 10000 / o_totalprice', 'offset_bps')} FROM orders", "")
def q_scalars(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return o.select(
        "o_orderkey", r6(scalar.ema_alpha(key % 7000, 600, 5000)).alias("alpha"), r6(scalar.tanh_scale(price - 150000, 100000)).alias("squashed"), r6(scalar.robust_scale(price - 150000, key % 90000, 20000, 2)).alias("robust"),
        r6(scalar.log_ratio("o_custkey", "o_orderkey")).alias("log_ratio"), r6(scalar.from_ticks(key % 41, 0.05)).alias("price"), r6(scalar.to_ticks("o_totalprice", 0.05)).alias("ticks"), scalar.sign(price - 150000, 50000).alias("sg"),
        r6(scalar.safe_div("o_totalprice", (F.col("o_custkey") % 3).cast("double"))).alias("ratio"), r6(scalar.bps_to_ticks(F.lit(3.0), "o_totalprice", 0.05)).alias("offset_ticks"), r6(scalar.ticks_to_bps(F.lit(12), "o_totalprice", 0.05)).alias("offset_bps"),
    )


_BAR = "SELECT o_orderkey, (o_orderkey % 257 - 128) / 100.0::DOUBLE AS x, (o_custkey % 101) / 100.0::DOUBLE AS t FROM orders"


@register("score_bar", f"SELECT o_orderkey, array_to_string(list_transform(range(-12, 13), lambda i: CASE WHEN (CASE WHEN x >= 0 THEN i ELSE -i END) BETWEEN 1 AND f THEN '█' WHEN abs(i) = m THEN '|' WHEN i = 0 THEN '┃' ELSE '·' END), '') AS bar FROM (SELECT *, round_even(least(abs(x), 1) * 12, 0) AS f, least(12, greatest(1, round_even(t * 12, 0))) AS m FROM ({_BAR}))", "")
def q_bar(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    return o.select("o_orderkey", scalar.score_bar((F.col("o_orderkey") % 257 - 128) / 100.0, (F.col("o_custkey") % 101) / 100.0).alias("bar"))


@register("redacted", "SELECT o_orderkey, 'user=' || o_custkey || ' api_key=*** totp: *** bearer *** rest' AS line FROM orders", "")
def q_redacted(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.select("o_orderkey", scalar.redacted(F.concat(F.lit("user="), "o_custkey", F.lit(" api_key=k"), "o_orderkey", F.lit(" totp: "), "o_custkey", F.lit(" bearer x."), "o_orderstatus", F.lit(" rest"))).alias("line"))


@register("average_order_size", f"SELECT token, seq, {q6('bq[1] / (1 + floor(bq[1] / 150))', 'bid_size')}, {q6('aq[3] / (1 + floor(aq[3] / 150))', 'ask_size3')} FROM book", BOOK_SQL)
def q_order_size(spark, sf):
    return derived_book(spark, sf).select(*KEYS, r6(scalar.average_order_size(F.get("bids", 0))).alias("bid_size"), r6(scalar.average_order_size(F.get("asks", 2))).alias("ask_size3"))


@register("spread_dispersion", f"SELECT token, seq, {q6(f'CASE WHEN count(spread_ticks) {over(120, True)} >= 2 THEN stddev_samp(spread_ticks) {over(120, True)} ELSE 0 END', 'dispersion')} FROM s")
def q_dispersion(spark, sf):
    return clean(spark, sf).select(*KEYS, r6(windows.rolling_sd("spread_ticks", 120, True)).alias("dispersion"))


@register("rates", f"SELECT token, count(*) AS rows, {q6('count(*) * 1000.0 / (max(ts) - min(ts))', 'rate')} FROM book GROUP BY token", BOOK_SQL)
def q_rates(spark, sf):
    return reports.rates(derived_book(spark, sf)).select("token", "rows", r6("rate").alias("rate"))


@register("subscriptions", "SELECT exchange_type, array_to_string(list_sort(list(DISTINCT token)), ',') AS tokens FROM (SELECT CAST(n_nationkey AS VARCHAR) AS token, CAST(n_regionkey AS INTEGER) AS exchange_type FROM nation) GROUP BY exchange_type", "")
def q_subscriptions(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("token"), F.col("n_regionkey").cast("int").alias("exchange_type"))
    return reports.subscriptions(n).select("exchange_type", F.array_join("tokens", ",").alias("tokens"))


@register("merged_streams", "SELECT token, seq, ts FROM book", BOOK_SQL)
def q_merged(spark, sf):
    b = derived_book(spark, sf)
    return reports.merged(*(b.where(F.col("token") == t) for t in ("0", "1", "2", "3"))).select(*KEYS, F.col("exchange_timestamp_ms").alias("ts"))


def _scenario_sql(rows: int) -> str:
    """The two scenarios without random numbers."""
    quantity = "CAST(greatest(1, round_even(1200 * [1.0, 0.82, 0.67, 0.55, 0.45][i]::DOUBLE * greatest(0.12::DOUBLE, 1 + {p}), 0)) AS BIGINT)"
    side = lambda p: f"list_transform(range(1, 6), lambda i: {quantity.format(p=p)})"
    orders = lambda q: f"list_transform(range(1, 6), lambda i: CAST(greatest(1, round_even({q}[i] / (150.0::DOUBLE + 25 * (i - 1)), 0)) AS BIGINT))"
    return (
        f"WITH a AS (SELECT token, d, CAST(seq AS BIGINT) AS seq, d * 0.78::DOUBLE AS p, CAST(greatest(30, 80000 + 5 * d * (seq - 1)) AS BIGINT) AS bid FROM range(1, {rows + 1}) t(seq), (VALUES ('UPWARD', 1), ('DOWNWARD', -1)) s(token, d)), "
        f"b AS (SELECT *, bid + 5 AS ask, CASE WHEN d > 0 THEN bid + 5 ELSE bid END AS last, {side('p')} AS bq, {side('-p')} AS aq FROM a), "
        f"c AS (SELECT *, {orders('bq')} AS bn, {orders('aq')} AS an, greatest(80005, max(last) OVER w) / 100.0::DOUBLE AS high, least(80000, min(last) OVER w) / 100.0::DOUBLE AS low FROM b WINDOW w AS (PARTITION BY token ORDER BY seq)) "
        "SELECT token, seq, 1753500000000 + 200 * seq AS ts, bid, ask, last / 100.0::DOUBLE AS last, high, low, CAST(100000 + 120 * seq AS BIGINT) AS volume, array_to_string(bq, ',') AS bq, array_to_string(aq, ',') AS aq, array_to_string(bn, ',') AS bn, array_to_string(an, ',') AS an, 6.0::DOUBLE * list_sum(bq) AS total_buy FROM c"
    )


@register("scenario_rows", _scenario_sql(600), "")
def q_scenarios(spark, sf):
    s = scenarios.scenario_rows(spark, 600, ("UPWARD", "DOWNWARD"))
    joined = lambda side, field: F.array_join(F.transform(side, lambda x: x[field].cast("string")), ",")
    return s.select(
        *KEYS, F.col("exchange_timestamp_ms").alias("ts"), F.get("bids", 0)["price_paise"].alias("bid"), F.get("asks", 0)["price_paise"].alias("ask"), F.col("last_traded_price").alias("last"), F.col("high_price").alias("high"), F.col("low_price").alias("low"),
        F.col("volume_traded_today").alias("volume"), joined("bids", "quantity").alias("bq"), joined("asks", "quantity").alias("aq"), joined("bids", "orders").alias("bn"), joined("asks", "orders").alias("an"), F.col("total_buy_quantity").alias("total_buy"),
    )


@register("replayed_lines", "SELECT token, seq, CASE WHEN ask < bid THEN 'CROSSED_BOOK' END AS reject_reason, round_even((ask - bid) / 100.0::DOUBLE / CASE token WHEN '1' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END, 6) AS spread_ticks, CASE token WHEN '1' THEN 7 ELSE 1 END AS lot FROM book", BOOK_SQL)
def q_replayed(spark, sf):
    """Recorded lines parsed back and sequenced, under settings with two tick sizes."""
    from bookloom.config import Symbol

    cfg = Engine(symbols=(Symbol("0"), Symbol("1", tick_size=0.1, quantity=7), Symbol("2"), Symbol("3")))
    lines = derived_book(spark, sf).select(F.col("seq").alias("arrival"), wire.to_record().alias("line"))
    out = engine.sequence(wire.from_record(lines, "line"), cfg)
    return out.select(*KEYS, "reject_reason", F.bround("spread_ticks", 6).alias("spread_ticks"), F.col("lot").cast("int").alias("lot"))


@register("display_view")
def q_view(spark, sf):
    v = reports.view(traded(spark, sf))
    return v.select(*(F.array_join(c, " / ").alias(c) if c in ("features", "reasons") else F.col(c) for c in v.columns))


@register("decision_digest")
def q_digest(spark, sf):
    return reports.decision_digest(traded(spark, sf))
_SEGMENT = "WINDOW w AS (PARTITION BY token, segment ORDER BY seq)"
_SLOPE = "ln((bq[2] + 1.0::DOUBLE) / (bq[1] + 1)) / (abs((bid - 5) / 100.0::DOUBLE - bp) / 0.05::DOUBLE) - ln((aq[2] + 1.0::DOUBLE) / (aq[1] + 1)) / (abs((ask + 5) / 100.0::DOUBLE - ap) / 0.05::DOUBLE)"
_SENSITIVE = {"microprice": "1", "weighted_obi": "obi_local", "depth_slope": "slope_local", "queue_persistence": "1", "refill": "1", "momentum": "1", "acceleration": "1", "ltp_confirmation": "ltp_local"}
_FROM_ROW = {"microprice": "true", "weighted_obi": "true", "depth_slope": "true", "queue_persistence": "kept >= 10 AND p_bid IS NOT NULL", "refill": "rn >= 2", "momentum": "rn >= 6", "acceleration": "rn >= 9", "ltp_confirmation": "rn >= 2"}


def _confidence_sql() -> str:
    from bookloom.config import FACTORS, SENSITIVITY

    bases = ", ".join(f"CASE WHEN {_FROM_ROW[n]} THEN round(exp({' + '.join(f'{w}::DOUBLE * ln(f_{k})' for w, k in zip(SENSITIVITY[n], FACTORS, strict=True))}) * greatest(0, least(1, {local_})), 6) + 0.0::DOUBLE END AS base_{n}" for n, local_ in _SENSITIVE.items())
    factors = ", ".join(q6(f"f_{k}", f"factor_{k}") for k in FACTORS)
    unit = lambda x: f"greatest(0.02::DOUBLE, least(1, {x}))"
    return f"""WITH RECURSIVE {EMA_SQL},
m AS (SELECT *, CASE WHEN NOT is_first AND rn > 1 THEN mid_ticks - lag(mid_ticks) OVER w END AS mv, CASE WHEN NOT is_first THEN CASE WHEN abs(bid - coalesce(p_bid, 0)) <= 5 AND abs(ask - coalesce(p_ask, 0)) <= 5 THEN 1.0 ELSE 0.0 END END AS still,
        CAST(bq[1] + bq[2] + aq[1] + aq[2] AS DOUBLE) AS d, {OBI_SQL} AS obi, {_DEEP} AS deep, {_SLOPE} AS slope, {_OLS.format(q='bq')} - {_OLS.format(q='aq')} AS deep_slope, {_KEPT}, max(CASE WHEN delta_volume > 0 THEN ts END) OVER w AS traded_at FROM s {_SEGMENT}),
v AS (SELECT m.*, sf, ss, count(mv) {over(240)} AS moves, sqrt(coalesce(var_samp(mv) {over(240)}, 0)) AS vol, avg(spread_ticks) {over(240)} AS spread_mean, CASE WHEN count(d) {over(240)} >= 8 THEN d / (exp(avg(ln(1 + d)) {over(240)}) - 1) ELSE 1 END AS rel,
        CASE WHEN count(still) {over(60)} >= 4 THEN avg(still) {over(60)} ELSE 0.5 END AS touch, count(kb) {over(40)} AS kept, CASE WHEN obi < 0 THEN -1 ELSE 1 END AS sg FROM m JOIN (SELECT token, seq, sf, ss FROM r) q USING (token, seq)),
u AS (SELECT *, greatest(0, least(1, (6 - spread_ticks) / 5)) AS tight, greatest(0, least(1, (rel - 0.175) / 0.825)) AS liquid, least(1, rn / 60.0::DOUBLE) AS warm,
        (1 - 0.35 * (1 - deep * sg) / 2) * (CASE WHEN greatest(total_buy, total_sell) <= 12 * least(total_buy, total_sell) THEN 1 - 0.2 * (1 - (total_buy - total_sell) / (total_buy + total_sell) * sg) / 2 ELSE 1 END) AS obi_local,
        1 - 0.4 * (1 - tanh(deep_slope / 0.9) * sign(slope)) / 2 AS slope_local, CASE WHEN traded_at IS NULL THEN 0.6 WHEN ts - traded_at > 3000 THEN 0.3 ELSE 1 END AS ltp_local FROM v),
g AS (SELECT *, {unit('tight')} AS f_spread, {unit('liquid')} AS f_liquidity, {unit('CASE WHEN moves >= 8 THEN greatest(0, 1 - vol / (greatest(spread_mean, 1) * 2)) ELSE 1 END')} AS f_volatility, {unit('tight * liquid * warm')} AS f_book_quality,
        {unit('touch * (CASE WHEN rn >= 4 THEN 0.75 + 0.25 * greatest(0, least(1, 0.5 * (1 + tanh((ss - sf) / 0.5)))) ELSE 1 END)')} AS f_stability, {unit('warm')} AS f_warmup FROM u)
SELECT token, seq, {factors}, {bases} FROM g"""


ORACLE["feature_confidence"] = _confidence_sql()

#: The regime that each row proposes, and what hysteresis makes of it, by recursion over each segment.
ORACLE["regime_hysteresis"] = f"""WITH RECURSIVE {EMA_SQL},
e AS (SELECT r.token, r.segment, r.rn, r.seq, CASE WHEN r.rn >= 4 THEN tf - ts_ END AS trend, CASE WHEN r.rn < 6 OR abs(mf - ms) <= 1e-12 THEN 0 ELSE sign(mf - ms) END AS push, vol, CASE WHEN n >= 3 AND k >= 2 AND path > 0 THEN least(1, abs(mid_ticks - first) / path) ELSE 0 END AS er
      FROM r JOIN (SELECT token, seq, mid_ticks, sqrt(coalesce(var_samp(mv) {over(240)}, 0)) AS vol, count(mid_ticks) {over(90)} AS n, count(mv) {over(90)} AS k, sum(abs(mv)) {over(90)} AS path, first_value(mid_ticks) {over(90)} AS first FROM ({_MOVE})) USING (token, seq)),
o AS (SELECT *, abs(trend) >= 1 AND push <> 0 AND push = -sign(trend) AS opposed FROM e),
p AS (SELECT *, CASE WHEN rn < 30 OR trend IS NULL THEN 'UNKNOWN' WHEN vol >= 2.5 AND er < 0.45 THEN 'NOISE' WHEN er >= 0.45 AND abs(trend) >= 1 THEN CASE WHEN opposed THEN 'PULLBACK' ELSE 'TREND' END WHEN er >= 0.3 AND opposed THEN 'PULLBACK' WHEN er <= 0.25 AND vol < 2.5 THEN 'RANGE' ELSE 'NOISE' END AS proposed FROM o),
h AS (SELECT token, segment, rn, seq, proposed, 'UNKNOWN' AS held, 1 AS dwell, proposed AS candidate, CASE WHEN proposed = 'UNKNOWN' THEN 0 ELSE 1 END AS times FROM p WHERE rn = 1
      UNION ALL
      SELECT token, segment, rn, seq, proposed, CASE WHEN flips THEN proposed ELSE held END, CASE WHEN flips THEN 0 ELSE dwell + 1 END, CASE WHEN proposed = held THEN candidate ELSE proposed END, CASE WHEN flips THEN 0 ELSE again END
      FROM (SELECT *, again >= 3 AND (held = 'UNKNOWN' OR dwell + 1 >= 8) AS flips FROM (SELECT p.*, h.held, h.dwell, h.candidate, CASE WHEN p.proposed = h.held THEN 0 WHEN h.times > 0 AND p.proposed = h.candidate THEN h.times + 1 ELSE 1 END AS again FROM h JOIN p ON p.token = h.token AND p.segment = h.segment AND p.rn = h.rn + 1)))
SELECT token, seq, proposed, held AS regime, CAST(dwell AS BIGINT) AS dwell FROM h"""


def _refill_sql() -> str:
    """Refill episodes of both sides by recursion over each segment: a drop at the last best price opens one, and what stands there later ends it."""
    held = {"b": "CASE WHEN {p} <= bid AND (bid - {p}) // 5 < 5 THEN bq[1 + (bid - {p}) // 5] END", "a": "CASE WHEN {p} >= ask AND ({p} - ask) // 5 < 5 THEN aq[1 + ({p} - ask) // 5] END"}
    before = {"b": ("p_bid", "p_bq"), "a": ("p_ask", "p_aq")}
    first = ", ".join(f"0.0::DOUBLE AS s{x}, NULL::BIGINT AS e{x}, NULL::BIGINT AS n{x}, NULL::BIGINT AS t{x}" for x in "ba")
    now = ", ".join(f"{held[x].format(p=f'coalesce(e{x}, {before[x][0]})')} AS h{x}" for x in "ba")
    ended = ", ".join(f"CASE WHEN e{x} IS NULL THEN NULL WHEN h{x} IS NULL THEN -0.6::DOUBLE WHEN h{x} >= n{x} * 0.6::DOUBLE THEN least(1, h{x} / greatest(n{x}, 1)) WHEN ts - t{x} > 1500 THEN -0.6::DOUBLE END AS i{x}" for x in "ba")
    opened = ", ".join(f"e{x} IS NULL AND {before[x][1]} > 0 AND {before[x][1]} - coalesce(h{x}, 0) >= {before[x][1]} * 0.35::DOUBLE AND dv >= ({before[x][1]} - coalesce(h{x}, 0)) * 0.5::DOUBLE AS o{x}" for x in "ba")
    kept = lambda x, column, new: f"CASE WHEN o{x} THEN CAST({new} AS BIGINT) WHEN i{x} IS NULL THEN {column}{x} END"
    then = ", ".join(f"CASE WHEN i{x} IS NULL THEN s{x} * k ELSE greatest(-1.5::DOUBLE, least(1.5, s{x} * k + i{x})) END, {kept(x, 'e', before[x][0])}, {kept(x, 'n', before[x][1])}, {kept(x, 't', 'ts')}" for x in "ba")
    state = ", ".join(f"{c}{x}" for x in "ba" for c in "sent")
    return f"""WITH RECURSIVE {SEQ_SQL},
z AS (SELECT token, segment, rn, seq, ts, delta_volume AS dv, exp(-ln(2) * least(greatest(dt_ms, 0), 5000) / 800::DOUBLE) AS k, bid, ask, bq, aq, p_bid, p_ask, p_bq, p_aq FROM s),
y AS (SELECT token, segment, rn, seq, {first} FROM z WHERE rn = 1
      UNION ALL
      SELECT token, segment, rn, seq, {then} FROM (SELECT *, {ended}, {opened} FROM (SELECT *, {now} FROM (SELECT z.*, {", ".join("y." + c for c in state.split(", "))} FROM y JOIN z ON z.token = y.token AND z.segment = y.segment AND z.rn = y.rn + 1))))
SELECT token, seq, CASE WHEN rn > 1 THEN round(sb - sa, 6) + 0.0::DOUBLE END AS raw, CASE WHEN rn > 1 THEN round(greatest(-1, least(1, sb - sa)), 6) + 0.0::DOUBLE END AS value FROM y"""


ORACLE["feat_refill"] = _refill_sql()
