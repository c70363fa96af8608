"""Queries in which the engine trades, on the derived trading book, and the SQL that gives the same rows.

The SQL puts together what the other queries' SQL gives (features, confidence, regime, quality, threshold; unrounded) and runs
the composite's smoothing and the trading states by recursion over each segment, from a row 0 in which nothing has happened.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from bookloom import catalog
from bookloom.catalog import _GRID, EMA_SQL, KEYS, ORACLE, SEQ_SQL, q6, r6, register, threshold_sql
from bookloom.config import DIRECTIONAL, FACTORS, REGIME_CONFIDENCE, WEIGHTS, Composite, Engine, Execution, Quality, StateMachine, Threshold
from bookloom.features import BUILT_IN, Feature, Registry, feature
from bookloom.functions.scalar import clamp_unit, safe_div
from bookloom.operators import kernel, scan
from bookloom.operators.execution import DepthWalk
from bookloom.operators.order_statistics import sliding_percentiles
from bookloom.plans import engine
from bookloom.sources import observe, wire
from bookloom.sources.derived import BOOK_SQL, derived_book
from bookloom.sources.trading import TRADING_SQL, trading_book

#: Settings under which the trading book trades; what the SQL of features has as constants is left as it is.
TRADING = Engine(
    quality=Quality(min_top_quantity=50),
    threshold=Threshold(base=0.13, min_entry=0.1, max_entry=0.6),
    composite=Composite(min_confidence=0.05, smoothing_half_life_ms=300.0),
    state_machine=StateMachine(min_watch_confidence=0.15, min_entry_confidence=0.2, exit_confidence=0.08, max_hold_ms=4000.0, cooldown_ms=600.0, stop_ticks=5.0, target_ticks=8.0, watch_timeout_ms=5000.0),
    execution=Execution(entry_aggression_ticks=0.0, exit_slippage_ticks=1.0),
)


def exact(name: str, book: str, sql: str | None = None) -> str:
    """A registered query's SQL over another book, its results unrounded."""
    return (sql or ORACLE[name]).replace(BOOK_SQL.strip(), book.strip()).replace(", 6) + 0.0::DOUBLE", ", 15) + 0.0::DOUBLE")


def scored_sql(cfg: Engine, book: str, own: dict[str, tuple[str, str, dict[str, float]]] | None = None) -> str:
    """CTEs up to `scored`: each row's composite before smoothing, and all that the states read.

    own: features instead of the library's, name -> (value over the columns of `s` and fl.value, the traded-price confirmation;
    confidence over the columns of `feature_confidence`; weight by regime).
    """
    features = {n: (f"f_{n}", f"base_{n}", {r: w[i] for r, w in WEIGHTS.items()}) for i, n in enumerate(DIRECTIONAL)} if own is None else {n: (f"f_{n}", b, w) for n, (_, b, w) in own.items()}
    names = list(features)
    c, e = cfg.composite, cfg.execution
    into, out = (f"{t}::DOUBLE * 0.05::DOUBLE" if t is not None else f"mid * {b}::DOUBLE / 10000" for t, b in ((e.entry_aggression_ticks, e.entry_aggression_bps), (e.exit_slippage_ticks, e.exit_slippage_bps)))
    per = lambda f: "[" + ", ".join(f(n) for n in names) + "]"
    weight = lambda n: "CASE regime " + " ".join(f"WHEN '{r}' THEN {features[n][2].get(r, 0.0)}::DOUBLE" for r in WEIGHTS) + " END"
    trust = "(CASE regime " + " ".join(f"WHEN '{r}' THEN {x}::DOUBLE" for r, x in REGIME_CONFIDENCE.items()) + " END)"
    group = [names.index(n) + 1 for n in c.collinear if n in names]
    capped = f"list_transform(w0, lambda w, i: CASE WHEN pair > {c.collinear_cap}::DOUBLE * total AND i IN ({', '.join(map(str, group))}) THEN w * ({c.collinear_cap}::DOUBLE * total / pair) ELSE w END)" if len(group) > 1 else "w0"
    pair = " + ".join(f"w0[{i}]" for i in group) if len(group) > 1 else "0.0"
    two = " AND ".join(f"w0[{i}] > 0" for i in group) if len(group) > 1 else "false"
    values = {"microprice": "fm.value", "weighted_obi": "fo.value", "depth_slope": "fs.value", "queue_persistence": "fp.value", "refill": "fr.value", "momentum": "fd.value", "acceleration": "fa.value", "ltp_confirmation": "fl.value"}
    extra = "" if own is None else "".join(f", {v} AS f_{n}" for n, (v, _, _) in own.items() if n != "ltp_confirmation")
    joins = {"fm": "feat_microprice", "fo": "feat_weighted_obi", "fs": "feat_depth_slope_ols", "fp": "feat_queue_persistence", "fr": "feat_refill", "fd": "feat_momentum", "fa": "feat_acceleration", "fl": "feat_ltp_confirmation"}
    if own is not None:
        joins, values = {"fl": "feat_ltp_confirmation"}, {"ltp_confirmation": "fl.value"}
    parts = ", ".join(f"{k} AS MATERIALIZED ({exact(q, book)})" for k, q in joins.items())
    return f"""WITH RECURSIVE {SEQ_SQL.replace(BOOK_SQL.strip(), book.strip())},
{parts}, fc AS MATERIALIZED ({exact('feature_confidence', book)}), fg AS MATERIALIZED ({exact('regime_hysteresis', book)}), fq AS MATERIALIZED ({exact('quality_gate', book)}), ft AS MATERIALIZED ({exact('adaptive_threshold', book, threshold_sql(cfg.threshold))}),
all0 AS (SELECT s.*, fc.* EXCLUDE (token, seq), regime, proposed, blocks, ft.entry, ft.watch, ft.exit, least(bq[1], aq[1]) < {cfg.quality.min_top_quantity} AS thin, {', '.join(f'{v} AS f_{n}' for n, v in values.items())}{extra}
  FROM s JOIN fc USING (token, seq) JOIN fg USING (token, seq) JOIN fq USING (token, seq) JOIN ft USING (token, seq) {' '.join(f'LEFT JOIN {k} ON {k}.token = s.token AND {k}.seq = s.seq' for k in joins)}),
all1 AS (SELECT *, {per(lambda n: features[n][0])} AS fv, {per(lambda n: f"CASE WHEN {features[n][0]} IS NULL THEN 0.0::DOUBLE ELSE {weight(n)} END")} AS w0, {per(lambda n: f"coalesce({features[n][1]}, 0) * {trust}")} AS x0 FROM all0),
all2 AS (SELECT *, list_sum(w0) AS total, CASE WHEN {two} THEN {pair} ELSE 0.0 END AS pair FROM all1),
all3 AS (SELECT *, CASE WHEN total > 0 THEN {capped} ELSE w0 END AS w, list_transform(x0, lambda x: CASE WHEN x < {cfg.confidence.min_feature_confidence}::DOUBLE THEN 0.0::DOUBLE ELSE least(1, x) END) AS sure FROM all2),
all4 AS (SELECT *, list_transform(w, lambda a, i: a * sure[i]) AS mass FROM all3),
all5 AS (SELECT *, list_sum(mass) AS whole, coalesce(list_sum(list_transform(w, lambda a, i: CASE WHEN mass[i] > 0 THEN a ELSE 0.0 END)), 0) AS weighed, len(list_filter(mass, lambda m: m > 0)) AS used FROM all4),
all6 AS (SELECT *, CASE WHEN total > 0 THEN CASE WHEN weighed > 1e-12 THEN whole / weighed ELSE 0.0 END END AS conf FROM all5),
scored AS (SELECT token, segment, rn, seq, idx, CAST(ts AS DOUBLE) AS clock, dt_ms, regime, conf, total > 0 AND used >= {c.min_features} AND conf >= {c.min_confidence}::DOUBLE AS valid,
  CASE WHEN whole > 0 THEN greatest(-1, least(1, list_sum(list_transform(fv, lambda x, i: CASE WHEN mass[i] > 0 THEN x * mass[i] / whole ELSE 0.0 END)))) ELSE 0.0 END AS raw,
  blocks = '' AND NOT thin AS tradable, contains(blocks, 'WARMUP') AS warming, thin OR contains(blocks, 'FEED_GAP') OR contains(blocks, 'SPREAD_TOO_WIDE') OR contains(blocks, 'LIQUIDITY') AS critical,
  entry, watch, exit AS leave, f_ltp_confirmation AS ltp, bp, ap, spread_ticks, mid, bq, aq, bid, ask,
  greatest({_GRID.format(p=f'ap + {into}')}, ap) AS entry_long, least({_GRID.format(p=f'bp - {into}')}, bp) AS entry_short, least({_GRID.format(p=f'bp - {out}')}, bp) AS exit_long, greatest({_GRID.format(p=f'ap + {out}')}, ap) AS exit_short
  FROM all6)"""


def states_sql(cfg: Engine, book: str, quantities: tuple[str, str] = ("1", "1"), prices: tuple[str, str] = ("entry_long", "entry_short"), **more) -> str:
    """CTEs up to `states`: the smoothed composite, and the trading states with reasons and positions. quantities and prices: what an entry long and short fills."""
    c, sm, f = cfg.composite, cfg.state_machine, cfg.features
    grid = lambda p: f"round_even(round_even(({p}) / 0.05::DOUBLE, 0) * 0.05::DOUBLE, 6)"
    d = lambda x: f"{float(x)}::DOUBLE"
    return scored_sql(cfg, book, **more) + f""",
states AS (
  SELECT DISTINCT token, segment, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, 0.0::DOUBLE AS val, 0 AS cnt, 0.0::DOUBLE AS smoothed, 'WARMUP' AS previous_state, 'WARMUP' AS state, '' AS reason, NULL::INTEGER AS dir, NULL::BIGINT AS qty, NULL::DOUBLE AS price, NULL::DOUBLE AS since, NULL::DOUBLE AS stop, NULL::DOUBLE AS target,
    0.0::DOUBLE AS deadline, 0.0::DOUBLE AS cooldown, 0 AS confirmed, 0 AS confirming, 0 AS blocked, false AS opened, false AS closed FROM scored
  UNION ALL
  SELECT token, segment, rn, seq, val, cnt, smoothed, was, CASE WHEN closes THEN CASE WHEN dir > 0 THEN 'EXIT_LONG' ELSE 'EXIT_SHORT' END WHEN held THEN was WHEN opens THEN CASE WHEN sign > 0 THEN 'LONG' ELSE 'SHORT' END ELSE then_state END, reason,
    CASE WHEN held THEN dir WHEN opens THEN sign END, CASE WHEN held THEN qty WHEN opens THEN filled END, CASE WHEN held THEN price WHEN opens THEN paid END, CASE WHEN held THEN since WHEN opens THEN clock END,
    CASE WHEN held THEN stop WHEN opens THEN {grid(f'paid - sign * {d(sm.stop_ticks)} * 0.05::DOUBLE')} END, CASE WHEN held THEN target WHEN opens THEN {grid(f'paid + sign * {d(sm.target_ticks)} * 0.05::DOUBLE')} END,
    CASE WHEN reason = 'watch armed' THEN clock + {d(sm.watch_timeout_ms)} ELSE deadline END, CASE WHEN closes THEN clock + {d(sm.cooldown_ms)} ELSE cooldown END,
    CASE WHEN closes OR opens THEN 0 WHEN held OR was IN ('EXIT_LONG', 'EXIT_SHORT', 'COOLDOWN', 'WARMUP') THEN confirmed WHEN confirms THEN times ELSE 0 END, CASE WHEN closes THEN 0 WHEN reason = 'watch armed' OR confirms THEN sign ELSE confirming END,
    CASE WHEN closes THEN dir ELSE block END, opens, closes
  FROM (SELECT *, held AND leaves IS NOT NULL AS closes, CASE WHEN held THEN CASE WHEN leaves IS NULL THEN 'holding' ELSE 'exit: ' || leaves END WHEN confirms THEN CASE WHEN times >= {sm.entry_confirmations} THEN 'entry' ELSE 'confirming ' || times || '/{sm.entry_confirmations}' END ELSE flat END AS reason,
      confirms AND times >= {sm.entry_confirmations} AS opens,
      CASE WHEN confirms OR flat IN ('score below entry', 'confidence below entry', 'awaiting traded-price confirmation', 'traded price contradicts', 'cost gate', 'cooldown active', 'warming up') THEN was WHEN flat = 'watch armed' THEN CASE WHEN sign > 0 THEN 'WATCH_LONG' ELSE 'WATCH_SHORT' END WHEN flat = 'entering cooldown' THEN 'COOLDOWN' ELSE 'NEUTRAL' END AS then_state
    FROM (SELECT *, NOT held AND flat IS NULL AS confirms, CASE WHEN confirming = sign THEN confirmed + 1 ELSE 1 END AS times, CASE WHEN sign > 0 THEN {prices[0]} ELSE {prices[1]} END AS paid, CASE WHEN sign > 0 THEN {quantities[0]} ELSE {quantities[1]} END AS filled
      FROM (SELECT *,
        CASE WHEN held THEN CASE WHEN dir * ((CASE WHEN dir > 0 THEN bp ELSE ap END) - stop) <= 1e-7 THEN 'stop' WHEN clock - since < {d(sm.min_hold_ms)} THEN NULL WHEN dir * ((CASE WHEN dir > 0 THEN bp ELSE ap END) - target) >= -1e-7 THEN 'target' WHEN clock - since >= {d(sm.max_hold_ms)} THEN 'time'
          WHEN score * dir <= -leave * {d(sm.reversal_ratio)} THEN 'composite reversal' WHEN trusted < {d(sm.exit_confidence)} THEN 'confidence' WHEN critical THEN 'quality' END END AS leaves,
        CASE WHEN was IN ('EXIT_LONG', 'EXIT_SHORT') THEN CASE WHEN clock < cooldown THEN 'entering cooldown' ELSE 'flat' END WHEN was = 'COOLDOWN' THEN CASE WHEN clock >= cooldown THEN 'cooldown elapsed' ELSE 'cooldown active' END WHEN was = 'WARMUP' THEN CASE WHEN warming THEN 'warming up' ELSE 'warmup complete' END
          WHEN NOT valid THEN 'composite not usable' WHEN NOT tradable THEN 'blocked' WHEN sign = 0 THEN 'no directional score' WHEN block = sign THEN 'awaiting zero-cross re-arm after exit' WHEN abs(score) < watch OR trusted < {d(sm.min_watch_confidence)} THEN 'below watch'
          WHEN was <> CASE WHEN sign > 0 THEN 'WATCH_LONG' ELSE 'WATCH_SHORT' END THEN 'watch armed' WHEN clock > deadline THEN 'watch expired' WHEN abs(score) < entry THEN 'score below entry' WHEN trusted < {d(sm.min_entry_confidence)} THEN 'confidence below entry'
          WHEN ltp IS NULL THEN 'awaiting traded-price confirmation' WHEN ltp * sign <= -{d(f.ltp_opposition)} THEN 'traded price contradicts' END AS flat
        FROM (SELECT *, CAST(sign(score) AS INTEGER) AS sign, CASE WHEN blocked <> 0 AND sign(score) <> blocked THEN 0 ELSE blocked END AS block
          FROM (SELECT *, CASE WHEN valid THEN smoothed ELSE 0.0 END AS score, CASE WHEN valid THEN conf ELSE 0.0 END AS trusted
            FROM (SELECT * REPLACE (now AS val), CASE WHEN conf IS NULL THEN 0.0 ELSE greatest(-1, least(1, now)) END AS smoothed
              FROM (SELECT z.*, p.state AS was, p.dir IS NOT NULL AND NOT p.closed AS held, CASE WHEN p.closed THEN NULL ELSE p.dir END AS dir, p.qty, p.price, p.since, p.stop, p.target, p.deadline, p.cooldown, p.confirmed, p.confirming, p.blocked, p.val,
                CASE WHEN z.valid THEN CASE WHEN p.cnt = 0 THEN z.raw ELSE p.val + (1 - exp(-ln(2) * least(greatest(z.dt_ms, 0), 5000) / {d(c.smoothing_half_life_ms)})) * (z.raw - p.val) END ELSE p.val END AS now, CASE WHEN z.valid THEN 1 ELSE p.cnt END AS cnt
                FROM states p JOIN scored z ON z.token = p.token AND z.segment = p.segment AND z.rn = p.rn + 1))))))))"""


def _composite_sql(cfg: Engine, book: str, **more) -> str:
    return states_sql(cfg, book, **more) + f" SELECT token, seq, regime, valid AS composite_valid, {q6('CASE WHEN valid THEN raw ELSE 0 END', 'score')}, {q6('smoothed', 'smoothed')}, {q6('coalesce(conf, 0)', 'confidence')} FROM states JOIN scored USING (token, segment, rn, seq)"


def _shown_sql(cfg: Engine, book: str, exits: tuple[str, str] = ("exit_long", "exit_short"), **more) -> str:
    out = f"CASE WHEN dir IS NOT NULL AND NOT opened THEN CASE WHEN dir > 0 THEN {exits[0]} ELSE {exits[1]} END END"
    return states_sql(cfg, book, **more) + f", shown AS (SELECT *, {out} AS exit_price FROM states JOIN scored USING (token, segment, rn, seq))"


def _states_sql(cfg: Engine, book: str, **more) -> str:
    return _shown_sql(cfg, book, **more) + f" SELECT token, seq, previous_state, state, reason, dir AS direction, round(price, 6) + 0.0::DOUBLE AS entry_price, round(exit_price, 6) + 0.0::DOUBLE AS exit_price, opened, closed FROM shown"


def _pnl_sql(cfg: Engine, book: str, **more) -> str:
    leg = "least({t} * 3e-4::DOUBLE, 20)"
    return _shown_sql(cfg, book, **more) + f""",
paid AS (SELECT *, (CASE WHEN dir > 0 THEN price ELSE exit_price END) * qty AS buy, (CASE WHEN dir > 0 THEN exit_price ELSE price END) * qty AS sell FROM shown WHERE closed),
cost AS (SELECT *, ({leg.format(t='buy')} + {leg.format(t='sell')} + (buy + sell) * 2.97e-5::DOUBLE + (buy + sell) * 1e-6::DOUBLE) * 1.18::DOUBLE + sell * 2.5e-4::DOUBLE + buy * 3e-5::DOUBLE AS rupees, (exit_price - price) * dir * qty AS gross FROM paid)
SELECT token, seq, reason, {q6('(exit_price - price) * dir / 0.05::DOUBLE', 'gross_ticks')}, {q6('gross', 'gross_rupees')}, {q6('rupees', 'cost_rupees')}, {q6('gross - rupees', 'net_rupees')}, {q6('(gross - rupees) * 10000 / (price * qty)', 'net_bps')}, {q6('clock - since', 'holding_ms')} FROM cost"""


ORACLE["composite_score"] = _composite_sql(catalog.CFG, BOOK_SQL)
ORACLE["state_machine"] = _states_sql(catalog.CFG, BOOK_SQL)
ORACLE["position_pnl"] = _pnl_sql(catalog.CFG, BOOK_SQL)


@register("trading_book", "SELECT token, seq, ts AS exchange_timestamp_ms, bid, ask, volume, CAST(bq[1] AS BIGINT) AS bid_qty, CAST(aq[5] AS BIGINT) AS ask_qty5, total_buy, ltp FROM book", TRADING_SQL)
def q_book(spark, sf):
    b = trading_book(spark, sf)
    return b.select(*KEYS, "exchange_timestamp_ms", F.get("bids", 0)["price_paise"].alias("bid"), F.get("asks", 0)["price_paise"].alias("ask"), F.col("volume_traded_today").alias("volume"), F.get("bids", 0)["quantity"].alias("bid_qty"), F.get("asks", 4)["quantity"].alias("ask_qty5"), F.col("total_buy_quantity").alias("total_buy"), F.col("last_traded_price").alias("ltp"))


COMPOSITE = [*KEYS, "regime", "composite_valid", "score", "smoothed", "composite_confidence"]
STATES = [*KEYS, "previous_state", "state", "reason"]
PNL = [*KEYS, "reason"]


def composite_columns(df):
    return df.select(*KEYS, "regime", "composite_valid", r6("score").alias("score"), r6("smoothed").alias("smoothed"), r6("composite_confidence").alias("confidence"))


def state_columns(df):
    return df.select(*KEYS, "previous_state", "state", "reason", "direction", r6("entry_price").alias("entry_price"), r6("exit_price").alias("exit_price"), "opened", "closed")


def pnl_columns(df):
    return df.where("closed").select(*KEYS, "reason", *(r6(f"pnl.{c}").alias(c) for c in ("gross_ticks", "gross_rupees", "cost_rupees", "net_rupees", "net_bps", "holding_ms")))


@register("trading_composite", _composite_sql(TRADING, TRADING_SQL), "")
def q_composite(spark, sf):
    return composite_columns(engine.decided(trading_book(spark, sf), TRADING, columns=COMPOSITE))


@register("trading_states", _states_sql(TRADING, TRADING_SQL), "")
def q_states(spark, sf):
    return state_columns(engine.run_batch(trading_book(spark, sf), TRADING, columns=STATES))


@register("trading_pnl", _pnl_sql(TRADING, TRADING_SQL), "")
def q_pnl(spark, sf):
    return pnl_columns(engine.run_batch(trading_book(spark, sf), TRADING, columns=PNL))


# Features of a user's own, in place of most of the library's: the touch's lean, and where trades agree with it.


def _lean(cfg: Engine):
    bid, ask = F.get("bids", 0)["quantity"], F.get("asks", 0)["quantity"]
    return safe_div((bid - ask).cast("double"), bid + ask)


_OWN_WEIGHTS = {"touch_lean": 0.5, "lean_agreement": 0.3, "ltp_confirmation": 0.2}
_BY_NAME = {f.name: f for f in BUILT_IN}
OWN = Registry(
    [
        Feature("lean_agreement", lambda cfg: clamp_unit((feature("touch_lean") + feature("ltp_confirmation")) / 2), depends_on=("touch_lean", "ltp_confirmation"), label="Trades agree with the touch"),
        Feature("touch_lean", _lean, label="Touch lean"), *(_BY_NAME[n] for n in ("weighted_obi", "momentum", "ltp_confirmation")),
    ],
    weights={r: _OWN_WEIGHTS for r in WEIGHTS},
)
OWN_SETTINGS = dataclasses.replace(TRADING, composite=dataclasses.replace(TRADING.composite, min_features=1))
_FACTORED = " * ".join(f"factor_{k}" for k in FACTORS)
_LEAN_SQL = "((bq[1] - aq[1]) / CAST(bq[1] + aq[1] AS DOUBLE))"
_OWN_SQL = {
    "touch_lean": (_LEAN_SQL, _FACTORED, {r: 0.5 for r in WEIGHTS}),
    "lean_agreement": (f"CASE WHEN fl.value IS NOT NULL THEN greatest(-1, least(1, ({_LEAN_SQL} + fl.value) / 2)) END", _FACTORED, {r: 0.3 for r in WEIGHTS}),
    "ltp_confirmation": ("fl.value", "base_ltp_confirmation", {r: 0.2 for r in WEIGHTS}),
}


@register("own_features", _composite_sql(OWN_SETTINGS, TRADING_SQL, own=_OWN_SQL), "")
def q_own_features(spark, sf):
    return composite_columns(engine.decided(trading_book(spark, sf), OWN_SETTINGS, OWN, columns=COMPOSITE))


# Another model of fills: orders larger than what stands at the touch, some larger than the visible book.

LARGE = dataclasses.replace(TRADING, quantity=3000)


def _walk_sql(side: str, q: str) -> tuple[str, str]:
    """(price, filled) of an order for q that eats into a side."""
    paise = "bid - 5 * (i - 1)" if side == "bq" else "ask + 5 * (i - 1)"
    take = f"least({side}[i], greatest(0, {q} - coalesce(list_sum({side}[1:i - 1]), 0)))"
    filled = f"CAST(list_sum(list_transform(range(1, 6), lambda i: {take})) AS BIGINT)"
    return f"(list_sum(list_transform(range(1, 6), lambda i: {take} * (({paise}) / 100.0::DOUBLE))) / {filled})", filled


def _large_sql() -> str:
    (into_long, filled_long), (into_short, filled_short) = _walk_sql("aq", "3000"), _walk_sql("bq", "3000")
    more = {"quantities": (filled_long, filled_short), "prices": (into_long, into_short), "exits": (_walk_sql("bq", "qty")[0], _walk_sql("aq", "qty")[0])}
    text = _pnl_sql(LARGE, TRADING_SQL, **more)
    return text.replace("SELECT token, seq, reason,", "SELECT token, seq, reason, qty AS quantity, round(price, 6) + 0.0::DOUBLE AS entry_price, round(exit_price, 6) + 0.0::DOUBLE AS exit_price,")


@register("depth_walk_pnl", _large_sql(), "")
def q_depth_walk(spark, sf):
    df = engine.run_batch(trading_book(spark, sf), LARGE, model=DepthWalk(), columns=PNL)
    return df.where("closed").select(*KEYS, "reason", "quantity", r6("entry_price").alias("entry_price"), r6("exit_price").alias("exit_price"), *(r6(f"pnl.{c}").alias(c) for c in ("gross_ticks", "gross_rupees", "cost_rupees", "net_rupees", "net_bps", "holding_ms")))


ORACLE["decision_digest"] = (
    states_sql(catalog.CFG, BOOK_SQL)
    + """, leaves AS (SELECT token, idx - 1 AS place, sha256('{"idx":' || idx || ',"state":"' || state || '","regime":"' || regime || '","smoothed":' || CAST(round(smoothed * 1000000, 0) AS BIGINT) || ',"entry":' || CAST(round(entry * 1000000, 0) AS BIGINT) || '}') AS digest FROM states JOIN scored USING (token, segment, rn, seq)),
up AS (SELECT token, place // 1024 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest, count(*) AS n FROM leaves GROUP BY ALL)
SELECT token, sha256(string_agg(digest, '' ORDER BY place)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM up GROUP BY token"""
)


@register("ema_blocks", f"WITH RECURSIVE {EMA_SQL.replace(BOOK_SQL.strip(), TRADING_SQL.strip())} SELECT token, seq, {q6('tf - ts_', 'trend')}, {q6('sf', 'spread_fast')}, {q6('ss', 'spread_slow')} FROM r", "")
def q_ema_blocks(spark, sf):
    """Averages of every token by blocks of rows, not by tokens: what the sequencing kernel gives, from maps that compose."""
    b = trading_book(spark, sf).select(*KEYS, "exchange_timestamp_ms", (F.get("bids", 0)["price_paise"] + F.get("asks", 0)["price_paise"]).alias("twice"), ((F.get("asks", 0)["price"] - F.get("bids", 0)["price"]) / 0.05).alias("spread_ticks"))
    b = scan.lagged(b, "token", ["seq"], {"p_ts": "exchange_timestamp_ms"})
    b = b.withColumn("gap", F.coalesce(F.col("exchange_timestamp_ms") - F.col("p_ts") > catalog.CFG.validation.max_snapshot_gap_ms, F.lit(False)))
    b = scan.lagged(b, "token", ["seq"], {"p_gap": "gap"})
    fresh = F.col("p_ts").isNull() | F.col("gap")
    dt = F.when(fresh | F.coalesce("p_gap", F.lit(False)), 0.0).otherwise((F.col("exchange_timestamp_ms") - F.col("p_ts")).cast("double"))
    r, f, ticks = catalog.CFG.regime, catalog.CFG.features, F.col("twice") / 10
    averages = {"fast": (ticks, r.fast_half_life_ms), "slow": (ticks, r.slow_half_life_ms), "sf": (F.col("spread_ticks"), f.compression_fast_ms), "ss": (F.col("spread_ticks"), f.compression_slow_ms)}
    out = scan.time_averages(b, "token", ["seq"], fresh, dt, averages, f.max_dt_ms)
    return out.select(*KEYS, r6(F.col("fast") - F.col("slow")).alias("trend"), r6("sf").alias("spread_fast"), r6("ss").alias("spread_slow"))


@register("sliding_percentiles", "SELECT event_type, event_id, n, s[1 + least(n - 1, CAST(floor(n * 0.5) AS BIGINT))] AS p50, s[1 + least(n - 1, CAST(floor(n * 0.9::DOUBLE) AS BIGINT))] AS p90, s[1 + least(n - 1, CAST(floor(n * 0.99::DOUBLE) AS BIGINT))] AS p99, s[n] AS most FROM (SELECT event_type, event_id, len(l) AS n, list_sort(l) AS s FROM (SELECT event_type, event_id, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS l FROM events))", "")
def q_sliding(spark, sf):
    return sliding_percentiles(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "event_id", "value", size=1000)


# Payloads as a feed may send them: bytes, lists in lists, words between messages, and damaged ones.

_KIND_SQL = "CASE seq % 9 WHEN 1 THEN 'list' WHEN 2 THEN 'nested' WHEN 3 THEN 'garbled' WHEN 4 THEN 'cut' WHEN 5 THEN 'word' WHEN 6 THEN 'deep' WHEN 7 THEN 'nameless' ELSE 'plain' END"


def payloads(spark, sf):
    """(seq, payload): the derived book's messages as bytes, wrapped or damaged in one of several ways by their place."""
    b = wire.sample_payloads(derived_book(spark, sf))
    seq = F.get_json_object("payload", "$.sequence_number").cast("long")
    p, kind = F.col("payload"), F.expr(_KIND_SQL)
    told = (
        F.when(kind == "list", F.concat(F.lit("["), p, F.lit("]"))).when(kind == "nested", F.concat(F.lit('["pong", [['), p, F.lit("], ["), p, F.lit("]], null]"))).when(kind == "cut", F.substring(p, 1, 40)).when(kind == "word", F.lit(' "PONG" '))
        .when(kind == "deep", F.concat(F.lit("[[[[["), p, F.lit("]]]]]"))).when(kind == "nameless", F.regexp_replace(p, '"token":"[0-9]+"', '"token":" "')).otherwise(p)
    )
    raw = told.cast("binary")
    return b.select("payload", seq.alias("seq")).select("seq", F.when(kind == "garbled", F.concat(raw, F.unhex(F.lit("C3")))).otherwise(raw).alias("payload"))


@register("nested_payloads", f"SELECT CASE WHEN kind IN ('garbled', 'cut', 'deep', 'nameless') THEN NULL ELSE token END AS token, CASE kind WHEN 'garbled' THEN 'not UTF-8' WHEN 'cut' THEN 'not JSON' WHEN 'deep' THEN 'not JSON, or nested too deep' WHEN 'nameless' THEN 'no token' END AS parse_error, CAST(sum(CASE kind WHEN 'nested' THEN 2 ELSE 1 END) AS BIGINT) AS n, CAST(sum(CASE kind WHEN 'nested' THEN 2 ELSE 1 END * CASE WHEN kind IN ('garbled', 'cut', 'deep', 'nameless') THEN 0 ELSE ask END) AS BIGINT) AS asks FROM (SELECT *, {_KIND_SQL} AS kind FROM book) WHERE kind <> 'word' GROUP BY ALL", BOOK_SQL)
def q_nested(spark, sf):
    rows = wire.parse(payloads(spark, sf), "payload")
    good = F.col("parse_error").isNull()
    return rows.groupBy(F.when(good, F.col("token")).alias("token"), "parse_error").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(good, F.get("asks", 0)["price_paise"])), F.lit(0)).alias("asks"))


@register("replay_counts", "SELECT count(*) AS rows, CAST(sum(CAST(seq % 7 NOT IN (1, 2) AS INT)) AS BIGINT) AS accepted, CAST(sum(CAST(seq % 7 = 1 AS INT)) AS BIGINT) AS no_token, CAST(sum(CAST(seq % 7 = 2 AS INT)) AS BIGINT) AS no_depth FROM book", BOOK_SQL)
def q_replay_counts(spark, sf):
    """Counts of a replay's lines by why they are skipped, as they are observed while it runs."""
    lines = derived_book(spark, sf).select(F.when(F.col("seq") % 7 == 1, F.substring(wire.to_record(), 1, 30)).when(F.col("seq") % 7 == 2, F.concat(F.lit('{"token":"'), "token", F.lit('"}'))).otherwise(wire.to_record()).alias("line"))
    rows, seen = observe.observed(wire.from_record(lines, "line"), "replay", ("no token", "no depth"))
    rows.write.format("noop").mode("overwrite").save()
    counts = seen.get
    return spark.createDataFrame([(counts["rows"], counts["accepted"], counts["no token"], counts["no depth"])], "rows long, accepted long, no_token long, no_depth long")
