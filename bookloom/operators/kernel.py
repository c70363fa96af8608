"""The two sequential kernels: what a row's value owes to the kernel's own output before it.

A kernel is a small step function over one token's rows in order. `run_ordered` deals rows to tasks by
token and part of its history (a stretch or a segment, with which states start afresh), sorts them inside each task, and feeds
Arrow batches through, with one state in memory at a time; so a token's history is no task's. The same steps serve streams.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.config import REGIME_CONFIDENCE, Engine
from bookloom.features import DEFAULT, Registry
from bookloom.operators.batches import field, plain
from bookloom.operators.stretches import RESUME, STRETCH, Gate, stretched

LN2 = math.log(2.0)


def run_ordered(df: DataFrame, order: str, inputs: list[str | Column], outputs: str, start: Callable, step: Callable, keep: str = "row", by: str | None = None, resume: str | None = None, tasks: int | None = None, in_order: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Adds step(state, *inputs) -> outputs to df, a struct column `row` with all columns of df beside `token`.

    by: a column that cuts a token's rows into parts with states of their own; resume: one whose value, on a part's first row, start is given; tasks: how many to deal the parts to.
    in_order: a kernel before left whole parts in order in each task, so that they needn't be dealt and sorted again; columns: those of df and outputs that are wanted, where not all are.
    """
    out = T.StructType.fromDDL(outputs)
    told = [i for i, f in enumerate(out.fields) if columns is None or f.name in columns]
    fields = [out.fields[i] for i in told]
    part = F.col(by).cast("long") if by else F.lit(0).cast("long")
    taken = F.col(resume) if resume else F.lit(None).cast("binary")
    kept = df if columns is None else df.select(*(c for c in df.columns if c in columns or c == "token"))
    # What is kept of a row isn't sent twice.
    inside = {i: c for i, c in enumerate(inputs) if isinstance(c, str) and c.split(".")[0] in kept.columns}
    packed = df.select(F.struct(*kept.columns).alias(keep), F.col("token").alias("__token"), part.alias("__part"), taken.alias("__resume"), *((F.col(c) if isinstance(c, str) else c).alias(f"__{i}") for i, c in enumerate(inputs) if i not in inside))
    keys = ["__token", "__part"] if by else ["__token"]
    if not in_order:
        packed = (packed.repartition(tasks, *keys) if tasks else packed.repartition(*keys)).sortWithinPartitions(*keys, f"{keep}.{order}")
    schema = T.StructType([T.StructField(keep, kept.schema), *fields])
    arrow = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}[f.dataType.simpleString()] for f in fields]

    count = len(inputs)

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, part, state = object(), None, None
        for b in batches:
            rows = []
            kept_rows, *sent = b.columns
            sent = list(map(plain, sent))
            rest = iter(sent[3:])
            for now, piece, saved, *values in zip(*sent[:3], *(field(kept_rows, inside[i]) if i in inside else next(rest) for i in range(count)), strict=True):
                if now != token or piece != part:
                    token, part, state = now, piece, start(saved) if resume else start()
                rows.append(step(state, *values))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(out.fields)
            yield pa.RecordBatch.from_arrays([kept_rows, *(pa.array(columns[i], t) for i, t in zip(told, arrow, strict=True))], [keep, *(f.name for f in fields)])

    return packed.mapInArrow(feed, schema)


#: The reason of a row that isn't a snapshot but says that the feed broke before the next one.
GAP_NOTICE = "GAP_NOTICE"


@functools.lru_cache(maxsize=65_536)
def gained(dt: float, half_life: float, most: float) -> float:
    """The share of a mean that a sample takes over after dt."""
    return 1 - math.exp(-LN2 * min(max(dt, 0.0), most) / half_life)


class Ema:
    """A mean that forgets half of what it holds in each half-life; the first sample seeds it."""

    __slots__ = ("half_life", "most", "n", "value")

    def __init__(self, half_life: float, most: float):
        self.half_life, self.most, self.value, self.n = half_life, most, 0.0, 0

    def add(self, x: float, dt: float) -> float:
        if self.n:
            self.value += gained(dt, self.half_life, self.most) * (x - self.value)
        else:
            self.value = x
        self.n += 1
        return self.value


SEQUENCE_IN = ["structural_reason", "exchange_timestamp_ms", "clock_ms", "sequence_number", "volume_traded_today", "last_traded_price", "mid", "spread_ticks", "tilt_value", "obi", "tick", "bids.price_paise", "bids.quantity", "asks.price_paise", "asks.quantity", "notices", "notice_clock"]
SEQUENCE_OUT = (
    "reject_reason string, gap boolean, forced boolean, idx bigint, segment bigint, row_no bigint, is_first boolean, dt_ms double, delta_volume bigint, ms_since_gap double, "
    "prev_bid_paise bigint, prev_bid_qty bigint, prev_ask_paise bigint, prev_ask_qty bigint, compression double, trend double, micro double, momentum double, momentum_valid boolean, "
    "acceleration double, acceleration_valid boolean, ltp_drift double, ltp_local double, refill double"
)


class Admission(Gate):
    """Validates a token's rows against the last accepted one and says where segments start."""

    def __init__(self, cfg: Engine):
        self.cfg = cfg
        self.before: tuple | None = None  # what the next row is validated against
        self.pending, self.gap_clock, self.idx, self.segment = False, None, 0, 0
        self.seen = 0  # notices for all tokens that have been obeyed

    @property
    def core(self) -> tuple:
        return self.before, self.pending, self.seen

    @core.setter
    def core(self, value: tuple) -> None:
        self.before, self.pending, self.seen = value

    def takes(self, *values) -> bool:
        return self.admitted(*values)[2]

    def rejected(self, reason: str, clock: float, gap: bool) -> tuple:
        if gap:
            self.pending, self.gap_clock = True, clock
        return reason, gap, False, False, 0.0, 0

    def admitted(self, structural, ts, clock, seq, volume, ltp, mid, tick, bid, ask, bid_size, ask_size, notices=0, notice_clock=None) -> tuple:
        """(reason to reject or None, gap, forced: starts a segment, first: held against nothing, dt, delta volume). bid and ask are the best prices in paise; notices is how many breaks of the feed have been told to all tokens up to this row's clock, notice_clock when the last was."""
        v = self.cfg.validation
        if notices > self.seen:
            self.seen, self.pending, self.gap_clock = notices, True, notice_clock
        if structural is not None:
            return self.rejected(structural, clock, structural == GAP_NOTICE)
        touch = (bid, ask, bid_size, ask_size, volume, ltp)
        first, gap, dt, dv = self.before is None, False, 0.0, 0
        if not first:
            p_ts, p_seq, p_mid, p_touch = self.before
            if ts < p_ts:
                return self.rejected("NON_MONOTONIC_TIMESTAMP", clock, True)
            if ts - p_ts > v.max_staleness_ms:
                if v.stale_recovery:
                    self.before = None
                return self.rejected("STALE_TIMESTAMP", clock, True)
            if volume < p_touch[4]:
                return self.rejected("VOLUME_REGRESSION", clock, True)
            gap = ts - p_ts > v.max_snapshot_gap_ms or abs(mid - p_mid) / tick > v.max_price_gap_ticks or (seq != 0 and p_seq != 0 and seq < p_seq)
            if v.reject_duplicates and ts == p_ts and touch == p_touch:
                return self.rejected("DUPLICATE_SNAPSHOT", clock, False)
            if not gap:
                dt, dv = float(ts - p_ts), volume - p_touch[4]
        first = first or gap
        self.before = (ts, seq, mid, touch)
        if gap:
            self.pending, self.gap_clock = True, clock
        forced = self.pending
        if forced:
            self.pending, self.before = False, None
            self.segment += 1
        self.idx += 1
        return None, gap, forced, first, dt, dv


#: What Admission reads, in the order of its arguments.
ADMISSION_IN = ["structural_reason", "exchange_timestamp_ms", "clock_ms", "sequence_number", "volume_traded_today", "last_traded_price", "mid", "tick", "bid_paise", "ask_paise", "bid_size", "ask_size", "notices", "notice_clock"]


class Sequencer(Admission):
    """Admits a token's rows, cuts segments at gaps, and runs their averages and refill episodes."""

    def __init__(self, cfg: Engine, saved: bytes | None = None):
        """saved: an Admission's pickled place just before a row that starts a segment."""
        super().__init__(cfg)
        if saved is not None:
            self.place = pickle.loads(saved)
        self.restart()

    def restart(self) -> None:
        f, r = self.cfg.features, self.cfg.regime
        ema = lambda half_life: Ema(half_life, f.max_dt_ms)
        self.spread_fast, self.spread_slow = ema(f.compression_fast_ms), ema(f.compression_slow_ms)
        self.trend_fast, self.trend_slow = ema(r.fast_half_life_ms), ema(r.slow_half_life_ms)
        self.micro, self.mom_fast, self.mom_slow = ema(f.microprice_half_life_ms), ema(f.momentum_fast_ms), ema(f.momentum_slow_ms)
        self.smooth, self.ltp = ema(f.acceleration_half_life_ms), ema(f.ltp_half_life_ms)
        self.last_momentum: float | None = None
        self.last_trade: int | None = None
        self.previous: tuple | None = None
        self.scores, self.episodes, self.row = [0.0, 0.0], [None, None], 0

    def step(self, structural, ts, clock, seq, volume, ltp, mid, spread_ticks, tilt, obi, tick, bids, bid_sizes, asks, ask_sizes, notices=0, notice_clock=None) -> tuple:
        """bids and asks are prices in paise by level, the sizes what stands there; see `admitted` for the notices."""
        f = self.cfg.features
        best = (None,) * 4 if structural is not None else (bids[0], asks[0], bid_sizes[0], ask_sizes[0])
        reason, gap, forced, first, dt, dv = self.admitted(structural, ts, clock, seq, volume, ltp, mid, tick, *best, notices, notice_clock)
        if reason is not None:
            return (reason, gap, False, *[None] * 21)
        if forced:
            self.restart()
        self.row += 1
        previous = self.previous or (None,) * 4
        fast, slow = self.spread_fast.add(spread_ticks, dt), self.spread_slow.add(spread_ticks, dt)
        compression = slow - fast if self.spread_fast.n >= 4 else None
        trend = self.trend_fast.add(mid / tick, dt) - self.trend_slow.add(mid / tick, dt)
        micro = max(-1.0, min(1.0, self.micro.add(tilt, dt))) if tilt is not None else None
        momentum = self.mom_fast.add(obi, dt) - self.mom_slow.add(obi, dt) if obi is not None else None
        valid = momentum is not None and self.mom_fast.n >= f.momentum_warmup
        accel = None
        if valid and self.last_momentum is not None:
            accel = self.smooth.add((momentum - self.last_momentum) / (max(dt, f.acceleration_min_dt_ms) / 1000), dt)
        self.last_momentum = momentum if valid else None
        drift = local = None
        if ltp > 0:
            if dv > 0:
                self.last_trade = ts
            known, reference = self.ltp.n, self.ltp.value
            self.ltp.add(ltp, dt)
            if known:
                drift = (ltp - reference) / tick
                local = 0.6 if self.last_trade is None else 0.3 if ts - self.last_trade > f.ltp_stale_ms else 1.0
        refill = self.refill(ts, dt, dv, (bids, bid_sizes), (asks, ask_sizes))
        self.previous = (best[0], best[2], best[1], best[3])
        since = clock - self.gap_clock if self.gap_clock is not None else None
        return (
            None, gap, forced, self.idx, self.segment, self.row, first, dt, dv, since, *previous, compression, trend if self.trend_fast.n >= 4 else None, micro, momentum, valid,
            accel, accel is not None and self.smooth.n >= 3, drift, local, refill,
        )

    def refill(self, ts: int, dt: float, dv: int, bids: tuple, asks: tuple) -> float | None:
        f = self.cfg.features
        if self.previous is None:
            self.episodes = [None, None]
            return None
        left = math.exp(-LN2 * min(max(dt, 0.0), f.max_dt_ms) / f.refill_half_life_ms)
        for side, ladder in enumerate((bids, asks)):
            self.scores[side] *= left
            episode, held = self.episodes[side], dict(zip(ladder[0][::-1], ladder[1][::-1], strict=True))
            if episode is None:
                paise, before = self.previous[2 * side], self.previous[2 * side + 1]
                drop = before - held.get(paise, 0)
                if before > 0 and drop >= before * f.refill_consumption and dv >= drop * f.refill_volume_confirmation:
                    self.episodes[side] = (paise, before, ts)
                continue
            paise, before, started = episode
            if paise not in held:
                impulse = -f.refill_failure_weight
            elif held[paise] >= before * f.refill_recovery:
                impulse = min(1.0, held[paise] / max(before, 1))
            elif ts - started > f.refill_window_ms:
                impulse = -f.refill_failure_weight
            else:
                continue
            self.episodes[side] = None
            self.scores[side] = max(-1.5, min(1.5, self.scores[side] + impulse))
        return self.scores[0] - self.scores[1]


DECIDE_IN = ["forced", "clock_ms", "dt_ms", "proposed", "feats", "bases", "tradable", "warming", "critical", "entry", "watch", "exit", "ltp_value", "cost_ok", "bid", "ask", "entry_long", "entry_short", "filled_long", "filled_short", "tick", "lot"]
DECIDE_OUT = (
    "regime string, dwell bigint, score double, smoothed double, composite_confidence double, composite_valid boolean, previous_state string, state string, reason string, "
    "direction int, quantity bigint, entry_price double, entry_clock_ms double, stop_price double, target_price double, closed boolean, opened boolean, weights array<double>, confidences array<double>, contributions array<double>"
)
WATCH, OPEN, EXITED = {1: "WATCH_LONG", -1: "WATCH_SHORT"}, {1: "LONG", -1: "SHORT"}, {1: "EXIT_LONG", -1: "EXIT_SHORT"}


@functools.lru_cache
def places(some: tuple[str, ...], names: tuple[str, ...]) -> list[int]:
    return [names.index(n) for n in some if n in names]


def composite(regime: str, feats: list, bases: list, cfg: Engine, names: tuple[str, ...] = DEFAULT.directional, table: dict[str, tuple] = DEFAULT.weights) -> tuple[float, float | None, bool, list, list, list]:
    """Score, confidence (None where no feature has weight), whether they are usable, and each feature's weight, confidence and contribution.

    Invalid features (null) have no weight; collinear ones together have at most their share of the
    total; the score is the mean of values by weight and confidence.
    """
    c = cfg.composite
    weights = [w if x is not None else 0.0 for w, x in zip(table[regime], feats, strict=True)]
    total = sum(weights)
    if total <= 0:
        return 0.0, None, False, weights, [], []
    group = [i for i in places(c.collinear, names) if weights[i] > 0]
    both, allowed = sum([weights[i] for i in group]), c.collinear_cap * total
    if len(group) > 1 and both > allowed:
        for i in group:
            weights[i] *= allowed / both
    trust, least = REGIME_CONFIDENCE[regime], cfg.confidence.min_feature_confidence
    sure = [0.0 if (x := (base or 0.0) * trust) < least else min(1.0, x) for base in bases]
    mass = [w * s for w, s in zip(weights, sure, strict=True)]
    used = [i for i, m in enumerate(mass) if m > 0]
    whole, weighed = sum(mass), sum([weights[i] for i in used])
    confidence = whole / weighed if weighed > 1e-12 else 0.0
    if len(used) < c.min_features or confidence < c.min_confidence:
        return 0.0, confidence, False, weights, sure, []
    parts = [feats[i] * mass[i] / whole if mass[i] > 0 else None for i in range(len(mass))]
    score = sum([feats[i] * mass[i] for i in used]) / whole
    return max(-1.0, min(1.0, score)), confidence, True, weights, sure, parts


class Decider:
    """Holds the regime, smooths the composite, and runs the trading states."""

    def __init__(self, cfg: Engine, names: tuple[str, ...] = DEFAULT.directional, table: dict[str, tuple] = DEFAULT.weights):
        self.cfg, self.names, self.table = cfg, names, table
        self.position: tuple | None = None
        self.restart()

    def restart(self) -> None:
        self.held, self.dwell, self.candidate, self.count = "UNKNOWN", 0, None, 0
        self.smoother = Ema(self.cfg.composite.smoothing_half_life_ms, self.cfg.features.max_dt_ms)
        self.state, self.position = "WARMUP", None
        self.deadline = self.cooldown = 0.0
        self.confirmed, self.confirming, self.blocked = 0, 0, 0

    def regime(self, proposed: str) -> str:
        r = self.cfg.regime
        self.dwell += 1
        if proposed == self.held:
            self.count = 0
        else:
            self.count = self.count + 1 if self.count and proposed == self.candidate else 1
            self.candidate = proposed
            if self.count >= r.confirm and (self.held == "UNKNOWN" or self.dwell >= r.min_dwell):
                self.held, self.dwell, self.count = proposed, 0, 0
        return self.held

    def step(self, forced, clock, dt, proposed, feats, bases, tradable, warming, critical, entry, watch, exit_, ltp, cost_ok, bid, ask, entry_long, entry_short, filled_long, filled_short, tick, lot) -> tuple:
        if forced:
            self.restart()
        raw, confidence, valid, weights, sures, parts = composite(self.regime(proposed), feats, bases, self.cfg, self.names, self.table)
        if valid:
            self.smoother.add(raw, dt)
        smoothed = max(-1.0, min(1.0, self.smoother.value)) if confidence is not None else 0.0
        score, sure = (smoothed, confidence) if valid else (0.0, 0.0)
        sign = (score > 0) - (score < 0)
        if self.blocked and sign != self.blocked:
            self.blocked = 0
        was, held = self.state, self.position
        closed = opened = False
        if held:
            reason = self.leave(held, clock, score, sure, exit_, critical, bid, ask)
            if reason:
                closed = True
                self.state, self.cooldown, self.blocked, self.position, self.confirmed, self.confirming = EXITED[held[0]], clock + self.cfg.state_machine.cooldown_ms, held[0], None, 0, 0
            reason = f"exit: {reason}" if reason else "holding"
        else:
            reason = self.flat(valid, tradable, warming, sign, abs(score), sure, clock, entry, watch, ltp, cost_ok)
            if reason == "entry":
                opened = True
                s = self.cfg.state_machine
                paid, filled = (entry_long, filled_long) if sign > 0 else (entry_short, filled_short)
                grid = lambda p: round(round(p / tick) * tick, 6)
                held = self.position = (sign, filled if filled > 0 else lot, paid, clock, grid(paid - sign * s.stop_ticks * tick), grid(paid + sign * s.target_ticks * tick))
                self.state, self.confirmed = OPEN[sign], 0
        shown = held or (None,) * 6
        return (self.held, self.dwell, raw if valid else 0.0, smoothed, confidence if confidence is not None else 0.0, valid, was, self.state, reason, *shown, closed, opened, weights, sures, parts)

    def leave(self, held: tuple, clock: float, score: float, sure: float, exit_: float, critical: bool, bid: float, ask: float) -> str | None:
        s = self.cfg.state_machine
        side, _, _, since, stop, target = held
        touch = bid if side > 0 else ask
        if side * (touch - stop) <= 1e-7:
            return "stop"
        if clock - since < s.min_hold_ms:
            return None
        if s.use_target and side * (touch - target) >= -1e-7:
            return "target"
        if clock - since >= s.max_hold_ms:
            return "time"
        if score * side <= -exit_ * s.reversal_ratio:
            return "composite reversal"
        if sure < s.exit_confidence:
            return "confidence"
        return "quality" if s.exit_on_quality_loss and critical else None

    def go(self, state: str, reason: str) -> str:
        self.state = state
        return reason

    def flat(self, valid: bool, tradable: bool, warming: bool, sign: int, size: float, sure: float, clock: float, entry: float, watch: float, ltp: float | None, cost_ok: bool) -> str:
        s = self.cfg.state_machine
        if self.state in ("EXIT_LONG", "EXIT_SHORT"):
            return self.go("COOLDOWN", "entering cooldown") if s.cooldown_ms > 0 and clock < self.cooldown else self.go("NEUTRAL", "flat")
        if self.state == "COOLDOWN":
            return self.go("NEUTRAL", "cooldown elapsed") if clock >= self.cooldown else "cooldown active"
        if self.state == "WARMUP":
            return "warming up" if warming else self.go("NEUTRAL", "warmup complete")
        count, self.confirmed = self.confirmed, 0
        if not valid:
            return self.go("NEUTRAL", "composite not usable")
        if not tradable:
            return self.go("NEUTRAL", "blocked")
        if not sign:
            return self.go("NEUTRAL", "no directional score")
        if s.require_zero_cross_rearm and self.blocked == sign:
            return self.go("NEUTRAL", "awaiting zero-cross re-arm after exit")
        if size < watch or sure < s.min_watch_confidence:
            return self.go("NEUTRAL", "below watch")
        if self.state != WATCH[sign]:
            self.deadline, self.confirming = clock + s.watch_timeout_ms, sign
            return self.go(WATCH[sign], "watch armed")
        if clock > self.deadline:
            return self.go("NEUTRAL", "watch expired")
        if size < entry:
            return "score below entry"
        if sure < s.min_entry_confidence:
            return "confidence below entry"
        if s.require_ltp_confirmation:
            if ltp is None:
                return "awaiting traded-price confirmation"
            if ltp * sign <= -self.cfg.features.ltp_opposition:
                return "traded price contradicts"
        if not cost_ok:
            return "cost gate"
        self.confirmed = count + 1 if self.confirming == sign else 1
        self.confirming = sign
        return "entry" if self.confirmed >= s.entry_confirmations else f"confirming {self.confirmed}/{s.entry_confirmations}"


def dealt(df: DataFrame, cfg: Engine, order: str = "seq") -> tuple[DataFrame, int | None]:
    """df in stretches that start where an Admission does, and how many tasks they want."""
    best = {"bid_paise": ("bids", "price_paise"), "ask_paise": ("asks", "price_paise"), "bid_size": ("bids", "quantity"), "ask_size": ("asks", "quantity")}
    return stretched(df, [F.get(best[c][0], 0)[best[c][1]] if c in best else c for c in ADMISSION_IN], lambda: Admission(cfg), order, counted=True)


def sequenced(df: DataFrame, cfg: Engine, order: str = "seq", tasks: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Every row with SEQUENCE_OUT; the columns of rejected rows are null but for their reason. columns: those of df that are wanted, where not all are."""
    if STRETCH not in df.columns:
        df, tasks = dealt(df, cfg, order)
    names = [x.split(" ")[0] for x in SEQUENCE_OUT.split(", ")]
    out = run_ordered(df, order, SEQUENCE_IN, SEQUENCE_OUT, lambda saved: Sequencer(cfg, saved), lambda s, *x: s.step(*x), by=STRETCH, resume=f"{RESUME}.state", tasks=tasks, columns=None if columns is None else [*columns, *names])
    level = lambda side: F.when(F.col(f"prev_{side}_paise").isNotNull(), F.struct(F.col(f"prev_{side}_paise").alias("price_paise"), F.col(f"prev_{side}_qty").alias("quantity"))).alias(f"prev_{side}")
    flat = [F.col(c).alias("row" if c == "row_no" else c) for c in names if not c.startswith("prev_")]
    return out.select("row.*", *flat, level("bid"), level("ask")).drop(STRETCH, RESUME)


def decided(df: DataFrame, cfg: Engine, registry: Registry = DEFAULT, tasks: int | None = None, in_order: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Rows with DECIDE_OUT. A Decider starts afresh with each segment, so segments are dealt, not tokens. in_order, columns: see `run_ordered`."""
    names, table = registry.directional, registry.weights
    out = run_ordered(df, "idx", DECIDE_IN, DECIDE_OUT, lambda: Decider(cfg, names, table), lambda s, *x: s.step(*x), "scored", by="segment", tasks=tasks, in_order=in_order, columns=columns)
    return out.select("scored.*", *(x for x in out.columns if x != "scored"))
