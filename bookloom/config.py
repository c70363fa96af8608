"""Settings of the order-book engine: frozen dataclasses with strict loading from mappings or JSON."""

from __future__ import annotations

import dataclasses
import json
import math
import os
import types
import typing
from collections.abc import Mapping
from dataclasses import dataclass, field

FEATURES = ("spread", "spread_compression", "microprice", "weighted_obi", "depth_slope", "queue_persistence", "refill", "momentum", "acceleration", "ltp_confirmation")
DIRECTIONAL = FEATURES[2:]
REGIMES = ("TREND", "PULLBACK", "RANGE", "NOISE", "UNKNOWN")
FACTORS = ("spread", "liquidity", "volatility", "book_quality", "stability", "warmup")

# Default weights by regime, in the order of DIRECTIONAL.
WEIGHTS = {
    "TREND": (0.08, 0.20, 0.08, 0.06, 0.12, 0.22, 0.12, 0.12),
    "PULLBACK": (0.12, 0.20, 0.08, 0.10, 0.16, 0.14, 0.08, 0.12),
    "RANGE": (0.20, 0.24, 0.12, 0.12, 0.10, 0.08, 0.04, 0.10),
    "NOISE": (0.16, 0.20, 0.10, 0.12, 0.12, 0.12, 0.06, 0.12),
    "UNKNOWN": (0.18, 0.22, 0.10, 0.10, 0.10, 0.12, 0.06, 0.12),
}
# Exponents of FACTORS for each directional feature.
SENSITIVITY = {
    "microprice": (1.6, 1.0, 0.4, 1.0, 0.3, 1.0),
    "weighted_obi": (1.0, 1.4, 0.5, 1.0, 0.4, 1.0),
    "depth_slope": (0.8, 1.6, 0.5, 1.0, 0.5, 1.0),
    "queue_persistence": (0.6, 1.0, 0.8, 1.0, 1.2, 1.4),
    "refill": (0.8, 1.2, 0.6, 1.0, 0.8, 1.2),
    "momentum": (0.6, 0.8, 0.9, 1.0, 1.0, 1.6),
    "acceleration": (0.5, 0.7, 1.3, 1.0, 1.2, 1.8),
    "ltp_confirmation": (0.9, 0.6, 0.7, 1.0, 0.6, 1.0),
}
# How much each regime trusts features.
REGIME_CONFIDENCE = {"TREND": 1.0, "PULLBACK": 0.85, "RANGE": 0.95, "NOISE": 0.45, "UNKNOWN": 0.5}


# The defaults of all settings below.
@dataclass(frozen=True)
class Symbol:
    token: str
    symbol: str = ""
    exchange_type: int = 1
    tick_size: float = 0.05
    quantity: int = 1


@dataclass(frozen=True)
class Validation:
    max_spread_ticks: float = 25.0
    max_snapshot_gap_ms: float = 3000.0
    max_staleness_ms: float = 8000.0
    max_price_gap_ticks: float = 40.0
    min_price: float = 0.01
    require_tick_alignment: bool = False
    allow_locked_book: bool = False
    reject_duplicates: bool = True
    require_ltp: bool = True
    #: After a stale reject every later row is stale too; True lets the next row start afresh instead.
    stale_recovery: bool = False


@dataclass(frozen=True)
class Quality:
    max_signal_spread_ticks: float = 4.0
    min_depth_levels: int = 2
    min_top_quantity: int = 0
    min_relative_depth: float = 0.35
    min_orders_per_level: int = 1
    gap_block_ms: float = 2000.0
    warmup_snapshots: int = 60


@dataclass(frozen=True)
class Features:
    max_dt_ms: float = 5000.0
    microprice_half_life_ms: float = 200.0
    obi_decay_ticks: float = 2.5
    obi_primary_levels: int = 2
    obi_deep_levels: int = 5
    obi_deep_weight: float = 0.35
    obi_aggregate_weight: float = 0.20
    obi_aggregate_max_ratio: float = 12.0
    slope_scale: float = 0.9
    slope_use_deep_levels: bool = True
    spread_tight_ticks: float = 1.0
    spread_wide_ticks: float = 6.0
    compression_fast_ms: float = 500.0
    compression_slow_ms: float = 4000.0
    compression_scale_ticks: float = 0.5
    persistence_window: int = 40
    persistence_tolerance: float = 0.15
    persistence_min_samples: int = 10
    momentum_fast_ms: float = 600.0
    momentum_slow_ms: float = 3000.0
    dispersion_window: int = 120
    momentum_floor: float = 0.02
    momentum_k: float = 2.0
    momentum_warmup: int = 6
    acceleration_floor: float = 0.05
    acceleration_k: float = 2.0
    acceleration_min_dt_ms: float = 20.0
    acceleration_half_life_ms: float = 500.0
    refill_consumption: float = 0.35
    refill_recovery: float = 0.60
    refill_window_ms: float = 1500.0
    refill_volume_confirmation: float = 0.50
    refill_half_life_ms: float = 800.0
    refill_failure_weight: float = 0.60
    ltp_half_life_ms: float = 1200.0
    ltp_scale_ticks: float = 1.5
    ltp_stale_ms: float = 3000.0
    ltp_opposition: float = 0.35
    ltp_position_weight: float = 0.5


@dataclass(frozen=True)
class Confidence:
    liquidity_window: int = 240
    volatility_window: int = 240
    volatility_tolerance: float = 2.0
    stability_window: int = 60
    min_feature_confidence: float = 0.02


@dataclass(frozen=True)
class Regime:
    window: int = 90
    fast_half_life_ms: float = 1500.0
    slow_half_life_ms: float = 8000.0
    er_trend: float = 0.45
    er_range: float = 0.25
    vol_high_ticks: float = 2.5
    trend_min_ticks: float = 1.0
    pullback_min_er: float = 0.30
    min_dwell: int = 8
    confirm: int = 3
    min_samples: int = 30


@dataclass(frozen=True)
class Composite:
    smoothing_half_life_ms: float = 700.0
    min_features: int = 3
    min_confidence: float = 0.15
    collinear_cap: float = 0.30
    collinear: tuple[str, ...] = ("microprice", "weighted_obi")


@dataclass(frozen=True)
class Threshold:
    base: float = 0.30
    spread_coefficient: float = 0.45
    mid_coefficient: float = 0.40
    obi_coefficient: float = 0.35
    instability_coefficient: float = 0.30
    min_entry: float = 0.18
    max_entry: float = 0.85
    watch_ratio: float = 0.6
    exit_ratio: float = 0.5
    reference_window: int = 240
    imbalance_reference: float = 0.25


@dataclass(frozen=True)
class StateMachine:
    watch_timeout_ms: float = 2500.0
    entry_confirmations: int = 2
    min_watch_confidence: float = 0.35
    min_entry_confidence: float = 0.55
    exit_confidence: float = 0.25
    min_hold_ms: float = 250.0
    max_hold_ms: float = 60_000.0
    cooldown_ms: float = 1500.0
    stop_ticks: float = 6.0
    target_ticks: float = 12.0
    reversal_ratio: float = 0.6
    require_ltp_confirmation: bool = True
    require_zero_cross_rearm: bool = True
    exit_on_quality_loss: bool = True
    use_target: bool = True


@dataclass(frozen=True)
class Execution:
    entry_aggression_bps: float = 3.0
    entry_aggression_ticks: float | None = None
    exit_slippage_bps: float = 1.0
    exit_slippage_ticks: float | None = None
    use_depth_walk: bool = False
    enforce_cost_gate: bool = False
    min_edge_multiple: float = 1.5
    brokerage_flat: float = 20.0
    brokerage_rate: float = 3e-4
    brokerage_cap: float = 20.0
    exchange_rate: float = 2.97e-5
    stt_sell_rate: float = 2.5e-4
    stamp_buy_rate: float = 3e-5
    sebi_rate: float = 1e-6
    gst_rate: float = 0.18


@dataclass(frozen=True)
class Engine:
    symbols: tuple[Symbol, ...] = ()
    validation: Validation = field(default_factory=Validation)
    quality: Quality = field(default_factory=Quality)
    features: Features = field(default_factory=Features)
    confidence: Confidence = field(default_factory=Confidence)
    regime: Regime = field(default_factory=Regime)
    composite: Composite = field(default_factory=Composite)
    threshold: Threshold = field(default_factory=Threshold)
    state_machine: StateMachine = field(default_factory=StateMachine)
    execution: Execution = field(default_factory=Execution)
    tick_size: float = 0.05
    quantity: int = 1


#: Ranges of numeric settings by the ends of their names, the first that fits: (least, most, whether the least itself is allowed).
RANGES = (
    (("volatility_tolerance",), 0, math.inf, False), (("max_ratio",), 1, math.inf, True), (("depth_levels", "primary_levels"), 1, 5, True), (("deep_levels",), 3, 5, True), (("regime.window",), 4, math.inf, True), (("_window",), 2, math.inf, True), (("_half_life_ms", "_scale", "_scale_ticks", "_decay_ticks", "tick_size", "_k"), 0, math.inf, False),
    (("confidence", "tolerance", "_ratio", "consumption", "er_trend", "er_range", "min_er", "_entry", "collinear_cap", "opposition", "_weight", "relative_depth", "_rate"), 0, 1, True), 
    (("entry_confirmations", "confirm", "min_dwell", "min_features", "warmup_snapshots", "momentum_warmup", "min_samples", ".quantity"), 1, math.inf, True), (("_aggression_ticks", "_slippage_ticks"), -math.inf, math.inf, True), (("",), 0, math.inf, True),
)
#: Pairs of settings of which the first must not be above the second; for those whose first is in STRICT it must be below.
ORDERED = {
    "Features": (("spread_tight_ticks", "spread_wide_ticks"), ("compression_fast_ms", "compression_slow_ms"), ("momentum_fast_ms", "momentum_slow_ms"), ("persistence_min_samples", "persistence_window"), ("obi_primary_levels", "obi_deep_levels")),
    "Regime": (("fast_half_life_ms", "slow_half_life_ms"), ("er_range", "er_trend"), ("min_samples", "window")),
    "Threshold": (("min_entry", "base"), ("base", "max_entry"), ("exit_ratio", "watch_ratio")),
    "StateMachine": (("exit_confidence", "min_watch_confidence"), ("min_watch_confidence", "min_entry_confidence"), ("min_hold_ms", "max_hold_ms")),
    "Validation": (("max_snapshot_gap_ms", "max_staleness_ms"),),
}


STRICT = {"spread_tight_ticks", "compression_fast_ms", "momentum_fast_ms", "fast_half_life_ms", "er_range"}


def checked(settings, where: str):
    """settings, if its numbers are within RANGES and its pairs in order; else a ValueError that names the setting."""
    for f in dataclasses.fields(settings):
        v, name = getattr(settings, f.name), f"{type(settings).__name__.lower()}.{f.name}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            low, high, closed = next((low, high, closed) for ends, low, high, closed in RANGES if any(name.endswith(e) for e in ends))
            if not (low <= v <= high) or v == low and not closed or v != v:
                raise ValueError(f"{where}.{f.name}: {v} is not in {'[' if closed else '('}{low}, {high}]")
    for low, high in ORDERED.get(type(settings).__name__, ()):
        first, second = getattr(settings, low), getattr(settings, high)
        if first > second or first == second and low in STRICT:
            raise ValueError(f"{where}: {low} is not below {high}" if low in STRICT else f"{where}: {low} is above {high}")
    if isinstance(settings, Symbol) and not settings.token.strip():
        raise ValueError(f"{where}: a token is blank")
    tokens = [s.token for s in getattr(settings, "symbols", ())]
    if len(tokens) != len(set(tokens)):
        raise ValueError(f"{where}: a token is listed twice")
    return settings


def build(kind: type, values: Mapping, where: str = "config"):
    """A settings object from a mapping: unknown keys, wrong types, nulls where none are allowed and numbers out of range are errors."""
    hints = typing.get_type_hints(kind)
    if unknown := set(values) - set(hints):
        raise ValueError(f"{where}: unknown keys {sorted(unknown)}")
    return checked(kind(**{k: coerced(v, hints[k], f"{where}.{k}") for k, v in values.items()}), where)


def coerced(value, hint, where: str):
    if isinstance(hint, types.UnionType):
        if value is None and type(None) in hint.__args__:
            return None
        return coerced(value, next(t for t in hint.__args__ if t is not type(None)), where)
    if dataclasses.is_dataclass(hint):
        if not isinstance(value, Mapping):
            raise ValueError(f"{where}: a mapping is needed")
        return build(hint, value, where)
    if typing.get_origin(hint) is tuple:
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{where}: a list is needed")
        return tuple(coerced(v, typing.get_args(hint)[0], f"{where}[{i}]") for i, v in enumerate(value))
    if hint is bool and isinstance(value, bool) or hint is str and isinstance(value, str):
        return value
    if hint in (int, float) and isinstance(value, (int, float)) and not isinstance(value, bool) and (hint is float or float(value).is_integer()):
        return hint(value)
    raise ValueError(f"{where}: {value!r} is not a {getattr(hint, '__name__', hint)}")


def load(path: str, environment: Mapping[str, str] | None = None) -> Engine:
    """An engine's settings from a JSON file; BOOKLOOM_TICK_SIZE and BOOKLOOM_QUANTITY in the environment override it."""
    values = json.load(open(path, encoding="utf-8"))
    environment = os.environ if environment is None else environment
    for name, kind in (("tick_size", float), ("quantity", int)):
        if text := environment.get(f"BOOKLOOM_{name.upper()}"):
            values[name] = kind(text)
    return build(Engine, values)
