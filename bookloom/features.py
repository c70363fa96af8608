"""The feature contract: features are nodes of a dependency graph, each a Column builder or a small kernel.

A feature by Columns gives its value from a row's columns (the snapshot, the windows over it, and the features it
depends on). A feature by a kernel has a state for each token, which a step function carries from row to row and
which starts afresh after every gap. A registry sorts features so that each comes after what it depends on, and knows
their weights by regime and their sensitivities to the factors of confidence. Values are null where a feature
can't tell; a null value has no part in the composite, unlike a zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookloom.config import DIRECTIONAL, FACTORS, REGIMES, SENSITIVITY, WEIGHTS, Engine
from bookloom.functions.scalar import clamp, clamp_unit, linear_scale, robust_scale, safe_div

# How features are named in reasons.
LABELS = dict(
    microprice="Microprice tilt", weighted_obi="Order-book imbalance", depth_slope="Depth asymmetry", queue_persistence="Queue persistence",
    refill="Refill activity", momentum="Pressure momentum", acceleration="Pressure acceleration", ltp_confirmation="Traded-price confirmation",
)


@dataclass(frozen=True)
class Feature:
    """One feature.

    value and confidence build Columns from settings: the value, in [-1, 1] for a directional feature, and how far it is
    to be trusted by itself, in [0, 1] (1 if not given). Instead of value, a feature by a kernel has start(settings),
    the state of a token, and step(state, dt_ms, *inputs) -> (value, confidence); inputs are Columns or names of columns,
    or of features it depends on. A quality feature is computed and has no part in the composite. reads: the columns of a
    snapshot and of `book.local_features` that it reads, if they are told; else it may read any.
    """

    name: str
    value: Callable[[Engine], Column] | None = None
    confidence: Callable[[Engine], Column] | None = None
    depends_on: tuple[str, ...] = ()
    start: Callable[[Engine], Any] | None = None
    step: Callable[..., tuple[float | None, float]] | None = None
    inputs: tuple[str | Column, ...] = ()
    directional: bool = True
    sensitivity: tuple[float, ...] = (1.0,) * len(FACTORS)
    weights: Mapping[str, float] = field(default_factory=dict)
    label: str = ""
    reads: tuple[str, ...] | None = None

    @property
    def sequential(self) -> bool:
        return self.step is not None


def feature(name: str) -> Column:
    """Another feature's value, for features that depend on it."""
    return F.col(f"feat_{name}")


class Registry:
    """Features in an order in which each comes after those it depends on.

    weights: {regime: {feature: weight}} replaces the features' own weights for the regimes that it names; regimes that
    have no weight at all use UNKNOWN's. strict: the given order must hold already, instead of being sorted.
    """

    def __init__(self, features: Iterable[Feature], weights: Mapping[str, Mapping[str, float]] | None = None, strict: bool = False):
        given = tuple(features)
        if not given:
            raise ValueError("a registry needs a feature")
        by: dict[str, Feature] = {}
        for f in given:
            if not f.name.isidentifier():
                raise ValueError(f"a feature's name must be an identifier: {f.name!r}")
            if f.name in by:
                raise ValueError(f"duplicate feature name: {f.name}")
            if (f.value is None) == (f.step is None) or (f.step is None) != (f.start is None):
                raise ValueError(f"feature {f.name!r} needs either value, or start and step")
            if len(f.sensitivity) != len(FACTORS):
                raise ValueError(f"feature {f.name!r} needs a sensitivity for each of {FACTORS}")
            by[f.name] = f
        for f in given:
            if missing := [d for d in f.depends_on if d not in by]:
                raise ValueError(f"feature {f.name!r} depends on {missing}, which are not registered")
        self.features = given if strict else self._sorted(by)
        seen: set[str] = set()
        for f in self.features:
            if late := [d for d in f.depends_on if d not in seen]:
                raise ValueError(f"feature {f.name!r} depends on {late}, which are not evaluated before it")
            seen.add(f.name)
        self.directional = tuple(f.name for f in self.features if f.directional)
        self.sensitivity = {f.name: tuple(f.sensitivity) for f in self.features}
        self.labels = {f.name: f.label or f.name for f in self.features}
        self.weights = self._weights(weights or {})

    @staticmethod
    def _sorted(by: dict[str, Feature]) -> tuple[Feature, ...]:
        """Depth first in the given order, so that features without dependencies keep it."""
        out: dict[str, Feature] = {}
        for first in by:
            path, stack = {first}, [(first, iter(by[first].depends_on))]
            while stack:
                name, rest = stack[-1]
                if name in out or (then := next((d for d in rest if d not in out), None)) is None:
                    out.setdefault(name, by[name])
                    path.discard(name)
                    stack.pop()
                elif then in path:
                    raise ValueError(f"features depend on each other: {' -> '.join([*(n for n, _ in stack), then])}")
                else:
                    path.add(then)
                    stack.append((then, iter(by[then].depends_on)))
        return tuple(out.values())

    def _weights(self, given: Mapping[str, Mapping[str, float]]) -> dict[str, tuple[float, ...]]:
        of = {f.name: f for f in self.features}
        table = {}
        for regime in REGIMES:
            row = given[regime] if regime in given else {n: of[n].weights.get(regime, 0.0) for n in self.directional}
            if unknown := set(row) - set(self.directional):
                raise ValueError(f"weights of {regime} name {sorted(unknown)}, which are no directional features")
            if any(not 0 <= w <= 10 for w in row.values()):
                raise ValueError(f"weights of {regime} must lie between 0 and 10")
            table[regime] = tuple(float(row.get(n, 0.0)) for n in self.directional)
        return {r: w if any(w) else table["UNKNOWN"] for r, w in table.items()}

    def layers(self) -> list[tuple[bool, list[Feature]]]:
        """Stretches of features that can be computed at once: by Columns (False) or in one pass of kernels (True). Features by Columns that depend on each other are in different stretches, as are kernels and what they depend on."""
        found: list[tuple[bool, list[Feature]]] = []
        depth: dict[str, int] = {}
        for f in self.features:
            at = max((depth[d] + 1 for d in f.depends_on), default=0)
            while at < len(found) and found[at][0] != f.sequential:
                at += 1
            if at == len(found):
                found.append((f.sequential, []))
            found[at][1].append(f)
            depth[f.name] = at
        return found

    def __add__(self, more: Iterable[Feature]) -> Registry:
        return Registry((*self.features, *more))


#: What the library's own features read of a snapshot; the rest is what kernels and windows make of it.
READS = ("spread_ticks", "spread", "mid", "last_traded_price", "obi", "obi_local", "slope_value", "slope_local")


def _built_in(name: str, value: Callable[[Engine], Column], confidence: Callable[[Engine], Column] | None = None, depends_on: tuple[str, ...] = (), directional: bool = True) -> Feature:
    if not directional:
        return Feature(name, value, confidence, depends_on, directional=False, reads=READS)
    at = DIRECTIONAL.index(name)
    return Feature(name, value, confidence, depends_on, sensitivity=SENSITIVITY[name], weights={r: w[at] for r, w in WEIGHTS.items()}, label=LABELS[name], reads=READS)


def _scaled(name: str):
    def build(cfg: Engine) -> Column:
        f = cfg.features
        return F.when(F.col(f"{name}_valid"), robust_scale(name, f"{name}_sd", getattr(f, f"{name}_floor"), getattr(f, f"{name}_k")))

    return build


def _confirmed(cfg: Engine) -> Column:
    """How far trades have drifted from their own average, and on which side of the mid the last one was."""
    f, half = cfg.features, F.when(F.col("spread") > 0, F.col("spread") * 0.5)
    position = clamp_unit(safe_div(F.col("last_traded_price") - F.col("mid"), half))
    return F.when(F.col("ltp_drift").isNotNull(), clamp_unit((1 - f.ltp_position_weight) * F.tanh(F.col("ltp_drift") / f.ltp_scale_ticks) + f.ltp_position_weight * position))


#: The library's own features.
BUILT_IN = (
    _built_in("spread", lambda cfg: linear_scale(-F.col("spread_ticks"), -cfg.features.spread_wide_ticks, -cfg.features.spread_tight_ticks), directional=False),
    _built_in("spread_compression", lambda cfg: clamp(0.5 * (1 + F.tanh(F.col("compression") / cfg.features.compression_scale_ticks)), 0, 1), directional=False),
    _built_in("microprice", lambda cfg: F.col("micro")),
    _built_in("weighted_obi", lambda cfg: F.col("obi"), lambda cfg: F.col("obi_local")),
    _built_in("depth_slope", lambda cfg: F.col("slope_value"), lambda cfg: F.col("slope_local")),
    _built_in("queue_persistence", lambda cfg: F.col("persistence_value")),
    _built_in("refill", lambda cfg: clamp_unit("refill")),
    _built_in("momentum", _scaled("momentum"), depends_on=("weighted_obi",)),
    _built_in("acceleration", _scaled("acceleration"), depends_on=("momentum",)),
    _built_in("ltp_confirmation", _confirmed, lambda cfg: F.col("ltp_local")),
)
DEFAULT = Registry(BUILT_IN)
