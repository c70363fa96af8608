"""Rolling statistics row by row: what `windows.shared_statistics` gives by window frames, for a stream.

A frame is a ring of the last rows' values, nulls included, with Welford sums that a value enters and leaves; the sums
are made anew after each turn of the ring, so that no error builds up. Minima and maxima are monotonic deques. A
token's frames are of fixed sizes and are kept as typed arrays between micro-batches.
"""

from __future__ import annotations

import math
from collections import deque

from bookloom.config import Engine


class Frame:
    """The last `size` rows of a segment: counts, mean, deviation and total of the values that are not null."""

    __slots__ = ("age", "m2", "mean", "n", "size", "total", "values")

    def __init__(self, size: int, values: list | None = None):
        self.size, self.values = size, deque(values or ())
        self.settle()

    def settle(self) -> None:
        """Makes the sums anew from the ring."""
        known = [x for x in self.values if x is not None]
        self.n, self.age, self.total = len(known), 0, math.fsum(known)
        self.mean = self.total / self.n if self.n else 0.0
        self.m2 = math.fsum((x - self.mean) ** 2 for x in known)

    def add(self, x: float | None) -> None:
        self.values.append(x)
        if x is not None:
            self.n += 1
            d = x - self.mean
            self.mean += d / self.n
            self.m2 += d * (x - self.mean)
            self.total += x
        if len(self.values) > self.size:
            old = self.values.popleft()
            if old is not None:
                self.n -= 1
                if self.n:
                    d = old - self.mean
                    self.mean -= d / self.n
                    self.m2 -= d * (old - self.mean)
                    self.total -= old
            self.age += 1
            if self.age >= self.size or not self.n:
                self.settle()

    def sd(self) -> float:
        return math.sqrt(max(self.m2 / (self.n - 1), 0.0)) if self.n > 1 else 0.0


class Extremes:
    """The least and greatest of the last `size` values, by deques whose values only rise or only fall."""

    __slots__ = ("count", "high", "low", "size")

    def __init__(self, size: int, values: list | None = None):
        self.size, self.count, self.low, self.high = size, 0, deque(), deque()
        for x in values or ():
            self.add(x)

    def add(self, x: float) -> None:
        for held, worse in ((self.low, lambda y: y >= x), (self.high, lambda y: y <= x)):
            while held and worse(held[-1][1]):
                held.pop()
            held.append((self.count, x))
            if held[0][0] <= self.count - self.size:
                held.popleft()
        self.count += 1

    def spread(self) -> float:
        return self.high[0][1] - self.low[0][1]


class Statistics:
    """A token's shared statistics over its segment, in the order of OUT."""

    OUT = (
        "mid_volatility double, mid_ready boolean, spread_mean double, spread_sd double, spread_ready boolean, spread_range double, relative_depth double, depth_ready boolean, touch_stability double, mean_traded double, "
        "obi_sd double, efficiency_ratio double, warmup_ratio double, persistence_value double, momentum_sd double, acceleration_sd double"
    )
    NAMES = ("moves", "spreads", "depths", "still", "traded", "obi", "mids", "paths", "bids_kept", "asks_kept", "momentum", "acceleration")

    def __init__(self, cfg: Engine, rings: list[list] | None = None):
        c, t, r, f = cfg.confidence, cfg.threshold, cfg.regime, cfg.features
        sizes = (c.volatility_window, t.reference_window, c.liquidity_window, c.stability_window, c.liquidity_window, t.reference_window, r.window, r.window, f.persistence_window, f.persistence_window, f.dispersion_window, f.dispersion_window)
        self.cfg, rings = cfg, rings or [[]] * len(sizes)
        self.frames = {n: Frame(s, x) for n, s, x in zip(self.NAMES, sizes, rings, strict=True)}
        self.extremes = Extremes(c.stability_window, self.frames["spreads"].values if t.reference_window >= c.stability_window else None)

    def rings(self) -> list[list]:
        return [list(self.frames[n].values) for n in self.NAMES]

    def row(self, row: int, first: bool, mid_ticks: float, spread_ticks: float, depth: float, obi: float | None, delta_volume: int, tick: float, previous: tuple, bids: list, bid_sizes: list, asks: list, ask_sizes: list, momentum: float | None, acceleration: float | None) -> tuple:
        f, cfg = self.frames, self.cfg
        before = f["mids"].values[-1] if f["mids"].values else None
        move = mid_ticks - before if not first and row > 1 and before is not None else None
        step = max(1.0, float(round(tick * 100)))
        bid, bid_size, ask, ask_size = previous
        near = lambda now, then: abs(now - (then or 0)) <= step
        past_obi = f["obi"].sd() if f["obi"].n >= 2 else 0.0
        past = [f[n].sd() if f[n].n >= 8 else 0.0 for n in ("momentum", "acceleration")]

        def kept(price: int | None, size: int | None, prices: list, sizes: list) -> float | None:
            if price is None:
                return None
            now = next((s for p, s in zip(prices, sizes, strict=True) if p == price), 0)
            return float(now >= size * (1 - cfg.features.persistence_tolerance))

        for name, x in (
            ("moves", move), ("spreads", spread_ticks), ("depths", math.log1p(depth)), ("still", None if first else float(near(bids[0], bid) and near(asks[0], ask))), ("traded", None if first else float(max(delta_volume, 0))), ("obi", obi),
            ("mids", mid_ticks), ("paths", None if move is None else abs(move)), ("bids_kept", kept(bid, bid_size, bids, bid_sizes)), ("asks_kept", kept(ask, ask_size, asks, ask_sizes)), ("momentum", momentum), ("acceleration", acceleration),
        ):
            f[name].add(x)
        self.extremes.add(spread_ticks)
        path, reference = f["paths"].total, math.expm1(f["depths"].mean)
        ready = f["mids"].n >= 3 and f["paths"].n >= 2 and path > 0
        enough = f["depths"].n >= 8 and reference > 0
        persistence = f["bids_kept"].mean - f["asks_kept"].mean
        return (
            f["moves"].sd(), f["moves"].n >= 8, f["spreads"].mean, f["spreads"].sd(), f["spreads"].n >= 8, self.extremes.spread(), depth / reference if enough else 1.0, f["depths"].n >= 8, f["still"].mean if f["still"].n >= 4 else 0.5,
            f["traded"].mean if f["traded"].n else None, past_obi, min(abs(mid_ticks - f["mids"].values[0]) / path, 1.0) if ready else 0.0, min(row / cfg.quality.warmup_snapshots, 1.0),
            max(-1.0, min(1.0, persistence)) if bid is not None and f["bids_kept"].n >= cfg.features.persistence_min_samples else None, *past,
        )
