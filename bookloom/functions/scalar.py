"""Scalar building blocks of the order-book engine, as Columns (nothing here leaves the JVM)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12
LN2 = math.log(2.0)


def col(x: Column | str | float | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x, low: float, high: float) -> Column:
    """x within the bounds; null stays null, which least and greatest alone would pass over."""
    if low > high:
        raise ValueError(f"clamp bounds are inverted: {low} > {high}")
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def clamp_unit(x) -> Column:
    return clamp(x, -1.0, 1.0)


def safe_div(n, d, default: float = 0.0) -> Column:
    """n / d, or the default where d is (nearly) zero; null where either is null."""
    n, d = col(n), col(d)
    return F.when(F.abs(d) < EPSILON, F.when(n.isNotNull(), F.lit(float(default)))).otherwise(n / F.when(F.abs(d) >= EPSILON, d))


def sign(x, deadband: float = 0.0) -> Column:
    return F.when(col(x) > deadband, 1).when(col(x) < -deadband, -1).otherwise(0)


def to_ticks(price, tick) -> Column:
    return safe_div(price, col(tick))


def from_ticks(ticks, tick) -> Column:
    return col(ticks) * col(tick)


def bps_to_ticks(bps, mid, tick) -> Column:
    return safe_div(col(bps) / 10_000.0 * col(mid), col(tick))


def ticks_to_bps(ticks, mid, tick) -> Column:
    return safe_div(col(ticks) * col(tick) * 10_000.0, mid)


def ema_alpha(dt, half_life: float, most_dt: float) -> Column:
    """How much of a new sample an average with this half-life takes after dt ms; 0 at dt = 0."""
    return 1 - F.exp(-LN2 * clamp(dt, 0.0, most_dt) / float(half_life))


def tanh_scale(x, scale: float) -> Column:
    return F.tanh(col(x) / float(scale))


def robust_scale(x, dispersion, floor: float, k: float) -> Column:
    return F.tanh(col(x) / (F.greatest(col(dispersion), F.lit(float(floor))) * float(k)))


def linear_scale(x, low: float, high: float) -> Column:
    """0 at low, 1 at high, straight between, flat outside."""
    return clamp((col(x) - float(low)) / (float(high) - float(low)), 0.0, 1.0)


def log_ratio(n, d, offset: float = 1.0) -> Column:
    zero = F.lit(0.0)
    return F.ln((F.greatest(col(n), zero) + offset) / (F.greatest(col(d), zero) + offset))


def round_to_tick(price, tick) -> Column:
    """The nearest multiple of the tick, halves to even, at 6 decimals."""
    return F.bround(F.rint(col(price) / col(tick)) * col(tick), 6)


def is_tick_aligned(price, tick, tolerance: float = 1e-6) -> Column:
    steps = col(price) / col(tick)
    return F.abs(steps - F.rint(steps)) <= tolerance


def exchange_time(ms, zone: str = "Asia/Kolkata") -> Column:
    """HH:MM:SS.mmm at the exchange, dashes for times that aren't positive."""
    local = F.from_utc_timestamp(F.timestamp_millis(col(ms)), zone)
    return F.when(col(ms) > 0, F.date_format(local, "HH:mm:ss.SSS")).otherwise("--:--:--.---")


def score_bar(score, threshold, half: int = 12) -> Column:
    """A gauge of a score in [-1, 1]: a middle line, bars where the entry threshold lies on both sides, and blocks from the middle out to the score, over all."""
    x = col(score)
    filled, mark = F.rint(F.least(F.abs(x), F.lit(1.0)) * half), F.least(F.lit(float(half)), F.greatest(F.lit(1.0), F.rint(col(threshold) * half)))
    out = lambda i: F.when(x >= 0, i).otherwise(-i)
    cell = lambda i: F.when((out(i) >= 1) & (out(i) <= filled), "█").when(F.abs(i) == mark, "|").when(i == 0, "┃").otherwise("·")
    return F.array_join(F.transform(F.sequence(F.lit(-half), F.lit(half)), cell), "")


def average_order_size(level) -> Column:
    """A level's quantity by its orders, 0 without orders."""
    level = col(level)
    return F.when(level["orders"] > 0, level["quantity"] / F.when(level["orders"] > 0, level["orders"])).otherwise(0.0)


def redacted(text) -> Column:
    """Text with the values of secret-looking fields and bearer tokens masked."""
    masked = F.regexp_replace(col(text), r"(?i)((?:api[_-]?key|password|pin|totp|token|secret|jwt)\w*[\"']?\s*[:=]\s*[\"']?)[^\s\"',}]+", "$1***")
    return F.regexp_replace(masked, r"(?i)(bearer\s+)\S+", "$1***")


def apart(c: str) -> Column:
    """A column as it is, by way of a lambda, for which Spark compiles each expression of the projection apart instead of all as one method (HotSpot leaves methods of over 8000 bytes uncompiled)."""
    return F.get(F.transform(F.array(c), lambda x: x), 0).alias(c)
