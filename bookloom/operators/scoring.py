"""Feature values, market quality, confidence, threshold, regime proposal and reasons, as Columns."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.config import FACTORS, Engine
from bookloom.features import DEFAULT, Registry
from bookloom.functions.scalar import EPSILON, clamp, linear_scale, sign
from bookloom.operators.execution import ExecutionModel, TOUCH
from bookloom.operators.kernel import run_ordered
from bookloom.operators.windows import rolling_sd, samples


def dispersions(df: DataFrame, cfg: Engine) -> DataFrame:
    """Adds momentum_sd and acceleration_sd, over the rows before."""
    past = lambda x: F.when(samples(x, cfg.features.dispersion_window, True) >= 8, rolling_sd(x, cfg.features.dispersion_window, True)).otherwise(0.0)
    return df.select("*", past("momentum").alias("momentum_sd"), past("acceleration").alias("acceleration_sd"))


class Kernels:
    """The kernel features of one layer over one token's rows; all start afresh where the stream does."""

    def __init__(self, features: list, cfg: Engine):
        self.parts, self.cfg = [(f.start, f.step, len(f.inputs)) for f in features], cfg
        self.states = [start(cfg) for start, _, _ in self.parts]

    def step(self, forced: bool, dt: float, *inputs) -> tuple:
        if forced:
            self.states = [start(self.cfg) for start, _, _ in self.parts]
        out, at = [], 0
        for (_, step, n), state in zip(self.parts, self.states, strict=True):
            value, sure = step(state, dt, *inputs[at : at + n])
            out += [value, None if value is None else sure]
            at += n
        return tuple(out)


def feature_values(df: DataFrame, cfg: Engine, registry: Registry = DEFAULT) -> DataFrame:
    """Adds feat_<name> (null where invalid) and local_<name>, its own confidence, for every feature of the registry, layer by layer."""
    return column_features(dispersions(df, cfg), cfg, registry)


def column_features(df: DataFrame, cfg: Engine, registry: Registry, in_order: bool = False) -> DataFrame:
    """feature_values where the dispersions are there already. in_order: a kernel left whole segments in order in each task."""
    for sequential, features in registry.layers():
        if not sequential:
            local = lambda f: F.coalesce(f.confidence(cfg), F.lit(1.0)) if f.confidence else F.lit(1.0)
            df = df.select("*", *(f.value(cfg).alias(f"feat_{f.name}") for f in features), *(local(f).alias(f"local_{f.name}") for f in features))
            continue
        named = {f.name for f in registry.features}
        inputs = [F.col(f"feat_{i}" if i in named else i) if isinstance(i, str) else i for f in features for i in f.inputs]
        schema = ", ".join(f"feat_{f.name} double, local_{f.name} double" for f in features)
        bare = [dataclasses.replace(f, value=None, confidence=None, inputs=(None,) * len(f.inputs)) for f in features]  # Columns don't leave the driver
        out = run_ordered(df, "seq", ["forced", "dt_ms", *(x.cast("double") for x in inputs)], schema, lambda bare=bare: Kernels(bare, cfg), lambda s, *x: s.step(*x), by="segment", in_order=in_order)
        df = out.select("row.*", *(x for f in features for x in (F.col(f"feat_{f.name}"), F.coalesce(f"local_{f.name}", F.lit(1.0)).alias(f"local_{f.name}"))))
    return df


def quality(df: DataFrame, cfg: Engine) -> DataFrame:
    """Adds blocks (the reasons against trading, in order), tradable, warming, critical, liquidity_score and book_quality."""
    q, f = cfg.quality, cfg.features
    top = F.least(F.get("bids", 0)["quantity"], F.get("asks", 0)["quantity"])
    checks = {
        "WARMUP": F.col("row") < q.warmup_snapshots, "SPREAD_TOO_WIDE": F.col("spread_ticks") > q.max_signal_spread_ticks, "INSUFFICIENT_DEPTH_LEVELS": F.col("usable") < q.min_depth_levels,
        "BOOK_TOO_THIN": top < q.min_top_quantity, "LIQUIDITY_BELOW_THRESHOLD": F.col("depth_ready") & (F.col("relative_depth") < q.min_relative_depth), "FEED_GAP": F.col("ms_since_gap") < q.gap_block_ms,
    }
    df = df.withColumn("blocks", F.array_compact(F.array(*(F.when(c, k) for k, c in checks.items()))))
    df = df.withColumn("tradable", F.size("blocks") == 0).withColumn("warming", F.array_contains("blocks", "WARMUP"))
    df = df.withColumn("critical", F.arrays_overlap("blocks", F.array(*map(F.lit, ("FEED_GAP", "SPREAD_TOO_WIDE", "LIQUIDITY_BELOW_THRESHOLD", "BOOK_TOO_THIN")))))
    df = df.withColumn("liquidity_score", linear_scale("relative_depth", q.min_relative_depth / 2, 1.0))
    spread = linear_scale(-F.col("spread_ticks"), -f.spread_wide_ticks, -f.spread_tight_ticks)
    levels = linear_scale(F.col("usable").cast("double"), q.min_depth_levels - 1, 5)
    return df.withColumn("book_quality", spread * levels * F.col("liquidity_score") * F.col("warmup_ratio"))


def confidence(df: DataFrame, cfg: Engine, registry: Registry = DEFAULT) -> DataFrame:
    """Adds compression_value, the six factor_<name> columns and base_<feature>: each feature's confidence before the regime's multiplier, null where invalid."""
    c, f = cfg.confidence, cfg.features
    calm = F.when(F.col("mid_ready"), clamp(1 - F.col("mid_volatility") / (F.greatest("spread_mean", F.lit(1.0)) * c.volatility_tolerance), 0, 1)).otherwise(1.0)
    squeezed = clamp(0.5 * (1 + F.tanh(F.col("compression") / f.compression_scale_ticks)), 0, 1)
    df = df.withColumn("compression_value", squeezed)
    still = F.col("touch_stability") * F.coalesce(0.75 + 0.25 * F.col("compression_value"), F.lit(1.0))
    factors = dict(zip(FACTORS, (linear_scale(-F.col("spread_ticks"), -f.spread_wide_ticks, -f.spread_tight_ticks), F.col("liquidity_score"), calm, F.col("book_quality"), still, F.col("warmup_ratio")), strict=True))
    df = df.select("*", *(clamp(v, 0.02, 1).alias(f"factor_{k}") for k, v in factors.items()))
    logs = df.select("*", *(F.ln(f"factor_{k}").alias(f"log_{k}") for k in FACTORS))
    base = lambda name: F.when(F.col(f"feat_{name}").isNotNull(), F.exp(sum((w * F.col(f"log_{k}") for w, k in zip(registry.sensitivity[name], FACTORS, strict=True)), F.lit(0.0))) * clamp(F.col(f"local_{name}"), 0, 1))
    return logs.select("*", *(base(name).alias(f"base_{name}") for name in registry.directional)).drop(*(f"log_{k}" for k in FACTORS))


def threshold(df: DataFrame, cfg: Engine) -> DataFrame:
    """Adds entry, watch and exit: the adaptive threshold, at its maximum until spread and volatility are known."""
    t = cfg.threshold
    reference = F.greatest("spread_mean", F.lit(1.0))
    raw = t.base * (1 + t.spread_coefficient * F.col("spread_sd") / reference + t.mid_coefficient * F.col("mid_volatility") / reference + t.obi_coefficient * F.col("obi_sd") / t.imbalance_reference + t.instability_coefficient * (1 - F.col("touch_stability")))
    df = df.withColumn("entry", F.when(F.col("spread_ready") & F.col("mid_ready"), clamp(raw, t.min_entry, t.max_entry)).otherwise(t.max_entry))
    return df.withColumn("watch", F.col("entry") * t.watch_ratio).withColumn("exit", F.col("entry") * t.exit_ratio)


def proposed_regime(cfg: Engine, registry: Registry = DEFAULT) -> Column:
    r = cfg.regime
    vol, er, trend = F.col("mid_volatility"), F.col("efficiency_ratio"), F.col("trend")
    known = any(f.name == "momentum" for f in registry.features)
    momentum = F.when(F.col("feat_momentum").isNotNull(), sign("feat_momentum", EPSILON)).otherwise(0) if known else F.lit(0)
    directional = F.abs(trend) >= r.trend_min_ticks
    opposed = directional & (momentum != 0) & (momentum == -sign(trend))
    return (
        F.when((F.col("row") < r.min_samples) | trend.isNull(), "UNKNOWN").when((vol >= r.vol_high_ticks) & (er < r.er_trend), "NOISE").when((er >= r.er_trend) & directional, F.when(opposed, "PULLBACK").otherwise("TREND"))
        .when((er >= r.pullback_min_er) & opposed, "PULLBACK").when((er <= r.er_range) & (vol < r.vol_high_ticks), "RANGE").otherwise("NOISE")
    )


def quotes(df: DataFrame, cfg: Engine, model: ExecutionModel = TOUCH) -> DataFrame:
    """Adds bid, ask, entry and exit prices of either direction for a whole lot, filled quantities, cost_ok and ltp_value."""
    lot = F.col("lot")
    long_in, short_in = model.entry("asks", True, lot, cfg), model.entry("bids", False, lot, cfg)
    long_out, short_out = model.exit("bids", False, lot, cfg), model.exit("asks", True, lot, cfg)
    ok = model.clears(cfg) if cfg.execution.enforce_cost_gate else F.lit(True)
    traded = F.col("feat_ltp_confirmation") if "feat_ltp_confirmation" in df.columns else F.lit(None).cast("double")
    return df.select(
        "*", F.get("bids", 0)["price"].alias("bid"), F.get("asks", 0)["price"].alias("ask"), long_in["price"].alias("entry_long"), short_in["price"].alias("entry_short"), long_out["price"].alias("exit_long"),
        short_out["price"].alias("exit_short"), long_in["filled"].alias("filled_long"), short_in["filled"].alias("filled_short"), ok.alias("cost_ok"), traded.alias("ltp_value"),
    )


def reasons(df: DataFrame, cfg: Engine, registry: Registry = DEFAULT) -> DataFrame:
    """Adds contributed (name, value, weight, confidence, contribution of each feature that counts) and reasons: the four strongest first, then spread, stability, blocks and the state's own."""
    names = F.array(*map(F.lit, registry.directional))
    rows = F.transform(F.sequence(F.lit(0), F.lit(len(registry.directional) - 1)), lambda i: F.struct(i.alias("place"), F.get(names, i).alias("name"), F.get("feats", i).alias("value"), F.get("weights", i).alias("weight"), F.get("confidences", i).alias("confidence"), F.get("contributions", i).alias("contribution")))
    df = df.withColumn("contributed", F.filter(rows, lambda x: x["contribution"].isNotNull()))
    ranked = F.array_sort(F.transform("contributed", lambda x: F.struct((-F.abs(x["contribution"])).alias("size"), x["place"].alias("place"), x.alias("x"))))
    label = F.create_map(*(F.lit(x) for name in registry.directional for x in (name, registry.labels[name])))
    told = F.transform(F.filter(F.slice(ranked, 1, 4), lambda r: r["size"] != 0), lambda r: F.format_string("%s %s %+.2f (w=%.2f c=%.2f)", F.when(r["x"]["contribution"] > 0, "+").otherwise("-"), F.try_element_at(label, r["x"]["name"]), r["x"]["value"], r["x"]["weight"], r["x"]["confidence"]))
    more = F.array_compact(F.array(
        F.when(F.col("compression_value") >= 0.6, F.format_string("+ Spread compressing (%+.2ft)", "compression")), F.when(F.col("spread_ticks") > cfg.quality.max_signal_spread_ticks, F.format_string("- Spread wide (%.2ft)", "spread_ticks")),
        F.when(F.col("touch_stability") >= 0.65, F.format_string("+ Queue stable (%.2f)", "touch_stability")),
    ))
    first = F.when(F.col("forced"), F.array(F.lit("! state reset after feed gap"))).otherwise(F.array().cast("array<string>"))
    blocked = F.transform("blocks", lambda b: F.concat(F.lit("- Blocked: "), b))
    return df.withColumn("reasons", F.concat(first, told, more, blocked, F.array("reason")))
