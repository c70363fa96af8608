"""The whole engine over a batch of raw snapshots.

Row-local columns, then the sequencing kernel, then windows, then row-local scores, then the deciding
kernel (whose regime picks the weights of the composite), then fills and reasons. Rows are shuffled once, by stretch of a token's history
(see `stretches`), for the sequencing kernel. A stretch holds whole segments, with which windows and the deciding kernel start afresh, so they
read on in the same task what the kernel before hands them, in order; scores in between stay in generated code. So a segment's rows
stream through one task in order, as the recurrence asks, and a token's need not. A table is written after deciding, where all columns are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.config import Engine
from bookloom.features import DEFAULT, Registry
from bookloom.functions.scalar import apart
from bookloom.operators import book, kernel, scoring, windows
from bookloom.operators.execution import TOUCH, ExecutionModel
from bookloom.operators.scan import running
from bookloom.tables import cut, tasks


def subscribed(raw: DataFrame, cfg: Engine) -> DataFrame:
    """The rows of the symbols in the settings (all, if there are none)."""
    return raw.where(F.col("token").isin([s.token for s in cfg.symbols])) if cfg.symbols else raw


#: Notices for all tokens are put beside every row as one array of clocks up to so many; beyond, each row is given its count by a sort.
BROADCAST_NOTICES = 10_000


def with_gap_notices(raw: DataFrame, notices: DataFrame) -> DataFrame:
    """raw with rows (token, clock_ms) that tell of breaks in the feed: the next accepted row of the token starts afresh. A notice without a token is told to all tokens: each one's next accepted row from that clock on starts afresh, a token's first row too."""
    raw, everyone = clocked(raw), notices.where("token IS NULL").select(F.col("clock_ms").cast("double").alias("at"))
    notices = notices.where("token IS NOT NULL")
    if everyone.limit(BROADCAST_NOTICES + 1).count() <= BROADCAST_NOTICES:
        told = everyone.agg(F.sort_array(F.collect_list("at")).alias("told"))
        raw = raw.crossJoin(F.broadcast(told)).withColumn("told", F.filter("told", lambda c: c <= F.col("clock_ms")))
        raw = raw.withColumns({"notices": F.size("told").cast("long"), "notice_clock": F.array_max("told")}).drop("told")
    else:
        raw = counted_as_of(raw, everyone)
    rows = notices.select("token", F.col("clock_ms").cast("double"), F.col("clock_ms").cast("long").alias("exchange_timestamp_ms"), F.lit(True).alias("gap_notice"))
    return raw.unionByName(rows, allowMissingColumns=True)


def counted_as_of(raw: DataFrame, everyone: DataFrame) -> DataFrame:
    """raw with notices and notice_clock, by two-level counts over ranges of the clock."""
    both = raw.withColumn("__told", F.lit(0)).unionByName(everyone.select(F.col("at").alias("clock_ms"), F.lit(1).alias("__told")), allowMissingColumns=True).withColumn("__all", F.lit(0))
    # Of equal clocks notices come first; the order of rows beyond that doesn't matter.
    both = running(both.withColumn("__order", 1 - F.col("__told")), "__all", ["clock_ms", "__order"], {"notices": F.col("__told")})
    last = everyone.select("at").withColumn("__n", F.lit(0))
    places = running(last, "__n", ["at"], {"place": F.lit(1)}).groupBy("place").agg(F.max("at").alias("notice_clock"))
    return both.where("__told = 0").join(places, F.col("notices") == F.col("place"), "left").drop("__told", "__all", "__order", "place")


def clocked(raw: DataFrame) -> DataFrame:
    """Adds clock_ms, when a row was received, where it's missing: the exchange's time."""
    return raw if "clock_ms" in raw.columns else raw.withColumn("clock_ms", F.col("exchange_timestamp_ms").cast("double"))


def arranged(raw: DataFrame) -> DataFrame:
    """Adds seq, a row's place in its token's history, where it's missing: by arrival if the source tells it, else by clock, sequence number and content."""
    if "seq" in raw.columns:
        return raw
    order = ["arrival"] if "arrival" in raw.columns else ["clock_ms", "exchange_timestamp_ms", "sequence_number", F.xxhash64("last_traded_price", "volume_traded_today", "bids", "asks")]
    if "arrival" not in raw.columns:
        raw, order = raw.withColumn("__content", order[-1]), [*order[:-1], "__content"]
    raw = cut(raw, "arrived")
    return running(raw, "token", order, {"seq": F.lit(1)}, tasks(raw)).drop("arrival", "__content")


def sequence(raw: DataFrame, cfg: Engine, columns: list[str] | None = None) -> DataFrame:
    """All rows with their reject_reason, and for accepted ones what the sequencing kernel adds. Rows that a parser marked with parse_error are left out. columns: those of the snapshots and of their local features that are wanted, where not all are."""
    if "parse_error" in raw.columns:
        raw = raw.where("parse_error IS NULL").drop("parse_error")
    raw = arranged(clocked(subscribed(raw, cfg)))
    if "notices" not in raw.columns:
        raw = raw.withColumns({"notices": F.lit(0).cast("long"), "notice_clock": F.lit(None).cast("double")})
    raw = raw.withColumn("notices", F.coalesce("notices", F.lit(0)))
    df, count = kernel.dealt(book.structural(raw, cfg), cfg)
    return kernel.sequenced(book.local_features(df, cfg), cfg, tasks=count, columns=columns)


def accepted(raw: DataFrame, cfg: Engine) -> tuple[DataFrame, int]:
    """Accepted rows, written once and dealt by segment, as window functions read them, and to how many tasks."""
    df = cut(sequence(raw, cfg).where("reject_reason IS NULL"), "sequenced")
    count = tasks(df)
    return df.repartition(count, "token", "segment"), count


def evaluated(df: DataFrame, cfg: Engine, registry: Registry = DEFAULT, model: ExecutionModel = TOUCH) -> DataFrame:
    """Rows with their windows' statistics and features, with quality, confidence, feats and bases as arrays, thresholds, the proposed regime and quotes."""
    df = scoring.confidence(scoring.quality(df, cfg).withColumn("token", apart("token")), cfg, registry).withColumn("token", apart("token"))
    df = df.select("*", F.array(*(f"feat_{n}" for n in registry.directional)).alias("feats"), F.array(*(f"base_{n}" for n in registry.directional)).alias("bases"))
    df = scoring.threshold(df, cfg).withColumn("proposed", scoring.proposed_regime(cfg, registry)).withColumn("token", apart("token"))
    return scoring.quotes(df, cfg, model).withColumn("token", apart("token"))


#: What the engine itself and execution models read of a snapshot and its local features.
READ = ["token", "seq", "clock_ms", "bids", "asks", "tick", "lot", "mid", "spread", "spread_ticks", "obi", "depth", "usable"]


def scored(raw: DataFrame, cfg: Engine, registry: Registry = DEFAULT, model: ExecutionModel = TOUCH, columns: list[str] | None = None) -> DataFrame:
    """Accepted rows with statistics, feature values, and what `evaluated` adds; each task has whole segments, in order, as the sequencing kernel left them. columns: those that are wanted, where not all are."""
    if columns is not None:
        # A feature that doesn't tell what it reads may read any.
        columns = [*columns, *READ, *(c for f in registry.features for c in f.reads)] if all(f.reads is not None for f in registry.features) else None
    df = windows.rolled(sequence(raw, cfg, columns).where("reject_reason IS NULL"), cfg, in_order=True)
    return evaluated(scoring.column_features(df, cfg, registry, in_order=True), cfg, registry, model)


def decided(raw: DataFrame, cfg: Engine, registry: Registry = DEFAULT, model: ExecutionModel = TOUCH, columns: list[str] | None = None) -> DataFrame:
    """scored, with the regime, the composite and the trading states. columns: those that are wanted, where not all are."""
    return kernel.decided(scored(raw, cfg, registry, model, columns), cfg, registry, in_order=True, columns=columns)


#: What execution models and `reasons` are told of a position, and of the row that it is marked at.
MARKED = ["clock_ms", "bids", "asks", "tick", "lot", "mid", "spread", "spread_ticks", "direction", "quantity", "entry_price", "entry_clock_ms", "opened", "closed"]


def run_batch(raw: DataFrame, cfg: Engine, registry: Registry = DEFAULT, model: ExecutionModel = TOUCH, columns: list[str] | None = None) -> DataFrame:
    """One output row per accepted snapshot. registry: the features and their weights; model: how orders fill, what they cost and what a position is worth; columns: those of `decided` that are wanted beside the marked position, where not all are (no reasons are told then, and no table is written between)."""
    if columns is not None:
        return model.marked(decided(raw, cfg, registry, model, [*columns, *MARKED]), cfg)
    return scoring.reasons(model.marked(cut(decided(raw, cfg, registry, model), "decided"), cfg), cfg, registry)
