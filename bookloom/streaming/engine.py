"""The whole engine over a stream, by typed state.

Two stateful operators with row-local Columns before, between and after them: the first sequences a token's rows and keeps its
rolling statistics, the second holds the regime, the composite's average and the trading states; features, confidence,
thresholds and quotes between them are the batch plan's own Columns. Tokens are dealt to SHARDS keys, each with a map of its
tokens' states, so that a notice of a break in the feed that names no token reaches every shard, and tokens that are seen
later obey it too. A token's state is typed columns of fixed size (numbers, and rings of the last rows' values);
with idle_ms, the state of a token that has been silent for so long ends, and it begins anew when it returns (a query that
is to end by itself, as with availableNow, then needs spark.sql.streaming.noDataMicroBatches.enabled set to false).

Rows of a token are taken in the order of `seq` inside a micro-batch, and micro-batches as they come; a late row is held
against what has been accepted, as the rules for time and volume say. How long state lives and which rows are late
are independent of each other.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bookloom.config import Engine
from bookloom.features import DEFAULT, Registry
from bookloom.operators import book, scoring
from bookloom.operators.execution import TOUCH, ExecutionModel
from bookloom.operators.kernel import DECIDE_IN, DECIDE_OUT, SEQUENCE_IN, SEQUENCE_OUT, Decider, Sequencer
from bookloom.operators.windows import mid_in_ticks
from bookloom.plans.engine import clocked, evaluated, subscribed
from bookloom.streaming.frames import Statistics

SHARDS = 64
#: Clocks of notices that a shard remembers; of older ones it knows how many there were.
NOTICES = 1000
LADDER = "array<struct<price_paise: bigint, price: double, quantity: bigint, orders: bigint>>"
#: What the first operator hands on besides what it adds: row-local columns that scores read.
CARRIED = "last_traded_price double, mid double, spread double, mid_ticks double, depth double, obi_local double, slope_value double, slope_local double, usable int, lot bigint, symbol string, bids_text string, asks_text string"
#: A token's sequencing state: times (ts, sequence number), touch (prices and sizes in paise, volume), marks (mid, last trade), averages and their counts, refill scores and episodes.
SEQUENCER_STATE = (
    "times array<bigint>, touch array<bigint>, marks array<double>, pending boolean, gap_clock double, idx bigint, segment bigint, row bigint, averages array<double>, samples array<bigint>, "
    "last_momentum double, last_trade bigint, previous array<bigint>, scores array<double>, bid_episode array<bigint>, ask_episode array<bigint>, notices bigint, rings array<array<double>>"
)
DECIDER_STATE = "held string, dwell bigint, candidate string, times bigint, average double, samples bigint, state string, position array<double>, deadline double, cooldown double, confirmed bigint, confirming bigint, blocked bigint"
#: Places in SEQUENCE_IN of whole numbers.
WHOLE = tuple(SEQUENCE_IN.index(c) for c in ("exchange_timestamp_ms", "sequence_number", "volume_traded_today"))
AVERAGES = ("spread_fast", "spread_slow", "trend_fast", "trend_slow", "micro", "mom_fast", "mom_slow", "smooth", "ltp")


def names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def dump_sequencer(s: Sequencer, notices: int, rings: list) -> tuple:
    ints = lambda x: None if x is None else [int(v) for v in x]
    ts, seq, mid, touch = s.before or (None, None, None, None)
    averages = [getattr(s, n) for n in AVERAGES]
    return (
        None if s.before is None else [int(ts), int(seq)], None if s.before is None else ints(touch[:5]), None if s.before is None else [float(mid), float(touch[5])], s.pending, s.gap_clock, s.idx, s.segment, s.row, [e.value for e in averages], [e.n for e in averages],
        s.last_momentum, s.last_trade, ints(s.previous), list(s.scores), ints(s.episodes[0]), ints(s.episodes[1]), notices, rings,
    )


def load_sequencer(cfg: Engine, v: tuple | None) -> tuple[Sequencer, int, list | None]:
    s = Sequencer(cfg)
    if v is None:
        return s, 0, None
    times, touch, marks, s.pending, s.gap_clock, s.idx, s.segment, s.row, averages, samples, s.last_momentum, s.last_trade, previous, scores, bid, ask, notices, rings = v
    s.before = None if times is None else (times[0], times[1], marks[0], (*touch, marks[1]))
    for n, value, count in zip(AVERAGES, averages, samples, strict=True):
        e = getattr(s, n)
        e.value, e.n = value, count
    s.previous, s.scores = previous and tuple(previous), list(scores)
    s.episodes = [bid and tuple(bid), ask and tuple(ask)]
    return s, notices, [list(x) for x in rings]


def dump_decider(d: Decider) -> tuple:
    return d.held, d.dwell, d.candidate, d.count, d.smoother.value, d.smoother.n, d.state, None if d.position is None else [float(x) for x in d.position], d.deadline, d.cooldown, d.confirmed, d.confirming, d.blocked


def load_decider(cfg: Engine, tables: tuple, v: tuple | None) -> Decider:
    d = Decider(cfg, *tables)
    if v is not None:
        d.held, d.dwell, d.candidate, d.count, d.smoother.value, d.smoother.n, d.state, position, d.deadline, d.cooldown, d.confirmed, d.confirming, d.blocked = v
        d.position = None if position is None else (int(position[0]), int(position[1]), *position[2:])
    return d


def plain(value):
    """A cell of a pandas column as a plain value; missing ones as None."""
    if hasattr(value, "ndim") and value.ndim:
        return [plain(x) for x in value.tolist()]
    return None if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value else value


def by_token(rows: Iterator[pd.DataFrame], order: str) -> Iterator[tuple[str, pd.DataFrame]]:
    batch = pd.concat(list(rows), ignore_index=True)
    for token, part in batch.groupby("token", sort=False):
        yield token, part.sort_values(order, kind="stable")


class Sequencing(StatefulProcessor):
    """Sequences rows and keeps rolling statistics, for all tokens of a shard."""

    def __init__(self, cfg: Engine, idle_ms: int | None, inputs: int, carried: list[str], out: list[str]):
        self.cfg, self.idle_ms, self.inputs, self.carried, self.out = cfg, idle_ms, inputs, carried, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = (self.idle_ms,) if self.idle_ms else ()
        self.tokens = handle.getMapState("tokens", "token string", SEQUENCER_STATE, *ttl)
        self.told = handle.getValueState("notices", "before bigint, clocks array<double>")

    def notices(self, batch: pd.DataFrame) -> tuple[int, list[float]]:
        """How many notices for all tokens are no longer known by their clock, and the clocks of the others."""
        before, clocks = self.told.get() if self.told.exists() else (0, [])
        told = batch[batch["token"].isna()]
        if len(told):
            clocks = sorted([*clocks, *told["in_clock"].tolist()])
            before, clocks = before + max(0, len(clocks) - NOTICES), clocks[-NOTICES:]
            self.told.update((before, clocks))
        return before, list(clocks)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True)
        before, clocks = self.notices(batch)
        for token, part in by_token(iter([batch[batch["token"].notna()]]), "seq"):
            kernel, seen, rings = load_sequencer(self.cfg, self.tokens.getValue((token,)) if self.tokens.containsKey((token,)) else None)
            stats, out = Statistics(self.cfg, rings), []
            columns = [part[c].tolist() for c in ("seq", *(f"in_{i}" for i in range(self.inputs)), *self.carried)]
            for row in zip(*columns, strict=True):
                seq, *values = map(plain, row)
                values, carried = values[: self.inputs], values[self.inputs :]
                for i in WHOLE:
                    values[i] = None if values[i] is None else int(values[i])  # pandas makes doubles of whole numbers where some are missing
                # As of a row's clock; SEQUENCE_IN ends with what the batch plan counts.
                place = bisect.bisect_right(clocks, values[2])
                values[-2:] = before + place, clocks[place - 1] if place else None
                kernel.seen = seen
                made = kernel.step(*values)
                seen = kernel.seen
                if made[0] is None:
                    if made[2]:
                        stats = Statistics(self.cfg)
                    of = dict(zip(self.carried, carried, strict=True))
                    found = stats.row(made[5], made[6], of["mid_ticks"], values[7], of["depth"], values[9], made[8], values[10], made[10:14], values[11], values[12], values[13], values[14], made[17], made[19])
                else:
                    found = (None,) * len(names(Statistics.OUT))
                out.append((token, seq, *(values[i] for i in (1, 2, 7, 9, 10)), *carried, *made, *found))
            self.tokens.updateValue((token,), dump_sequencer(kernel, seen, stats.rings()))
            yield pd.DataFrame(out, columns=self.out).astype(object)

    def close(self) -> None:
        pass


class Deciding(StatefulProcessor):
    """Regimes, the composite and the trading states, for all tokens of a shard."""

    def __init__(self, cfg: Engine, tables: tuple, idle_ms: int | None, carried: list[str], out: list[str]):
        self.cfg, self.tables, self.idle_ms, self.carried, self.out = cfg, tables, idle_ms, carried, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "token string", DECIDER_STATE, *((self.idle_ms,) if self.idle_ms else ()))

    def handleInputRows(self, key, rows, timerValues):
        for token, part in by_token(rows, "idx"):
            kernel, out = load_decider(self.cfg, self.tables, self.tokens.getValue((token,)) if self.tokens.containsKey((token,)) else None), []
            for row in zip(*(part[c].tolist() for c in (*self.carried, *(f"in_{i}" for i in range(len(DECIDE_IN))))), strict=True):
                values = [plain(x) for x in row]
                out.append((token, *values[: len(self.carried)], *kernel.step(*values[len(self.carried) :])))
            self.tokens.updateValue((token,), dump_decider(kernel))
            yield pd.DataFrame(out, columns=self.out).astype(object)

    def close(self) -> None:
        pass


def sequenced_rows(raw: DataFrame, cfg: Engine, idle_ms: int | None = None) -> DataFrame:
    """Per row of a stream of raw snapshots (with seq): what the sequencing kernel gives, and the rolling statistics of accepted rows. A row with gap_notice and no token is a notice to all tokens."""
    if "parse_error" in raw.columns:
        raw = raw.where("parse_error IS NULL").drop("parse_error")
    rows = clocked(raw)
    everyone = F.col("token").isNull() & F.col("gap_notice") if "gap_notice" in rows.columns else F.lit(False)
    rows = book.local_features(book.structural(subscribed(rows, cfg) if not cfg.symbols else rows.where(F.col("token").isin([s.token for s in cfg.symbols]) | everyone), cfg), cfg)
    rows = rows.withColumns({"mid_ticks": mid_in_ticks(), "bids_text": F.to_json("bids"), "asks_text": F.to_json("asks"), "notices": F.lit(0).cast("long"), "notice_clock": F.lit(None).cast("double")})
    shard = F.when(everyone, F.sequence(F.lit(0), F.lit(SHARDS - 1))).otherwise(F.array(F.pmod(F.xxhash64("token"), F.lit(SHARDS)).cast("int")))
    carried = names(CARRIED)
    rows = rows.where(F.col("token").isNotNull() | everyone).select(F.explode(shard).alias("shard"), "token", F.col("seq").cast("long").alias("seq"), F.col("clock_ms").alias("in_clock"), *(F.col(c).alias(f"in_{i}") for i, c in enumerate(SEQUENCE_IN)), *carried)
    schema = f"token string, seq bigint, exchange_timestamp_ms bigint, clock_ms double, spread_ticks double, obi double, tick double, {CARRIED}, {SEQUENCE_OUT}, {Statistics.OUT}"
    processor = Sequencing(cfg, idle_ms, len(SEQUENCE_IN), carried, names(schema))
    return rows.groupBy("shard").transformWithStateInPandas(processor, schema, "append", "processingTime" if idle_ms else "none")


def sequenced_stream(raw: DataFrame, cfg: Engine, idle_ms: int | None = None) -> DataFrame:
    """Per row of a stream: token, seq and what the sequencing kernel gives (see kernel.SEQUENCE_OUT)."""
    return sequenced_rows(raw, cfg, idle_ms).select("token", "seq", *names(SEQUENCE_OUT))


def run_stream(raw: DataFrame, cfg: Engine, registry: Registry = DEFAULT, model: ExecutionModel = TOUCH, idle_ms: int | None = None) -> DataFrame:
    """One output row per accepted snapshot of a stream, as run_batch gives it for a table. Needs a state store that keeps several states (RocksDB); features by kernels run in batch only."""
    if any(f.sequential for f in registry.features):
        raise ValueError("features by kernels have no state in a stream")
    df = sequenced_rows(raw, cfg, idle_ms).where("reject_reason IS NULL")
    df = df.withColumns({"bids": F.from_json("bids_text", LADDER), "asks": F.from_json("asks_text", LADDER)}).withColumnRenamed("row_no", "row")
    df = evaluated(scoring.column_features(df, cfg, registry), cfg, registry, model)
    kept = [c for c in df.columns if c not in ("bids", "asks", "feats", "bases", "token", *(x for x in names(DECIDE_OUT)))]
    kinds = dict(df.dtypes)
    rows = df.select(F.pmod(F.xxhash64("token"), F.lit(SHARDS)).cast("int").alias("shard"), "token", *kept, *(F.col(c).alias(f"in_{i}") for i, c in enumerate(DECIDE_IN)))
    schema = ", ".join(["token string", *(f"`{c}` {kinds[c]}" for c in kept)]) + f", {DECIDE_OUT}"
    processor = Deciding(cfg, (registry.directional, registry.weights), idle_ms, kept, ["token", *kept, *names(DECIDE_OUT)])
    out = rows.groupBy("shard").transformWithStateInPandas(processor, schema, "append", "processingTime" if idle_ms else "none")
    out = out.withColumns({"bids": F.from_json("bids_text", LADDER), "asks": F.from_json("asks_text", LADDER)}).drop("bids_text", "asks_text")
    out = out.withColumn("feats", F.array(*(f"feat_{n}" for n in registry.directional)))
    return scoring.reasons(model.marked(out, cfg), cfg, registry)
