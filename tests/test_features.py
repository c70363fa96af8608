"""The feature contract, injected features and execution models."""

import dataclasses

import duckdb
import pytest
from pyspark.sql import functions as F

from bookloom import catalog, catalog_trading, config  # noqa: F401
from bookloom.config import Composite, Engine, Quality
from bookloom.features import BUILT_IN, DEFAULT, Feature, Registry, feature
from bookloom.operators import kernel
from bookloom.operators.execution import DepthWalk, ExecutionModel
from bookloom.plans import engine
from bookloom.sources import scenarios

SF = "/root/testdata/sf0.001"
CONSTANT = Feature("constant", lambda cfg: F.lit(1.0))


def test_dependents_come_after_what_they_depend_on():
    assert [f.name for f in Registry(reversed(BUILT_IN)).features].index("momentum") < [f.name for f in Registry(reversed(BUILT_IN)).features].index("acceleration")
    assert [f.name for f in DEFAULT.features] == list(config.FEATURES) and DEFAULT.directional == config.DIRECTIONAL
    with pytest.raises(ValueError, match="depends on"):
        Registry(reversed(BUILT_IN), strict=True)
    with pytest.raises(ValueError, match="duplicate"):
        Registry([BUILT_IN[0], BUILT_IN[0]])
    with pytest.raises(ValueError, match="not registered"):
        Registry([Feature("a", lambda cfg: F.lit(0.0), depends_on=("b",))])
    with pytest.raises(ValueError, match="each other: a -> b -> a"):
        Registry([Feature("a", lambda cfg: F.lit(0.0), depends_on=("b",)), Feature("b", lambda cfg: F.lit(0.0), depends_on=("a",))])
    for bad in ([Feature("a")], [Feature("a b", lambda cfg: F.lit(0.0))], [Feature("a", step=lambda s, dt: (0, 1))], [], [Feature("a", lambda cfg: F.lit(0.0), sensitivity=(1.0,))]):
        with pytest.raises(ValueError):
            Registry(bad)
    with pytest.raises(ValueError, match="no directional"):
        Registry([CONSTANT], weights={"TREND": {"other": 1.0}})


def test_layers_keep_dependencies_apart():
    step = lambda s, dt, x: (x, 1.0)
    r = Registry([Feature("a", lambda cfg: F.lit(0.5)), Feature("k", start=lambda cfg: None, step=step, inputs=("a",), depends_on=("a",)), Feature("b", lambda cfg: feature("k"), depends_on=("k",)), Feature("c", lambda cfg: F.lit(0.1))])
    assert [(s, [f.name for f in x]) for s, x in r.layers()] == [(False, ["a", "c"]), (True, ["k"]), (False, ["b"])]


def test_a_constant_feature_is_the_whole_composite(spark):
    cfg = dataclasses.replace(scenarios.AUDIT, composite=Composite(min_features=1, min_confidence=0.05), quality=Quality(warmup_snapshots=25, min_relative_depth=0.2))
    registry = Registry([CONSTANT], weights={"UNKNOWN": {"constant": 1.0}})
    out = engine.run_batch(scenarios.scenario_rows(spark, 40, ("UPWARD",)), cfg, registry)
    last = out.orderBy(F.desc("idx")).first()
    assert last.feat_constant == 1.0 and last.composite_valid and last.score == pytest.approx(1.0) and last.smoothed == pytest.approx(1.0)
    assert [(x.name, x.contribution) for x in last.contributed] == [("constant", pytest.approx(1.0))] and any("constant" in x for x in last.reasons)


def test_a_kernel_feature_runs_by_token_and_starts_afresh_after_gaps(spark):
    class Streak:
        """How many rows in a row the mid has moved the same way."""

        def __init__(self):
            self.last, self.length = None, 0

    def streak(state, dt, mid):
        move = 0 if state.last is None else (mid > state.last) - (mid < state.last)
        state.length = state.length + move if move * state.length >= 0 and move else move
        state.last = mid
        return (max(-1.0, min(1.0, state.length / 10)), 0.5) if abs(state.length) > 1 else (None, 1.0)

    rows = scenarios.scenario_rows(spark, 30, ("UPWARD", "DOWNWARD"))
    ts = F.col("exchange_timestamp_ms") + F.when(F.col("seq") > 20, 5000).otherwise(0)
    rows = rows.withColumns({"exchange_timestamp_ms": ts, "clock_ms": ts.cast("double")})
    registry = DEFAULT + [Feature("streak", start=lambda cfg: Streak(), step=streak, inputs=("mid",), weights={r: 0.1 for r in config.REGIMES}), Feature("twice", lambda cfg: feature("streak") / 2, lambda cfg: F.col("local_streak"), depends_on=("streak",))]
    out = {(r.token, r.idx): r for r in engine.scored(rows, scenarios.AUDIT, registry).collect()}
    for token, sign in (("UPWARD", 1), ("DOWNWARD", -1)):
        assert out[token, 2].feat_streak is None and out[token, 10].feat_streak == pytest.approx(sign * 0.9) and out[token, 10].local_streak == 0.5 and out[token, 10].feat_twice == pytest.approx(sign * 0.45)
        assert out[token, 20].feat_streak == sign and out[token, 21].feat_streak is None and out[token, 25].feat_streak == pytest.approx(sign * 0.4)
    assert len(out[token, 25].feats) == 10


class Free(ExecutionModel):
    """Fills at the mid, without costs."""

    def fill(self, side, buying, quantity, offset_ticks, cfg):
        return F.struct(F.col("mid").alias("price"), quantity.alias("filled"))

    def cost(self, buy, sell, quantity, cfg):
        return F.struct(F.lit(0.0).alias("rupees"), F.lit(0.0).alias("bps"), F.lit(0.0).alias("ticks"))


def test_execution_models_are_injected(spark):
    rows, cfg = scenarios.scenario_rows(spark, 120, ("UPWARD",)), dataclasses.replace(scenarios.AUDIT, quantity=4000)
    of = lambda model: engine.run_batch(rows, cfg, model=model).where("opened OR closed").orderBy("idx").collect()
    free, walked, touch = of(Free()), of(DepthWalk()), of(ExecutionModel())
    assert free[0].entry_price == pytest.approx(free[0].mid) and free[1].pnl.cost_rupees == 0 and free[1].pnl.net_rupees == free[1].pnl.gross_rupees
    asks = [(x.price, x.quantity) for x in walked[0].asks]
    filled = min(4000, sum(q for _, q in asks))
    assert filled < 4000 and walked[0].quantity == filled and walked[0].entry_price == pytest.approx(sum(p * q for p, q in asks) / filled)
    bids, left, paid = [(x.price, x.quantity) for x in walked[1].bids], filled, 0.0
    for p, q in bids:
        paid, left = paid + p * min(q, left), left - min(q, left)
    assert walked[1].exit_price == pytest.approx(paid / (filled - left)) and touch[0].quantity == 4000


@pytest.mark.parametrize("name", ["trading_book", "trading_pnl", "own_features", "depth_walk_pnl", "state_machine"])
def test_trading_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    rows = catalog.QUERIES[name](spark, SF)
    names = sorted(rows.columns)
    got = sorted((tuple(r[c] for c in names) for r in rows.collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE[name]})").fetchall(), key=str)


def test_every_state_and_exit_occurs_on_a_table():
    """The SQL of trading_states (which equals the query, as the queries' check on sf0.01 shows) meets all states, exits and most reasons."""
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    rows = con.execute(f"SELECT state, regexp_replace(reason, ' \\d.*', ''), count(*) FROM ({catalog.ORACLE['trading_states']}) GROUP BY ALL").fetchall()
    assert {s for s, _, _ in rows} == {"WARMUP", "NEUTRAL", "WATCH_LONG", "WATCH_SHORT", "LONG", "SHORT", "EXIT_LONG", "EXIT_SHORT", "COOLDOWN"}
    reasons = {r for _, r, _ in rows}
    assert {f"exit: {x}" for x in ("stop", "target", "time", "composite reversal", "confidence", "quality")} <= reasons
    assert {"watch armed", "watch expired", "entry", "holding", "cooldown active", "awaiting zero-cross re-arm after exit", "confirming"} <= reasons
    assert sum(n for _, r, n in rows if r.startswith("exit: ")) > 100


def test_composite_weights_of_a_registry():
    names, table = ("a", "b"), {r: (0.5, 0.5) for r in config.REGIMES}
    score, sure, valid, *_ = kernel.composite("RANGE", [1.0, None], [1.0, None], Engine(composite=Composite(min_features=1)), names, table)
    assert (score, valid) == (1.0, True) and sure == pytest.approx(0.95)
