"""The engine's queries against DuckDB, its kernels against plain expectations."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from bookloom import catalog, config
from bookloom.config import Engine
from bookloom.operators.kernel import Decider, Ema, Sequencer, composite
from bookloom.plans import engine
from bookloom.sources import scenarios, wire

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["segment_ids", "efficiency_ratio", "feat_weighted_obi", "feat_momentum", "feat_acceleration", "adaptive_threshold", "wire_parse_ladder", "jsonl_roundtrip", "latency_percentiles_nearest_rank", "quality_gate", "structural_faults", "scalar_functions", "scenario_rows", "replayed_lines", "score_bar", "feat_refill", "feature_confidence", "regime_hysteresis"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = catalog.QUERIES[name](spark, SF)
    names = sorted(rows.columns)
    got = sorted((tuple(r[c] for c in names) for r in rows.collect()), key=str)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert got == sorted(want, key=str)


def row(ts, volume=100, bid=80000, ask=80005, bq=500, ltp=800.0, seq=0, structural=None):
    mid = (bid + ask) / 200
    return structural, ts, float(ts), seq, volume, ltp, mid, (ask - bid) / 5, 0.1, 0.2, 0.05, [bid], [bq], [ask], [400]


def test_sequencing_rules():
    s = Sequencer(Engine())
    assert s.step(*row(1000))[6] is True
    assert s.step(*row(1000))[0] == "DUPLICATE_SNAPSHOT"
    assert s.step(*row(900))[0] == "NON_MONOTONIC_TIMESTAMP"
    after_reject = s.step(*row(1200, volume=150))
    assert after_reject[2] is True and after_reject[6] is False and after_reject[7] == 200.0  # reset, yet held against the old row
    s = Sequencer(Engine())
    s.step(*row(1000))
    gap = s.step(*row(5000))
    assert gap[1] and gap[6] and gap[4] == 1
    following = s.step(*row(5200, volume=1))
    assert following[6] and following[7] == 0.0 and not following[1]  # the row after a gap is held against nothing
    s.step(*row(5400, volume=200))
    assert s.step(*row(14000, volume=300))[0] == "STALE_TIMESTAMP"
    assert s.step(*row(14200, volume=300))[0] == "STALE_TIMESTAMP"


def test_average_halves_in_a_half_life():
    e = Ema(200, 5000)
    assert e.add(0.0, 0) == 0.0
    assert math.isclose(e.add(1.0, 200), 0.5)
    assert e.add(9.0, 0) == pytest.approx(0.5)


def test_collinear_cap_and_validity():
    feats, bases = [0.5, 0.5, *[None] * 6], [1.0, 1.0, *[None] * 6]
    assert composite("TREND", feats, bases, Engine())[2] is False
    feats, bases = [1.0, 1.0, -1.0, -1.0, *[None] * 4], [1.0] * 4 + [None] * 4
    score, sure, valid, weights, _, parts = composite("RANGE", feats, bases, Engine())
    total = 0.20 + 0.24 + 0.12 + 0.12
    assert valid and weights[0] + weights[1] == pytest.approx(0.30 * total)
    assert score == pytest.approx(sum(x for x in parts if x is not None)) and sure == pytest.approx(0.95)  # the regime's factor


def test_hysteresis_holds_until_confirmed():
    d = Decider(Engine())
    assert [d.regime("TREND") for _ in range(3)] == ["UNKNOWN", "UNKNOWN", "TREND"]
    assert {d.regime("RANGE") for _ in range(7)} == {"TREND"}
    assert d.regime("RANGE") == "RANGE"


def test_scenarios_trade_in_their_direction_and_keep_the_rules(spark):
    from bookloom.operators import reports

    out = engine.run_batch(scenarios.scenario_rows(spark, 150), scenarios.AUDIT)
    opened = {(r.token, r.direction) for r in out.where("opened").select("token", "direction").distinct().collect()}
    assert ("UPWARD", 1) in opened and ("DOWNWARD", -1) in opened and not any(t == "NOISE" for t, _ in opened)
    for r in reports.invariants(out).collect():
        assert not any(v for k, v in r.asDict().items() if k != "token"), r


def test_trading_queries_cover_the_whole_book(spark):
    full = {(r.token, r.seq): r.state for r in catalog.QUERIES["full_pipeline"](spark, SF).collect()}
    states = catalog.QUERIES["state_machine"](spark, SF).collect()
    assert {(r.token, r.seq): r.state for r in states} == full and len(states) == len(full)
    closed = {(r.token, r.seq) for r in states if r.closed}
    assert {(r.token, r.seq) for r in catalog.QUERIES["position_pnl"](spark, SF).collect()} == closed
    tokens = {t for t, _ in full}
    checked = catalog.QUERIES["invariants"](spark, SF).collect()
    assert {r.token for r in checked} == tokens and not any(v for r in checked for k, v in r.asDict().items() if k != "token")
    assert {r.token for r in catalog.QUERIES["feature_audit"](spark, SF).collect()} == tokens


def test_wire_messages(spark):
    good = '{"tk":"7","exchange":"13","lp":"12.9","best_5_buy_data":[{"p":"100","q":"5"},{"p":"200","q":"0"},{"p":"300","q":"2","no of orders":"0"}]}'
    rows = [("pong",), ("",), (None,), (good,), ('[{"token":"1"}]',), ('{"x":1}',), ('{"tk":" "}',), ('{"token":"8","v":"9007199254740993","best_5_buy_data":[{"p":1,"q":1}]}',)]
    got = wire.parse(spark.createDataFrame(rows, "payload string"), "payload").select("token", "exchange_type", "bids", "parse_error", "last_traded_price", "volume_traded_today").collect()
    by = {r.token: r for r in got}
    assert len(got) == 4  # a map without a token key is a control frame
    assert by["8"].volume_traded_today == 9007199254740993
    assert by["1"].parse_error == "no depth" and by[""].parse_error == "no token"
    assert by["7"].exchange_type == 13 and [x.quantity for x in by["7"].bids][:1] and by["7"].last_traded_price == 12.9 / 10_000_000


def test_replayed_lines_equal_direct_rows(spark, tmp_path):
    """Lines that were recorded and replayed give what the rows give, with two tick sizes in one table and a notice of a gap."""
    from pyspark.sql import functions as F

    from bookloom.sources import jsonl

    cfg = config.build(Engine, {"symbols": [{"token": "UPWARD"}, {"token": "DOWNWARD", "tick_size": 0.1, "quantity": 3}]})
    rows = scenarios.scenario_rows(spark, 120, ("UPWARD", "DOWNWARD"))
    jsonl.write(rows, f"{tmp_path}/lines")
    back = jsonl.read(spark, f"{tmp_path}/lines", strict=True)
    keys = ("token", "sequence_number", "reject_reason", "segment", "spread_ticks", "tick", "lot")
    tell = lambda df: sorted((tuple(r[k] for k in keys) for r in engine.sequence(df, cfg).select(*keys).collect()), key=repr)
    got = tell(back)
    assert got == tell(rows) and len(got) == 240
    assert {(r[0], r[5], r[6], round(r[4], 6)) for r in got} == {("UPWARD", 0.05, 1, 1.0), ("DOWNWARD", 0.1, 3, 0.5)}
    notice = rows.where("seq = 50").select("token", (F.col("clock_ms") + 1).alias("clock_ms"))
    cut = tell(engine.with_gap_notices(rows.drop("seq"), notice))
    assert [r[3] for r in cut if r[0] == "UPWARD" and r[1] in (50, 51, 52)] == [0, 1, 1] and sum(r[2] == "GAP_NOTICE" for r in cut) == 2


@pytest.mark.parametrize("bad", [{"quality": {"min_depth_levels": 6}}, {"threshold": {"min_entry": 0.9}}, {"composite": {"min_confidence": 1.5}}, {"regime": {"window": 3}}, {"symbols": [{"token": " "}]}, {"symbols": [{"token": "1"}, {"token": "1"}]}, {"tick_size": 0}, {"features": {"spread_tight_ticks": 7}}, {"features": {"spread_tight_ticks": 6}}, {"features": {"momentum_fast_ms": 3000.0}}, {"regime": {"er_range": 0.45}}, {"regime": {"fast_half_life_ms": 8000.0}}, {"features": {"compression_fast_ms": 4000.0}}])
def test_settings_out_of_range(bad):
    with pytest.raises(ValueError):
        config.build(Engine, bad)


def test_strict_settings():
    with pytest.raises(ValueError, match="unknown keys"):
        config.build(Engine, {"qualty": {}})
    with pytest.raises(ValueError):
        config.build(Engine, {"quality": {"min_depth_levels": True}})
    assert config.build(Engine, {"symbols": [{"token": "1"}], "execution": {"entry_aggression_ticks": None}}).symbols[0].token == "1"


def test_pairs_that_may_be_equal():
    assert config.build(Engine, {"threshold": {"min_entry": 0.3}, "validation": {"max_snapshot_gap_ms": 8000.0}, "features": {"persistence_min_samples": 40}}).threshold.min_entry == 0.3


def test_payloads_of_bytes_and_nested_lists(spark):
    good = '{"tk":"7","bids":[{"p":100,"q":5}]}'
    rows = [(good.encode(),), (f"[[{good}], [[{good}, \"ok\"]], {{}}]".encode(),), (b"\xff" + good.encode(),), (b"[1, 2",), (None,), (b"[]",), (f"[[[[[{good}]]]]]".encode(),), (b' "Pong" ',)]
    got = wire.parse(spark.createDataFrame(rows, "payload binary"), "payload").select("token", "parse_error").collect()
    assert sorted((r.token or "", r.parse_error or "") for r in got) == sorted([("7", "")] * 3 + [("", "not UTF-8"), ("", "not JSON, or nested too deep"), ("", "not JSON, or nested too deep")])


def test_counts_of_a_stream_add_up(spark, tmp_path):
    """Observed counts of two micro-batches equal the rows skipped; samples come when a count doubles."""
    from bookloom.sources import observe

    for i, lines in enumerate((["{}", '{"token":"1"}', "x", "y"], ['{"token":"2"}', "z"])):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/in/{i}")
    told = observe.Counts("feed")
    spark.streams.addListener(told)
    rows = wire.from_record(spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in/*").withColumn("line", F.col("value")), "line")
    query = observe.observed_stream(rows, "feed", ("no token", "no depth"), sample="value").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(told)
    assert told.batches == 2 and dict(told.totals) == {"rows": 6, "accepted": 0, "no token": 4, "no depth": 2}
    assert len(told.samples["no token"]) == 2 and told.samples["no depth"] == ['{"token":"1"}', '{"token":"2"}']
