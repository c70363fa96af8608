"""The streaming engine against the batch plan, restarts, notices and idle tokens; frames against their definitions."""

import dataclasses
import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from bookloom.catalog_trading import TRADING
from bookloom.config import Engine
from bookloom.features import DEFAULT, Feature
from bookloom.plans import engine
from bookloom.schema import RAW
from bookloom.sources import scenarios
from bookloom.sources.trading import trading_book
from bookloom.streaming import engine as stream
from bookloom.streaming.frames import Extremes, Frame

SF = "/root/testdata/sf0.001"
SCHEMA = f"{RAW}, seq bigint, clock_ms double, gap_notice boolean"


@pytest.fixture()
def store(spark):
    """Several states of one operator need RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def test_frames_equal_their_definition():
    rnd = random.Random(2)
    frame, extremes, values, plain = Frame(7), Extremes(5), [], []
    for i in range(500):
        x = None if rnd.random() < 0.2 else rnd.gauss(1e6, 1)
        frame.add(x)
        values.append(x)
        known = [v for v in values[-7:] if v is not None]
        assert frame.n == len(known) and frame.sd() == pytest.approx(statistics.stdev(known) if len(known) > 1 else 0.0, abs=1e-5)
        assert not known or frame.mean == pytest.approx(math.fsum(known) / len(known), rel=1e-12) and frame.total == pytest.approx(math.fsum(known), rel=1e-12)
        y = rnd.randrange(50)
        extremes.add(y)
        plain.append(y)
        assert extremes.spread() == max(plain[-5:]) - min(plain[-5:])
        if i % 90 == 0:
            frame = Frame(7, list(frame.values))


def fed(spark, df, parts, folder):
    """df as files in the order of parts (conditions), a file a micro-batch, and a stream over those there are."""
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.parquet(f"{folder}/in/{i}")
        time.sleep(0.02)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def drained(out, folder):
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")


STATS = ("mid_volatility", "spread_mean", "spread_sd", "spread_range", "relative_depth", "touch_stability", "mean_traded", "obi_sd", "efficiency_ratio", "persistence_value", "momentum_sd", "acceleration_sd")
SHOWN = ("idx", "segment", "row", "regime", "dwell", "composite_valid", "state", "previous_state", "reason", "direction", "quantity", "opened", "closed", "tradable", "mid_ready", "depth_ready")
NUMBERS = (*STATS, "score", "smoothed", "composite_confidence", "entry", "entry_price", "exit_price", "stop_price", "trend", "refill", "book_quality")


def same(got, want):
    key = lambda r: (r.token, r.seq)
    got, want = ({key(r): r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for k, w in want.items():
        g = got[k]
        assert [g[c] for c in SHOWN] == [w[c] for c in SHOWN], k
        for c in NUMBERS:
            assert (g[c] is None) == (w[c] is None) and (g[c] is None or g[c] == pytest.approx(w[c], abs=1e-9)), (k, c, g[c], w[c])
        assert (g.pnl is None) == (w.pnl is None) and (g.pnl is None or g.pnl.net_rupees == pytest.approx(w.pnl.net_rupees, abs=1e-9)) and len(g.reasons) == len(w.reasons)
    return got


def test_stream_of_the_whole_engine_equals_batch_over_a_restart(store, tmp_path):
    """Four micro-batches of the trading book, the last two after a restart from the checkpoint; trades go on over it."""
    spark = store
    book = trading_book(spark, SF).withColumn("gap_notice", F.lit(False)).withColumn("clock_ms", F.col("clock_ms").cast("double")).cache()
    parts = ["seq <= 90", "seq > 90 AND seq <= 170", "seq > 170 AND seq <= 171", "seq > 171"]
    fed(spark, book, parts[:2], tmp_path)
    source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    drained(stream.run_stream(source(), TRADING), tmp_path)
    for i in (2, 3):
        book.where(parts[i]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.02)
    got = same(drained(stream.run_stream(source(), TRADING), tmp_path), engine.run_batch(book.drop("gap_notice"), TRADING))
    assert any(r.closed for r in got.values()) and len({r.state for r in got.values()}) >= 6


def test_a_notice_to_all_reaches_tokens_seen_later(store, tmp_path):
    """Both tokens start afresh after a notice without a token, the one that begins after it too; batch and stream agree."""
    spark = store
    rows = engine.clocked(scenarios.scenario_rows(spark, 60, ("UPWARD", "DOWNWARD", "NOISE"))).withColumn("gap_notice", F.lit(False))
    rows = rows.where("token <> 'NOISE' OR seq > 45")
    at = 1_753_500_000_000.0 + 200 * 30 + 1
    notice = spark.createDataFrame([(None, at)], "token string, clock_ms double")
    both = rows.unionByName(notice.withColumn("gap_notice", F.lit(True)).withColumn("exchange_timestamp_ms", F.col("clock_ms").cast("long")), allowMissingColumns=True)
    out = drained(stream.run_stream(fed(spark, both, [f"clock_ms < {at}", f"clock_ms = {at}", f"clock_ms > {at}"], tmp_path), scenarios.AUDIT), tmp_path)
    got = same(out, engine.run_batch(engine.with_gap_notices(rows.drop("gap_notice"), notice), scenarios.AUDIT))
    forced = {k: r for k, r in got.items() if r.forced}
    assert set(forced) == {("UPWARD", 31), ("DOWNWARD", 31), ("NOISE", 46)} and all(r.row == 1 and any("state reset" in x for x in r.reasons) for r in forced.values())
    assert got["UPWARD", 32].ms_since_gap == pytest.approx(399)


def test_notices_beyond_a_broadcast_are_counted_by_a_sort(spark, monkeypatch):
    rows = engine.clocked(scenarios.scenario_rows(spark, 40, ("UPWARD", "NOISE")))
    notices = spark.createDataFrame([(None, 1_753_500_000_000.0 + x) for x in (-5, 1000, 1000, 3001, 99_999)] + [("NOISE", 1_753_500_004_100.0)], "token string, clock_ms double")
    tell = lambda: sorted((r.token, r.seq or 0, r.notices or 0, r.notice_clock or 0) for r in engine.with_gap_notices(rows, notices).collect())
    want = tell()
    monkeypatch.setattr(engine, "BROADCAST_NOTICES", 2)
    assert tell() == want and len(want) == 81 and {n for _, _, n, _ in want} == {0, 1, 3, 4}


def test_sequencing_of_a_stream_equals_batch(store, tmp_path):
    """Late, doubled and damaged rows, and a notice to one token."""
    spark = store
    rows = engine.clocked(scenarios.scenario_rows(spark, 60, ("UPWARD", "NOISE")).drop("clock_ms")).withColumn("gap_notice", F.lit(False))
    ts = F.col("exchange_timestamp_ms") - F.when(F.col("seq") == 20, 900).otherwise(0)
    rows = rows.withColumns({"exchange_timestamp_ms": ts, "volume_traded_today": F.col("volume_traded_today") - F.when(F.col("seq") == 40, 5000).otherwise(0), "asks": F.when(F.col("seq") == 25, F.slice("asks", 1, 0)).otherwise(F.col("asks"))})
    notice = spark.createDataFrame([("UPWARD", 61, 1_753_500_006_100.0)], "token string, seq bigint, clock_ms double").withColumn("exchange_timestamp_ms", F.col("clock_ms").cast("long")).withColumn("gap_notice", F.lit(True))
    both = rows.unionByName(notice, allowMissingColumns=True)
    keys = ("token", "seq", "reject_reason", "forced", "segment", "dt_ms", "trend", "refill", "momentum")
    tell = lambda df: sorted((tuple(r[k] for k in keys) for r in df.select(*keys).collect()), key=repr)
    got = tell(drained(stream.sequenced_stream(fed(spark, both, ["seq <= 30", "seq > 30"], tmp_path), Engine()), tmp_path))
    assert got == tell(engine.sequence(both, Engine())) and len(got) == 121
    assert {r[2] for r in got} == {None, "NON_MONOTONIC_TIMESTAMP", "VOLUME_REGRESSION", "MISSING_L1", "GAP_NOTICE"}


def test_idle_tokens_end_and_begin_anew(store, tmp_path):
    spark = store
    rows = engine.clocked(scenarios.scenario_rows(spark, 20, ("UPWARD",))).withColumn("gap_notice", F.lit(False))
    source = fed(spark, rows, ["seq <= 10"], tmp_path)
    run = lambda df: drained(stream.sequenced_stream(df, Engine(), idle_ms=3000), tmp_path)
    # Else a query with idle tokens goes on with empty micro-batches and never ends.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    run(source)
    time.sleep(4)
    rows.where("seq > 10").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    got = {r.seq: r.idx for r in run(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")).collect()}
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [got[i] for i in (1, 10, 11, 20)] == [1, 10, 1, 10]


def test_kernel_features_are_refused():
    with pytest.raises(ValueError, match="no state in a stream"):
        stream.run_stream(None, Engine(), DEFAULT + [Feature("k", start=lambda cfg: None, step=lambda s, dt: (0.0, 1.0))])


def test_state_round_trips():
    from bookloom.operators.kernel import Decider, Sequencer

    s = Sequencer(Engine())
    for i in range(9):
        s.step(None, 1000 + 200 * i, 1000.0 + 200 * i, i, 100 + 50 * i, 800.0, 800.0 + i, 1.0, 0.1, 0.2, 0.05, [80000, 79995], [500 - 60 * (i % 2), 20], [80005, 80010], [400, 30])
    again, notices, rings = stream.load_sequencer(Engine(), stream.dump_sequencer(s, 3, [[1.0, None]]))
    assert notices == 3 and rings == [[1.0, None]]
    assert stream.dump_sequencer(again, 3, rings) == stream.dump_sequencer(s, 3, rings) and again.before == s.before and again.episodes == s.episodes
    d = Decider(dataclasses.replace(Engine()))
    d.position, d.blocked = (1, 7, 800.0, 5.0, 799.0, 801.0), -1
    assert stream.load_decider(Engine(), (), stream.dump_decider(d)).position == d.position
