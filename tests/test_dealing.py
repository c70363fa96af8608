"""Queries on tables made so that a token's history meets what the small tables lack: equal mids of unlike books, histories of many stretches."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from bookloom import catalog, catalog_trading  # noqa: F401  (registers its queries)
from bookloom.config import Engine, Validation
from bookloom.operators import book, kernel, stretches
from bookloom.plans import engine

SF = "/root/testdata/sf0.001"


def events(spark, folder, values, users=1):
    """An events table with these values (in hundredths) for each user in turn."""
    rows = [(i * users + u, u, "click", v / 100.0) for i, v in enumerate(values) for u in range(users)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def compared(spark, name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    rows = catalog.QUERIES[name](spark, sf)
    names = sorted(rows.columns)
    got = sorted((tuple(r[c] for c in names) for r in rows.collect()), key=str)
    assert got and got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE[name]})").fetchall(), key=str)


def test_equal_mids_of_unlike_spreads_are_no_range(spark, tmp_path):
    """A segment's first two rows have spreads of three ticks and one about the same mid, at many prices."""
    values = [{0: 7, 1: 3}.get(seq % 211, 3) for seq in range(1, 60 * 211)]
    compared(spark, "rolling_minmax_range_position", events(spark, tmp_path, values))


@pytest.mark.parametrize("name", ["clean_sequence", "feat_queue_persistence", "adaptive_threshold", "level_at_prev_best", "ema_pair_trend", "feat_acceleration", "replayed_lines", "state_machine"])
def test_tokens_of_many_stretches_equal_sql(spark, monkeypatch, name):
    monkeypatch.setattr(stretches, "ROWS", 30)
    monkeypatch.setattr(stretches, "TAIL", 3)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    rows = catalog.QUERIES[name](spark, SF)
    names = sorted(rows.columns)
    got = sorted((tuple(r[c] for c in names) for r in rows.collect()), key=str)
    assert got and got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE[name]})").fetchall(), key=str)


def test_stretches_of_a_troubled_feed_equal_one_pass(spark, monkeypatch):
    """Stale, late, repeated and regressing rows, gaps in a row and notices, with starts that are guessed wrong at first; a token's rows are in many tasks."""
    rnd, data, ts, volume = random.Random(3), [], 1_000_000, 0
    for i in range(900):
        ts += rnd.choice([100, 100, 100, 200, 0, -50, 3500, 3500] if 200 < i < 600 else [100, 100, 100, 100, 100, 4000] if i < 800 else [100, 9000])
        volume += rnd.choice([0, 5, 5, 5, -3] if i > 300 else [5])
        bid = 80000 + 5 * rnd.choice([0, 0, 1, -1, 60])
        level = lambda p, q: [(p + 5 * k * q, (p + 5 * k * q) / 100, rnd.choice([300, 500]), 3) for k in range(5)]  # noqa: E731, B023
        told = i // 150
        data.append(("t" if i % 10 else "u", i, ts, float(ts), i * rnd.choice([0, 1, 1, 1]), 800.0, volume, 10.0, 10.0, level(bid, -1), level(bid + rnd.choice([5, 5, 5, 5, -5]), 1), told, float(ts - 50) if told else None))
    ladder = "array<struct<price_paise: bigint, price: double, quantity: bigint, orders: bigint>>"
    raw = spark.createDataFrame(data, f"token string, seq bigint, exchange_timestamp_ms bigint, clock_ms double, sequence_number bigint, last_traded_price double, volume_traded_today bigint, total_buy_quantity double, total_sell_quantity double, bids {ladder}, asks {ladder}, notices bigint, notice_clock double")

    def run(rows, recovery=True, tail=1):
        monkeypatch.setattr(stretches, "ROWS", rows)
        monkeypatch.setattr(stretches, "TAIL", tail)
        return sorted(engine.sequence(raw, Engine(validation=Validation(stale_recovery=recovery))).withColumn("task", F.spark_partition_id()).collect(), key=lambda r: (r.token, r.seq))

    plain = lambda rows: [str(r.asDict() | {"task": 0}) for r in rows]
    whole, cut = run(10**9), run(20)
    assert plain(whole) == plain(cut) and plain(run(10**9, False)) == plain(run(20, False))  # without recovery all rows after a stale one are stale
    assert {r.reject_reason for r in cut} >= {None, "STALE_TIMESTAMP", "NON_MONOTONIC_TIMESTAMP", "VOLUME_REGRESSION", "CROSSED_BOOK"} and max(r.segment or 0 for r in cut) > 20
    assert len({r.task for r in cut if r.token == "t"}) > 2


def test_invariants_look_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(stretches, "ROWS", 30)
    rows = [r.asDict() for r in catalog.QUERIES["invariants"](spark, SF).collect()]
    assert len(rows) == 4 and not any(v for r in rows for k, v in r.items() if k != "token")


LADDER = "array<struct<price_paise: bigint, price: double, quantity: bigint, orders: bigint>>"


def steady(spark, n, step, faults=lambda i: None):
    """n snapshots of a token, step ms apart; faults(i) tells of one row that it is crossed, or how late it is (ms)."""
    data = []
    for i in range(n):
        fault, crossed = faults(i), faults(i) == "crossed"
        ts = 1_000_000 + step * i + (0 if fault is None or crossed else fault)
        ladder = lambda p, q: [(p + 5 * k * q, (p + 5 * k * q) / 100, 300, 3) for k in range(5)]
        data.append(("t", i + 1, ts, float(ts), i, 800.0, 5 * i, 10.0, 10.0, ladder(80000, -1), ladder(79995 if crossed else 80005, 1)))
    return spark.createDataFrame(data, f"token string, seq bigint, exchange_timestamp_ms bigint, clock_ms double, sequence_number bigint, last_traded_price double, volume_traded_today bigint, total_buy_quantity double, total_sell_quantity double, bids {LADDER}, asks {LADDER}")


def reads(spark, monkeypatch):
    """Rows of the largest task of each pass of the gate."""
    frame = type(spark.range(1))
    found, real = [], frame.mapInArrow

    def spied(df, f, schema, *rest, **kw):
        if schema == "token string, block bigint, end binary":
            found.append(max((r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()), default=0))
        return real(df, f, schema, *rest, **kw)

    monkeypatch.setattr(frame, "mapInArrow", spied)
    return found


def cut_and_whole(spark, monkeypatch, raw, cfg, rows):
    """What `sequence` gives with blocks of so many rows and in one pass, and the rows of the stretches."""
    out = []
    for n in (10**9, rows):
        monkeypatch.setattr(stretches, "ROWS", n)
        monkeypatch.setattr(stretches, "TAIL", 3)
        out.append(sorted(str(r.asDict()) for r in engine.sequence(raw, cfg).collect()))
    df = kernel.dealt(book.structural(engine.clocked(raw).withColumns({"notices": F.lit(0).cast("long"), "notice_clock": F.lit(None).cast("double")}), cfg), cfg)[0]
    return out, [r["count"] for r in df.groupBy("stretch").count().collect()]


def test_the_first_row_of_a_block_is_none_of_its_last(spark, monkeypatch):
    """168 rows in nine blocks: 56 / (168 / 9) is 3, but leaves nearly a whole block as its remainder."""
    found = reads(spark, monkeypatch)
    (whole, cut), _ = cut_and_whole(spark, monkeypatch, steady(spark, 168, 1000), Engine(validation=Validation(stale_recovery=False)), 20)
    assert whole == cut
    assert len(found) == 4  # two passes each time it's dealt: the tails, and the blocks from right starts


@pytest.mark.parametrize("faults", [lambda i: "crossed" if 130 <= i < 700 else None, lambda i: 9000 if i >= 130 else None, lambda i: "crossed" if i < 700 else None])
def test_blocks_of_rejected_rows_are_neither_a_task_nor_read_in_turn(spark, monkeypatch, faults):
    """Crossed rows, which change nothing, and rows that stay stale without recovery, over many blocks of 20 rows."""
    found = reads(spark, monkeypatch)
    (whole, cut), sizes = cut_and_whole(spark, monkeypatch, steady(spark, 800, 100, faults), Engine(validation=Validation(stale_recovery=False)), 20)
    assert whole == cut
    assert max(sizes) <= 200 and len(found) < 2 * 12 and max(found[1:]) < 500
