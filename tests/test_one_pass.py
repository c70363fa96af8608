"""The engine reads accepted rows on from the sequencing kernel in one pass: frames by numpy, whole segments in order, only the columns that are wanted."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookloom import catalog, catalog_trading, tables
from bookloom.catalog_trading import TRADING
from bookloom.operators import batches, scoring, windows
from bookloom.plans import engine
from bookloom.sources.trading import trading_book
from tests.test_dealing import SF, steady


@pytest.mark.parametrize("column", [
    pa.array([1, None, 3], pa.int64()), pa.array([None, None], pa.float64()), pa.array([1.5, float("nan"), None]), pa.array([True, None, False]), pa.array(["a", "b", "a", "a", "a"]), pa.array(["a", None]), pa.array([b"x", None]),
    pa.array([[1, 2], [], [3, None]]), pa.array([[1.5], None]), pa.array([[1, 2], [3], [4, 5, 6]]).slice(1), pa.array([], pa.int32()), pa.array([7, 8], pa.int32()), pa.array(["a", "a", "a", "b"]).slice(1),
])
def test_values_are_those_of_arrow(column):
    got, real = batches.plain(column), column.to_pylist()
    assert str(got) == str(real) and [type(x) for x in got] == [type(x) for x in real]


def test_fields_are_those_of_rows():
    level = pa.struct([("price", pa.float64()), ("quantity", pa.int64())])
    for ladders in ([[(1.0, 2)], [(1.5, None), (2.5, 4)]], [[(1.0, 2)], None, []], [[(1.0, 2), None], [(3.0, 3)]]):
        rows = pa.array([{"token": str(i), "bids": x and [y and {"price": y[0], "quantity": y[1]} for y in x]} for i, x in enumerate(ladders)], pa.struct([("token", pa.string()), ("bids", pa.list_(level))]))
        for part in (rows, rows.slice(1)):
            assert batches.field(part, "token") == [r["token"] for r in part.to_pylist()]
            assert batches.field(part, "bids.quantity") == [r["bids"] and [x and x["quantity"] for x in r["bids"]] for r in part.to_pylist()]


@pytest.mark.parametrize("per_batch", ["10000", "7"])
def test_frames_by_numpy_are_those_of_window_functions(spark, per_batch):
    """Segments of one row, of some, and longer than a frame, in batches of many rows or of fewer than a frame."""
    late = {i: 9000 for i in (5, 6, 7, 40)}
    df = engine.sequence(steady(spark, 700, 300, late.get), TRADING).where("reject_reason IS NULL")
    # Values that move, some of them missing.
    df = df.withColumns({"obi": F.when(F.col("seq") % 11 != 3, F.sin(F.col("seq") * 1.7)), "spread_ticks": 1.0 + F.col("seq") % 7 / 3, "depth": 50.0 + F.col("seq") % 13, "mid": F.col("mid") + F.col("seq") % 5 * 0.05, "momentum": F.cos("seq"), "acceleration": F.when(F.col("seq") % 3 != 0, F.sin("seq")), "tick": F.lit(0.007)})
    df = tables.cut(df, "moving")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        got = {(r.token, r.seq): r.asDict() for r in windows.rolled(df, TRADING).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = scoring.dispersions(windows.shared_statistics(df, TRADING), TRADING).collect()
    assert len(want) == len(got) > 650 and set(want[0].asDict()) == set(next(iter(got.values()))) and len({r.segment for r in want}) == 3
    for r in want:
        for k, x in r.asDict().items():
            y = got[r.token, r.seq][k]
            assert math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12) if isinstance(x, float) and y is not None else x == y, (r.seq, k, x, y)


def test_the_engine_reads_no_sliding_frame_again_for_each_row(spark):
    df = engine.decided(trading_book(spark, SF), TRADING)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")
    assert "specifiedwindowframe(RowFrame, -" not in plan


def taken(spark, monkeypatch):
    """The columns of rows that go through each kernel."""
    frame = type(spark.range(1))
    found, real = [], frame.mapInArrow

    def spied(df, f, schema, *rest, **kw):
        if df.schema[0].dataType.typeName() == "struct":
            found.append(df.schema[0].dataType.names)
        return real(df, f, schema, *rest, **kw)

    monkeypatch.setattr(frame, "mapInArrow", spied)
    return found


def test_kernels_are_handed_wanted_columns_alone(spark, monkeypatch):
    found = taken(spark, monkeypatch)
    catalog.QUERIES["trading_composite"](spark, SF)
    sequencing, rolling, deciding = found
    assert deciding == ["token", "seq"] and "open_price" not in sequencing + rolling and "total_buy_quantity" not in sequencing + rolling
    found.clear()
    catalog.QUERIES["position_pnl"](spark, SF)
    assert len(found) == 3 and "feats" not in found[2] and {"bids", "asks", "tick"} <= set(found[2])
    found.clear()
    catalog.QUERIES["own_features"](spark, SF)  # its features don't tell what they read
    assert "open_price" in found[0]


def test_few_rows_of_many_tokens_are_dealt_by_their_number(spark, monkeypatch):
    """No token has more rows than a block; tasks are as many as rows ask for, not as the session has."""
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    assert engine.sequence(trading_book(spark, SF), TRADING).rdd.getNumPartitions() == 20
    assert len(catalog_trading.q_composite(spark, SF).collect()) == 1000
