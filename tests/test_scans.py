"""Two-level scans against plain loops: sums, lags, averages, sliding order statistics and the ordered digest."""

import math
import random

import pytest
from pyspark.sql import functions as F

from bookloom.operators import order_statistics, reports, scan
from bookloom.operators.kernel import Ema
from bookloom.sources.derived import derived_book

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """A key with nearly all rows, a few small ones, and no order in the table."""
    rnd = random.Random(4)
    data = [("hot", i, rnd.gauss(100, 5), rnd.choice([0.0, 50.0, 200.0, 9000.0]), i % 400 == 0) for i in range(3000)] + [(k, i, float(i), 100.0, i == 0) for k in "abc" for i in range(5)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "k string, at long, x double, dt double, fresh boolean"), sorted(data)


@pytest.mark.parametrize("count", [1, 7])
def test_running_sums_and_lags(rows, count):
    df, data = rows
    got = {(r.k, r.at): r for r in scan.lagged(scan.running(df, "k", ["at"], {"n": F.lit(1), "odd": F.col("at") % 2}, count), "k", ["at"], {"before": "x", "was": "at"}, count).collect()}
    assert len(got) == len(data)
    n, odd, last = {}, {}, {}
    for k, at, x, _, _ in data:
        n[k], odd[k] = n.get(k, 0) + 1, odd.get(k, 0) + at % 2
        r = got[k, at]
        assert (r.n, r.odd, r.before, r.was) == (n[k], odd[k], *last.get(k, (None, None)))
        last[k] = (x, at)


@pytest.mark.parametrize("count", [1, 9])
def test_averages_by_blocks_equal_the_kernel(rows, count):
    df, data = rows
    got = {(r.k, r.at): r for r in scan.time_averages(df, "k", ["at"], F.col("fresh"), F.col("dt"), {"fast": (F.col("x"), 300.0), "slow": (F.col("x"), 4000.0)}, 5000.0, count).collect()}
    state = {}
    for k, at, x, dt, fresh in data:
        if fresh:
            state[k] = Ema(300.0, 5000.0), Ema(4000.0, 5000.0)
        want = [e.add(x, dt) for e in state[k]]
        assert [got[k, at].fast, got[k, at].slow] == pytest.approx(want, abs=1e-9)


def test_one_key_is_in_as_many_tasks_as_there_are_blocks(rows, spark):
    """Task sizes follow the number of blocks, not the sizes of keys."""
    df, _ = rows
    for count in (4, 12):
        held = scan.blocks(df, "k", ["at"], count).groupBy(scan.BLOCK).count().collect()
        assert len(held) == count and max(r["count"] for r in held) < 2.5 * 3015 / count
    # What is dealt by the token alone is a row for each token and block.
    plan = derived_book(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RangePartitioning" not in plan and plan.count("Window [") <= 2


def test_affine_maps_compose():
    a, b = scan.affine_block(*(__import__("numpy").array(x, float) for x in ([2, 0, 3, 1], [1, 5, 1, -4])))
    x, want = 7.0, []
    for p, q in zip([2, 0, 3, 1], [1, 5, 1, -4], strict=True):
        x = p * x + q
        want.append(x)
    assert [p * 7.0 + q for p, q in zip(a, b, strict=True)] == want


@pytest.mark.parametrize("size, block", [(1, 10), (50, 16), (8192, 700)])
def test_sliding_percentiles_equal_their_definition(rows, size, block):
    df, data = rows
    got = {(r.k, r.at): tuple(r)[2:] for r in order_statistics.sliding_percentiles(df, "k", "at", "x", size, block).collect()}
    of = {}
    for k, at, x, _, _ in data:
        of.setdefault(k, []).append(x)
        if at % 37 == 0 or k != "hot":
            s = sorted(of[k][-size:])
            assert got[k, at] == (len(s), *(s[min(len(s) - 1, math.floor(len(s) * f))] for f in (0.5, 0.9, 0.99)), s[-1])
    assert len(got) == len(data)
    assert order_statistics.sliding_percentiles(df.withColumn("x", F.lit(None).cast("double")), "k", "at", "x").count() == 0


def test_digest_counts_order_and_every_field(spark, monkeypatch):
    out = spark.range(1, 301).select(F.lit("t").alias("token"), F.col("id").alias("idx"), F.when(F.col("id") % 7 == 0, "LONG").otherwise("NEUTRAL").alias("state"), F.lit("TREND").alias("regime"), (F.col("id") / 1000.0).alias("smoothed"), F.lit(0.3).alias("entry"))
    of = lambda df: [(r.digest, r.n) for r in reports.decision_digest(df).collect()]
    (one,) = of(out)
    assert one[1] == 300 and len(one[0]) == 64 and of(out.orderBy(F.rand(3)).repartition(5)) == [one]
    place = F.when(F.col("idx") == 10, 11).when(F.col("idx") == 11, 10).otherwise(F.col("idx")).cast("long")
    for changed in (out.withColumn("idx", place), out.where("idx < 300"), out.withColumn("smoothed", F.col("smoothed") + F.when(F.col("idx") == 5, 1e-5).otherwise(0.0)), out.withColumn("state", F.when(F.col("idx") == 9, "SHORT").otherwise(F.col("state")))):
        assert of(changed) != [one]
    assert of(out.limit(0)) == []
    monkeypatch.setattr(reports, "DIGEST_WIDTH", 4)
    assert of(out)[0][1] == 300 and of(out) != [one]  # five levels


def test_digest_has_two_levels_whatever_the_length(spark, monkeypatch):
    """As in the SQL; over DIGEST_WIDTH squared decisions of a token there once were more."""
    import hashlib

    out = spark.range(1, 31).selectExpr("'t' AS token", "id AS idx", "'NEUTRAL' AS state", "'TREND' AS regime", "id / 1000D AS smoothed", "0.3D AS entry")
    monkeypatch.setattr(reports, "DIGEST_WIDTH", 4)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = [sha(f'{{"idx":{i},"state":"NEUTRAL","regime":"TREND","smoothed":{i * 1000},"entry":300000}}') for i in range(1, 31)]
    want = sha("".join(sha("".join(leaves[i : i + 4])) for i in range(0, 30, 4)))
    assert [tuple(r) for r in reports.decision_digest(out).collect()] == [("t", want, 30)]


@pytest.mark.parametrize("count", [9, 16])
def test_each_block_has_a_task_of_its_own(rows, count):
    """Dealt by a hash, some tasks had several blocks and others none."""
    df, data = rows
    for out in (scan.running(df, "k", ["at"], {"n": F.lit(1)}, count), scan.lagged(df, "k", ["at"], {"before": "x"}, count)):
        held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(held) == count and sum(held) == len(data) and max(held) < 2 * len(data) / count
