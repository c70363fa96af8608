"""Modelled fills, round-trip costs, the cost gate and profit and loss, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.config import Engine
from bookloom.functions.scalar import bps_to_ticks, col, round_to_tick, safe_div, ticks_to_bps
from bookloom.operators.book import depth_walk


def entry_offset(cfg: Engine) -> Column:
    e = cfg.execution
    return F.lit(e.entry_aggression_ticks) if e.entry_aggression_ticks is not None else bps_to_ticks(F.lit(e.entry_aggression_bps), "mid", "tick")


def exit_offset(cfg: Engine) -> Column:
    e = cfg.execution
    return F.lit(e.exit_slippage_ticks) if e.exit_slippage_ticks is not None else bps_to_ticks(F.lit(e.exit_slippage_bps), "mid", "tick")


def round_trip(buy, sell, quantity, cfg: Engine) -> Column:
    """struct(brokerage, exchange, sebi, stt, stamp, gst, rupees, bps, ticks) of buying and selling a quantity."""
    e = cfg.execution
    bought, sold, q = col(buy) * col(quantity), col(sell) * col(quantity), col(quantity)
    leg = lambda turnover: F.least(turnover * e.brokerage_rate, F.lit(e.brokerage_flat), F.lit(e.brokerage_cap))
    brokerage, exchange, sebi = leg(bought) + leg(sold), (bought + sold) * e.exchange_rate, (bought + sold) * e.sebi_rate
    stt, stamp = sold * e.stt_sell_rate, bought * e.stamp_buy_rate
    gst = (brokerage + exchange + sebi) * e.gst_rate
    rupees = brokerage + exchange + stt + stamp + sebi + gst
    parts = {"brokerage": brokerage, "exchange": exchange, "sebi": sebi, "stt": stt, "stamp": stamp, "gst": gst, "rupees": rupees}
    parts |= {"bps": safe_div(rupees * 10_000.0, (bought + sold) / 2), "ticks": safe_div(rupees, q * F.col("tick"))}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


class ExecutionModel:
    """How orders are taken to fill, what a round trip costs, and what an open position is worth: the touch, moved against us by an offset.

    Another model overrides any of the methods; all are Column builders over a row's ladders, tick and lot, so a model
    stays in generated code. side is the ladder that an order meets, buying its direction.
    """

    def fill(self, side: str, buying: bool, quantity: Column, offset_ticks: Column, cfg: Engine) -> Column:
        """struct(price, filled): on the tick grid, never better than the touch."""
        touch, tick = F.get(side, 0)["price"], F.col("tick")
        walked = depth_walk(side, quantity)
        base = walked["price"] if cfg.execution.use_depth_walk else touch
        filled = walked["filled"] if cfg.execution.use_depth_walk else quantity
        moved = round_to_tick(base + offset_ticks * tick if buying else base - offset_ticks * tick, "tick")
        return F.struct((F.greatest if buying else F.least)(moved, touch).alias("price"), filled.alias("filled"))

    def entry(self, side: str, buying: bool, quantity: Column, cfg: Engine) -> Column:
        return self.fill(side, buying, quantity, entry_offset(cfg), cfg)

    def exit(self, side: str, buying: bool, quantity: Column, cfg: Engine) -> Column:
        return self.fill(side, buying, quantity, exit_offset(cfg), cfg)

    def cost(self, buy, sell, quantity, cfg: Engine) -> Column:
        return round_trip(buy, sell, quantity, cfg)

    def clears(self, cfg: Engine) -> Column:
        """Whether the target pays for costs and spread with the margin asked for."""
        cost = self.cost(F.get("asks", 0)["price"], F.get("bids", 0)["price"], F.col("lot"), cfg)
        target = ticks_to_bps(F.lit(cfg.state_machine.target_ticks), "mid", "tick")
        return target >= (cost["bps"] + ticks_to_bps("spread_ticks", "mid", "tick")) * cfg.execution.min_edge_multiple

    def profit(self, cfg: Engine) -> Column:
        """struct(gross_ticks, gross_rupees, cost_rupees, net_rupees, net_bps, holding_ms) of a position marked at exit_price; null without one."""
        d, q, entry, exit_ = F.col("direction"), F.col("quantity"), F.col("entry_price"), F.col("exit_price")
        cost = self.cost(F.when(d > 0, entry).otherwise(exit_), F.when(d > 0, exit_).otherwise(entry), q, cfg)["rupees"]
        gross = (exit_ - entry) * d * q
        fields = {"gross_ticks": safe_div((exit_ - entry) * d, F.col("tick")), "gross_rupees": gross, "cost_rupees": cost, "net_rupees": gross - cost, "net_bps": safe_div((gross - cost) * 10_000.0, entry * q), "holding_ms": F.col("clock_ms") - F.col("entry_clock_ms")}
        return F.when(exit_.isNotNull() & d.isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))

    def marked(self, df: DataFrame, cfg: Engine) -> DataFrame:
        """Adds exit_price, what the position's own quantity would get out at (from the row after its entry on), and pnl."""
        held = F.col("direction").isNotNull() & ~F.col("opened")
        out = F.when(F.col("direction") > 0, self.exit("bids", False, F.col("quantity"), cfg)["price"]).otherwise(self.exit("asks", True, F.col("quantity"), cfg)["price"])
        return df.withColumn("exit_price", F.when(held, out)).withColumn("pnl", self.profit(cfg))


class DepthWalk(ExecutionModel):
    """Orders eat into the ladder level by level at each level's own price: large ones pay more, and ones larger than the visible book are filled in part. Nothing is added for aggression or slippage, and a partly filled position is marked by its own quantity."""

    def fill(self, side: str, buying: bool, quantity: Column, offset_ticks: Column, cfg: Engine) -> Column:
        walked = depth_walk(side, quantity)
        return F.struct(walked["price"].alias("price"), walked["filled"].alias("filled"))


TOUCH = ExecutionModel()
