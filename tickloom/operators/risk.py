"""Checks before an order: feed flags, the risk gate and order constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import is_multiple
from tickloom.functions.scratch import kept
from tickloom.operators.asof import DAY_MS, HOUR_MS, Timeline, asof_many
from tickloom.operators.health import RISK_FLAGS, reason_of
from tickloom.operators.windows import running_sums


def feed_risk_flags(intents: DataFrame, quotes: DataFrame, stale_ms: int, leader: str = "binance", lagger: str = "mexc") -> DataFrame:
    """intents with leader_stale and lagger_stale: the venue's last tick is missing or older than stale_ms.

    As in feed_decision, while one of the two is missing the other's age is not looked at.
    """
    last = {f"{name}_last_ts": Timeline(quotes.where(F.col("venue") == venue), F.col("local_ts_ms")) for venue, name in ((leader, "leader"), (lagger, "lagger"))}
    own = asof_many(intents, last, ["symbol"], "created_ts_ms")
    missing = F.col("leader_last_ts").isNull() | F.col("lagger_last_ts").isNull()
    for name in ("leader", "lagger"):
        last = F.col(f"{name}_last_ts")
        own = own.withColumn(f"{name}_stale", last.isNull() | (~missing & (F.col("created_ts_ms") - last > stale_ms)))
    return own


def entry_state(intents: DataFrame, fills: DataFrame) -> DataFrame:
    """intents with the state that all fills up to their time leave: open_positions, total_notional, active_symbols and daily_pnl
    (realised since the start of their UTC day) over all symbols, symbol_notional, symbol_active and direction_count (open positions of
    their side) of their own.

    fills: position_id, symbol, side, notional, entry_ts_ms, exit_ts_ms (null while open) and realized_pnl_usd, the amounts as
    decimals so that sums are exact. At one time closings come first, then openings, then intents. Intents and both ends of fills are one
    union, summed once by symbol and once over all symbols by the hour. The intents and their sums are written, since both are
    read several times. Intents without a time leave.
    """
    intents = kept(intents, "intents")
    ends = F.explode(F.array(F.struct(F.col("entry_ts_ms").alias("ts"), F.lit(1).alias("change")), F.struct(F.col("exit_ts_ms").alias("ts"), F.lit(-1).alias("change"))))
    moves = fills.select("position_id", "symbol", F.col("side").alias("_way"), "notional", "realized_pnl_usd", ends.alias("_m"))
    amount = F.col("_m.change") * F.col("notional")
    moves = moves.select(F.col("position_id").alias("_position"), "symbol", "_way", amount.alias("_amount"), F.when(F.col("_m.change") < 0, F.col("realized_pnl_usd")).alias("_pnl"), F.col("_m.ts").alias("_t"), F.col("_m.change").alias("_change"), F.lit(0).alias("_rank"))
    both = intents.withColumn("_t", F.col("created_ts_ms")).withColumn("_rank", F.lit(1)).unionByName(moves, allowMissingColumns=True).where("_t IS NOT NULL")
    order = [F.col("_t"), F.col("_rank"), F.col("_change"), F.col("_position")]
    long = F.when(F.col("_way") == "buy", F.col("_change"))
    own = running_sums(both, ["symbol"], "_t", order, {"symbol_notional": F.col("_amount"), "_long": long, "_short": F.col("_change") - F.coalesce(long, F.lit(0))})
    now = F.col("_long") + F.col("_short")
    woke = F.when((F.col("_change") > 0) & (now == 1), 1).when((F.col("_change") < 0) & (now == 0), -1)
    own = running_sums(own.withColumn("_woke", woke), [], "_t", order, {"open_positions": F.col("_change"), "total_notional": F.col("_amount"), "active_symbols": F.col("_woke"), "_realized": F.col("_pnl")}, chunk_ms=HOUR_MS)
    day = lambda c: F.floor(F.col(c) / DAY_MS)
    days = fills.where("exit_ts_ms IS NOT NULL").groupBy(day("exit_ts_ms").alias("_day")).agg(F.sum("realized_pnl_usd").alias("_of_day"))
    days = days.select("_day", F.sum("_of_day").over(Window.orderBy("_day")).alias("_until"))  # a row for each day
    spans = days.select("_day", F.lead("_day").over(Window.orderBy("_day")).alias("_next"), "_until")
    own = kept(own.where("_rank = 1").withColumn("_own_day", day("_t")), "states")
    asked = own.select("_own_day").distinct().join(spans, (F.col("_day") < F.col("_own_day")) & (F.coalesce("_next", F.col("_own_day")) >= F.col("_own_day")), "left").select("_own_day", "_until")
    own = own.join(asked, "_own_day").withColumn("daily_pnl", F.col("_realized") - F.coalesce("_until", F.lit(0)))
    side = F.when(F.col("side") == "buy", F.col("_long")).otherwise(F.col("_short"))
    return own.withColumn("direction_count", side).withColumn("symbol_active", now > 0).select(*intents.columns, "open_positions", "total_notional", "active_symbols", "daily_pnl", "symbol_notional", "symbol_active", "direction_count")


def risk_gate(rows: DataFrame, max_daily_loss: float, max_open: int, max_symbols: int, max_total: float, max_symbol: float) -> DataFrame:
    """rows (intents with their state at that time) with risk_reason, the first rule that blocks, and allowed.

    State columns: flags (map to boolean), bridge_connected, daily_pnl, open_positions, direction_count, active_symbols,
    symbol_active, total_notional and symbol_notional. All intents here are entries.
    """
    notional = F.abs(F.col("qty") * F.col("price_cap"))
    flagged: Column = F.lit(None).cast("string")
    flagged = F.coalesce(*(F.when(F.coalesce(F.try_element_at("flags", F.lit(f)), F.lit(False)), reason_of(F.lit(f))) for f in RISK_FLAGS))
    reason = F.coalesce(
        flagged,
        F.when(~F.coalesce("bridge_connected", F.lit(True)), "bridge_disconnected")
        .when(F.col("expected_edge_bps") <= 0, "non_positive_edge").when(F.col("daily_pnl") <= -max_daily_loss, "max_daily_loss_reached").when(F.col("open_positions") >= max_open, "max_open_positions_reached")
        .when(F.col("direction_count") > 0, "symbol_direction_position_exists").when(~F.col("symbol_active") & (F.col("active_symbols") >= max_symbols), "max_active_symbols_reached")
        .when(F.col("total_notional") + notional > max_total, "max_total_notional_reached").when(F.col("symbol_notional") + notional > max_symbol, "max_symbol_notional_reached").otherwise("ok"),
    )
    return rows.withColumn("risk_reason", reason).withColumn("allowed", F.col("risk_reason") == "ok")


def validate_orders(intents: DataFrame, profiles: DataFrame) -> DataFrame:
    """intents with the first constraint that fails, or ok. profiles: a small dimension by profile_symbol; steps compare in decimals."""
    own = intents.join(profiles, intents["symbol"] == profiles["profile_symbol"], "left")
    notional = F.abs(F.col("qty") * F.col("price_cap") * F.coalesce("contract_size", F.lit(1.0)))
    reason = (
        F.when(F.col("qty") <= 0, "qty_must_be_positive").when(F.col("price_cap") <= 0, "price_must_be_positive").when(F.col("profile_symbol").isNull(), "symbol_profile_mismatch")
        .when(F.col("qty") < F.col("min_qty"), "qty_below_min").when(~is_multiple("qty", "qty_step"), "qty_step_mismatch").when(~is_multiple("price_cap", "price_tick"), "price_tick_mismatch")
        .when(notional < F.col("min_notional"), "notional_below_min").otherwise("ok")
    )
    return own.withColumn("reason", reason)
