"""Which symbols to trade: joined liquidity snapshots, hard filters, scores, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import canonical_symbol, contract_symbol, spread_bps

# fixed values: upper bounds that scale each term of the score to 0..1, and the terms' weights
BOUNDS = {"volume": 100_000_000.0, "depth": 1_000_000.0, "spread": 30.0, "tick": 10.0, "fee": 20.0, "noise": 50.0, "cost": 10.0}
WEIGHTS = {"volume": 0.30, "depth": 0.20, "spread": -0.15, "tick": -0.10, "fee": -0.10, "noise": -0.10, "cost": -0.05}


def build_symbol_profiles(symbols: DataFrame, profile: str) -> DataFrame:
    """symbol -> canonical, leader and lagger spelling and both markets, for spot_to_spot or perp_to_perp."""
    if profile not in ("spot_to_spot", "perp_to_perp"):
        raise ValueError(f"unknown profile {profile}")
    perp = profile == "perp_to_perp"
    own = canonical_symbol("symbol")
    market = F.lit("usdt_perp" if perp else "spot")
    return symbols.select(own.alias("canonical_symbol"), own.alias("leader_symbol"), (contract_symbol(own) if perp else own).alias("lagger_symbol"), F.lit(profile).alias("profile"), market.alias("leader_market"), market.alias("lagger_market"))


def intersect_snapshots(leader_info: DataFrame, leader_stats: DataFrame, leader_book: DataFrame, lagger_info: DataFrame, lagger_stats: DataFrame, lagger_book: DataFrame) -> DataFrame:
    """Symbols that all six snapshots (symbol, struct column) have, with the six structs."""
    out = leader_info
    for other in (leader_stats, leader_book, lagger_info, lagger_stats, lagger_book):
        out = out.join(other, "symbol")
    return out


def coarse_top_k(rows: DataFrame, k: int, leader_volume: str = "leader_volume", lagger_volume: str = "lagger_volume") -> DataFrame:
    """The k symbols with the largest smaller volume, ties by name: what is worth a depth lookup."""
    return rows.orderBy(F.least(leader_volume, lagger_volume).desc(), F.col("symbol")).limit(k)


def fee_budget_bps(maker_rate: str = "maker_fee_rate", taker_rate: str = "taker_fee_rate") -> Column:
    """Maker plus taker fee; a missing or zero maker is 0 and a missing or zero taker 6 bps."""
    bps = lambda c: F.nullif(10000.0 * F.col(c), F.lit(0.0))
    return F.coalesce(bps(maker_rate), F.lit(0.0)) + F.coalesce(bps(taker_rate), F.lit(6.0))


def universe_candidates(joined: DataFrame) -> DataFrame:
    """Metrics of joined snapshots (info, stats and book structs of both venues, and depth_usd of both)."""
    middle = (F.col("lagger_book.bid") + F.col("lagger_book.ask")) / 2
    tick = F.coalesce("lagger_info.price_tick", F.lit(0.0))
    return joined.select(
        "symbol", F.col("leader_info.trading_enabled").alias("leader_enabled"), F.col("lagger_info.trading_enabled").alias("lagger_enabled"), F.col("lagger_info.api_allowed").alias("api_allowed"),
        F.col("leader_stats.quote_volume").alias("leader_volume"), F.col("lagger_stats.quote_volume").alias("lagger_volume"), F.col("leader_depth").alias("leader_depth"), F.col("lagger_depth").alias("lagger_depth"),
        spread_bps("leader_book.bid", "leader_book.ask").alias("leader_spread_bps"), spread_bps("lagger_book.bid", "lagger_book.ask").alias("lagger_spread_bps"),
        (10000.0 * tick / F.when(middle > 0, middle).otherwise(1.0)).alias("tick_bps"), fee_budget_bps("lagger_info.maker_fee_rate", "lagger_info.taker_fee_rate").alias("fee_bps"), F.lit(0.0).alias("noise_bps"), F.lit(1.0).alias("cost"),
    )


def universe_filter(candidates: DataFrame, min_volume: float, max_spread: float, min_depth: float, max_tick: float) -> DataFrame:
    """candidates with allowed and the first reason against."""
    reason = (
        F.when(~F.col("leader_enabled"), "leader_trading_disabled").when(~F.col("lagger_enabled"), "lagger_trading_disabled").when(~F.col("api_allowed"), "lagger_api_not_allowed")
        .when(F.least("leader_volume", "lagger_volume") < min_volume, "quote_volume_too_low").when(F.greatest("leader_spread_bps", "lagger_spread_bps") > max_spread, "spread_too_wide")
        .when(F.least("leader_depth", "lagger_depth") < min_depth, "top5_depth_too_low").when(F.col("tick_bps") > max_tick, "mexc_tick_too_coarse").otherwise("ok")
    )
    return candidates.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "ok")


def universe_score() -> Column:
    terms = {
        "volume": F.least("leader_volume", "lagger_volume"), "depth": F.least("leader_depth", "lagger_depth"), "spread": F.greatest("leader_spread_bps", "lagger_spread_bps"),
        "tick": F.col("tick_bps"), "fee": F.col("fee_bps"), "noise": F.col("noise_bps"), "cost": F.col("cost"),
    }
    total = F.lit(0.0)
    for name, value in terms.items():
        total += F.lit(WEIGHTS[name]) * F.least(F.greatest(value / BOUNDS[name], F.lit(0.0)), F.lit(1.0))
    return total


def universe_rank(candidates: DataFrame, top_n: int) -> DataFrame:
    """The top_n candidates with score and rank, ties by symbol."""
    own = candidates.withColumn("score", universe_score()).orderBy(F.col("score").desc(), "symbol").limit(top_n)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "symbol")))


def universe_profiles(ranked: DataFrame, info: DataFrame, profile: str) -> DataFrame:
    """Ranked symbols with spelling, order constraints and fees in bps; text metadata as a map."""
    spelled = build_symbol_profiles(ranked.select("symbol"), profile).withColumnRenamed("canonical_symbol", "symbol")
    own = ranked.join(spelled, "symbol").join(info, "symbol")
    meta = F.create_map(F.lit("universe_score"), F.col("score").cast("string"), F.lit("filter_reason"), F.col("reason"), F.lit("tick_size_bps_mexc"), F.col("tick_bps").cast("string"))
    return own.select("symbol", "leader_symbol", "lagger_symbol", "rank", "min_qty", "qty_step", "price_tick", "min_notional", (10000.0 * F.col("maker_fee_rate")).alias("maker_fee_bps"), (10000.0 * F.col("taker_fee_rate")).alias("taker_fee_bps"), meta.alias("metadata"))


def live_profiles_top_n(profiles: DataFrame, top_n: int, max_active: int | None = None) -> DataFrame:
    """The first profiles by score (text; not a number counts as 0), ties by symbol."""
    limit = max(0, top_n if max_active is None else min(top_n, max_active))
    score = F.coalesce(F.expr("try_cast(universe_score AS DOUBLE)"), F.lit(0.0))
    return profiles.withColumn("score", score).orderBy(F.col("score").desc(), "symbol").limit(limit)


def universe_rotation(current: DataFrame, ranked: DataFrame, top_n: int, max_active: int | None = None) -> DataFrame:
    """(action, symbol): keep, subscribe or unsubscribe, from the current symbols to the next selection."""
    chosen = live_profiles_top_n(ranked, top_n, max_active).select("symbol")
    now = current.select("symbol").distinct()
    mark = lambda df, action: df.select(F.lit(action).alias("action"), "symbol")
    return mark(now.join(chosen, "symbol", "left_semi"), "keep").unionByName(mark(chosen.join(now, "symbol", "left_anti"), "subscribe")).unionByName(mark(now.join(chosen, "symbol", "left_anti"), "unsubscribe"))


def symbol_selection(leadership: DataFrame, liquidity: DataFrame, pnl: DataFrame, top_n: int = 20) -> DataFrame:
    """Symbols by (stable, selection score, profit): lag stability, liquidity, spread and paper profit weighed."""
    own = leadership.join(liquidity, "symbol", "left").join(pnl, "symbol", "left").fillna({"avg_spread_bps": 0.0, "avg_liquidity_usd": 0.0, "realized_pnl_usd": 0.0})
    score = 0.55 * F.when(F.col("stable"), F.col("leader_score")).otherwise(0.0) + 0.20 * F.least(F.col("avg_liquidity_usd") / 100_000, F.lit(1.0)) - 0.15 * F.least(F.col("avg_spread_bps") / 20, F.lit(1.0)) + 0.10 * F.greatest(F.lit(-1.0), F.least(F.col("realized_pnl_usd") / 10, F.lit(1.0)))
    return own.withColumn("selection_score", score).orderBy(F.col("stable").desc(), F.col("selection_score").desc(), F.col("realized_pnl_usd").desc(), "symbol").limit(top_n)
