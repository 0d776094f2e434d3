"""Entry signals of the two models, and feature rows. Signals are rows with typed features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import LAGGER, LEADER, bps_move, event_order, mid, spread_bps
from tickloom.operators.asof import Timeline, asof_lookback
from tickloom.operators.windows import basis_samples, cooldown_thin, ewm_basis, pair_frame, rolling_basis_mean, with_basis


@dataclass(frozen=True)
class Costs:
    fee_bps: float = 0.0
    slippage_bps: float = 0.0
    safety_bps: float = 2.0

    @property
    def total(self) -> float:
        return self.fee_bps + self.slippage_bps + self.safety_bps


def residual_frame(quotes: DataFrame, window_ms: int = 180_000, samples: int = 120, beta: float = 1.0, min_sigma: float = 0.5, leader: str = LEADER, lagger: str = LAGGER) -> DataFrame:
    """Basis samples with what the residual model knows before each: mean, sigma, z and the leader's last move.

    The mean is the weighted one; where that is exactly 0, the rolling one. position is the number of earlier samples.
    """
    own = rolling_basis_mean(ewm_basis(basis_samples(quotes, leader, lagger, beta), window_ms), samples)
    mean = F.coalesce(F.nullif(F.col("prior_mean"), F.lit(0.0)), F.col("rolling_mean"), F.lit(0.0))
    sigma = F.greatest(F.sqrt(F.greatest(F.coalesce("prior_var", F.lit(0.0)), F.lit(0.0))), F.lit(min_sigma))
    own = own.withColumn("mean", mean).withColumn("sigma", sigma).withColumn("z", (F.col("basis") - F.col("mean")) / F.col("sigma"))
    return own.withColumn("leader_move_bps", F.when(F.col("leader_before").isNotNull(), bps_move(F.col("leader.mid"), F.col("leader_before.mid"))))


def residual_signals(
    quotes: DataFrame, z_entry: float = 2.2, min_samples: int = 10, costs: Costs = Costs(), min_edge_bps: float = 0.0, cooldown_ms: int = 1000, ttl_ms: int = 3000, window_ms: int = 180_000, samples: int = 120, beta: float = 1.0, min_sigma: float = 0.5
) -> DataFrame:
    """Intents where the leader moved and the lagger's residual lies far on the other side of its mean."""
    own = residual_frame(quotes, window_ms, samples, beta, min_sigma)
    edge = F.abs(F.col("basis") - F.col("mean")) - F.lit(costs.total)
    up, down = (F.col("leader_move_bps") > 0) & (F.col("z") <= -z_entry), (F.col("leader_move_bps") < 0) & (F.col("z") >= z_entry)
    own = own.withColumn("edge_bps", edge).where((F.col("position") >= min_samples) & F.col("leader_move_bps").isNotNull() & (F.col("edge_bps") > min_edge_bps) & (up | down))
    side = F.when(F.col("leader_move_bps") > 0, "buy").otherwise("sell")
    rows = own.select(
        "row_no", "symbol", "ts", F.lit("residual_zscore").alias("model"), side.alias("side"), F.when(side == "buy", F.col("lagger.ask")).otherwise(F.col("lagger.bid")).alias("price_cap"), "edge_bps",
        F.col("z").alias("z_score"), "basis", "mean", "sigma", "leader_move_bps", F.lit(float(beta)).alias("beta"), F.lit(ttl_ms).alias("ttl_ms"),
    )
    return cooldown_thin(rows, cooldown_ms)


def impulse_frame(quotes: DataFrame, windows_ms: tuple[int, ...] = (50, 100, 200, 500), leader: str = LEADER, lagger: str = LAGGER, timelines: dict[str, Timeline] | None = None) -> DataFrame:
    """Each tick with both venues' latest quotes, each with its own stream's mids one window back, and the latest values of timelines."""
    backs = {f"back_{w}": w for w in windows_ms}
    own = asof_lookback(quotes.withColumn("mid", mid()), backs, F.col("mid"))
    return pair_frame(own, leader, lagger, ["local_ts_ms", "row_no", "mid", "bid", "ask", *backs], timelines).where("position >= 0")


def impulse_signals(
    quotes: DataFrame, windows_ms: tuple[int, ...] = (50, 100, 200, 500), min_impulse_bps: float = 2.0, beta: float = 1.0, costs: Costs = Costs(), min_edge_bps: float = 0.0, cooldown_ms: int = 1000, ttl_ms: int = 3000,
    trades: DataFrame | None = None, min_trade_qty: float | None = None, depth: DataFrame | None = None, min_imbalance: float | None = None,
) -> DataFrame:
    """Intents where the leader's impulse has not reached the lagger; of the windows that pass the first in order counts.

    With min_trade_qty the leader's latest trade, and with min_imbalance its latest book (imbalance column), must
    agree and be no older than the window.
    """
    timelines = {}
    if min_trade_qty is not None:
        timelines["trade"] = Timeline(trades.where(F.col("venue") == LEADER), F.struct("local_ts_ms", "side", "qty"))
    if min_imbalance is not None:
        timelines["book"] = Timeline(depth.where(F.col("venue") == LEADER), F.struct("local_ts_ms", "imbalance"))
    own = impulse_frame(quotes, windows_ms, timelines=timelines).withColumn("ts", F.greatest("leader.local_ts_ms", "lagger.local_ts_ms"))
    found = F.coalesce(*(_window_signal(w, min_impulse_bps, beta, costs.total, min_edge_bps, min_trade_qty, min_imbalance) for w in windows_ms))
    rows = own.withColumn("s", found).where("s IS NOT NULL")
    side = F.when(F.col("s.impulse_bps") > 0, "buy").otherwise("sell")
    rows = rows.select(
        "row_no", "symbol", "ts", F.lit("impulse_transfer").alias("model"), side.alias("side"), F.when(side == "buy", F.col("lagger.ask")).otherwise(F.col("lagger.bid")).alias("price_cap"),
        F.col("s.edge_bps"), F.col("s.window_ms"), F.col("s.impulse_bps"), F.col("s.lagger_move_bps"), F.col("s.lag_bps"), F.lit(ttl_ms).alias("ttl_ms"),
    )
    return cooldown_thin(rows, cooldown_ms)


def _window_signal(w: int, min_impulse: float, beta: float, cost: float, min_edge: float, min_trade_qty: float | None, min_imbalance: float | None) -> Column:
    impulse = bps_move(F.col("leader.mid"), F.col(f"leader.back_{w}"))
    moved = bps_move(F.col("lagger.mid"), F.col(f"lagger.back_{w}"))
    lag = F.lit(beta) * impulse - moved
    edge = F.abs(lag) - cost
    known = F.col(f"leader.back_{w}").isNotNull() & F.col(f"lagger.back_{w}").isNotNull()
    passes = known & (F.abs(impulse) >= min_impulse) & (edge > min_edge) & (((impulse > 0) & (lag > 0)) | ((impulse < 0) & (lag < 0)))
    if min_trade_qty is not None:
        passes &= F.coalesce((F.col("ts") - F.col("trade.local_ts_ms") <= w) & (F.col("trade.qty") >= min_trade_qty) & (F.col("trade.side") == F.when(impulse > 0, "buy").otherwise("sell")), F.lit(False))
    if min_imbalance is not None:
        leaning = F.when(impulse > 0, F.col("book.imbalance") >= min_imbalance).otherwise(F.col("book.imbalance") <= -min_imbalance)
        passes &= F.coalesce((F.col("ts") - F.col("book.local_ts_ms") <= w) & leaning, F.lit(False))
    return F.when(passes, F.struct(F.lit(w).alias("window_ms"), impulse.alias("impulse_bps"), moved.alias("lagger_move_bps"), lag.alias("lag_bps"), edge.alias("edge_bps")))


def feature_snapshots(quotes: DataFrame, depth: DataFrame | None = None, residual_window_ms: int | None = None, beta: float = 1.0) -> DataFrame:
    """A feature row per tick: impulse, spread, latency, volatility and, with books, imbalance; with a window, residual_bps.

    The residual is the basis less its weighted mean before the tick: null where that mean is 0, but the basis itself at the first
    sample of a symbol. Latency is the distance of the venues' clocks, or while only one venue is known its own clock against the exchange's.
    """
    books = {"book": Timeline(depth.where(F.col("venue") == LEADER), F.struct("imbalance"))} if depth is not None else {}
    pairs = pair_frame(quotes.withColumn("mid", mid()), LEADER, LAGGER, ["local_ts_ms", "exchange_ts_ms", "mid", "bid", "ask"], books)
    pairs = pairs.withColumn("imbalance", F.col("book.imbalance")) if books else pairs
    if residual_window_ms is not None:
        own = ewm_basis(with_basis(pairs, beta).withColumn("ts", F.coalesce("ts", F.col("local_ts_ms"))), residual_window_ms)
        residual = F.when(F.col("position") == 0, F.col("basis")).when(F.col("prior_mean") != 0, F.col("basis") - F.col("prior_mean"))
        pairs = own.withColumn("residual_bps", residual)
    one_clock = lambda v: F.when(F.col(v).isNotNull() & F.col(f"{v}.exchange_ts_ms").isNotNull(), F.col(f"{v}.local_ts_ms") - F.col(f"{v}.exchange_ts_ms"))
    both = F.col("leader").isNotNull() & F.col("lagger").isNotNull()
    latency = F.when(both, F.abs(F.col("leader.local_ts_ms") - F.col("lagger.local_ts_ms"))).otherwise(F.coalesce(one_clock("leader"), one_clock("lagger")))
    return pairs.select(
        "row_no", "symbol", F.col("local_ts_ms").alias("ts"), bps_move(F.col("leader.mid"), F.col("leader_before.mid")).alias("impulse_bps"),
        F.when(F.col("lagger").isNotNull(), spread_bps("lagger.bid", "lagger.ask")).alias("spread_bps"), F.abs(bps_move(F.col("lagger.mid"), F.col("lagger_before.mid"))).alias("volatility_bps"),
        latency.alias("latency_ms"), *(["imbalance"] if depth is not None else []), *(["residual_bps"] if residual_window_ms is not None else []),
    )
