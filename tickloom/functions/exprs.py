"""Column functions on quotes, books, symbols and trade results. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10000.0
#: Venue that quotes first, and venue that follows.
LEADER, LAGGER = "binance", "mexc"


def first_set(*columns: str | Column) -> Column:
    """First value that is neither null nor 0, else 0: zero counts as missing in timestamps."""
    own = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in own), F.lit(0).cast("long"))


def event_ts(local: str = "local_ts_ms", exchange: str = "exchange_ts_ms") -> Column:
    return first_set(local, exchange)


def event_order(local: str = "local_ts_ms", exchange: str = "exchange_ts_ms") -> list[Column]:
    """Total order of events: time, exchange time, venue, symbol, arrival."""
    return [event_ts(local, exchange), first_set(exchange), F.col("venue"), F.col("symbol"), F.col("row_no")]


def mid(bid: str = "bid", ask: str = "ask") -> Column:
    return (F.col(bid) + F.col(ask)) / 2


def spread_bps(bid: str = "bid", ask: str = "ask") -> Column:
    middle = mid(bid, ask)
    return F.when(middle > 0, BPS * (F.col(ask) - F.col(bid)) / middle).otherwise(F.lit(float("inf")))


def bps_move(current: Column, previous: Column) -> Column:
    return F.when(previous <= 0, F.lit(0.0)).otherwise(BPS * (current - previous) / previous)


def log_basis_bps(leader_mid: Column, lagger_mid: Column, beta: float = 1.0) -> Column:
    return BPS * (F.ln(lagger_mid) - F.lit(beta) * F.ln(leader_mid))


def _side_total(levels: str, top: int, value) -> Column:
    return F.aggregate(F.slice(levels, 1, top), F.lit(0.0), lambda total, x: total + value(x))


def book_imbalance(top: int = 5, bids: str = "bids", asks: str = "asks") -> Column:
    """(bid - ask) / (bid + ask) quantity of the top levels; 0 for an empty book."""
    bid, ask = (_side_total(c, top, lambda x: x["qty"]) for c in (bids, asks))
    return F.when(bid + ask > 0, (bid - ask) / (bid + ask)).otherwise(F.lit(0.0))


def top_depth_usd(top: int, contract_size: float = 1.0, bids: str = "bids", asks: str = "asks") -> Column:
    bid, ask = (_side_total(c, top, lambda x: x["price"] * x["qty"] * contract_size) for c in (bids, asks))
    return F.least(bid, ask)


def canonical_symbol(symbol: str | Column) -> Column:
    return F.upper(F.translate(symbol, "-_/", ""))


def contract_symbol(symbol: str | Column) -> Column:
    """Spelling of the following venue's perpetuals: BTCUSDT is BTC_USDT."""
    own = F.upper(F.translate(symbol, "-/", "__"))
    bare = own.endswith("USDT") & ~own.contains("_")
    return F.when(bare, F.concat(F.regexp_replace(own, "USDT$", ""), F.lit("_USDT"))).otherwise(own)


def volatility_regime(impulse: str = "impulse_bps", entry_impulse: Column | None = None) -> Column:
    """low under 5 bps, medium under 20, else high; an impulse of 0 falls through to the entry's."""
    size = F.abs(F.coalesce(F.nullif(F.col(impulse), F.lit(0.0)), entry_impulse if entry_impulse is not None else F.lit(None).cast("double")))
    return F.when(size.isNull(), "unknown").when(size < 5, "low").when(size < 20, "medium").otherwise("high")


def trade_result(decision: str = "decision_result", pnl: str = "realized_pnl_usd") -> Column:
    p = F.col(pnl)
    closed = F.when(p.isNull(), "closed").when(p > 0, "profit").when(p < 0, "loss").otherwise("flat")
    return _by_decision(F.col(decision), closed, F.coalesce(F.nullif(F.col(decision), F.lit("")), F.lit("unknown")))


def trade_success(decision: str = "decision_result", pnl: str = "realized_pnl_usd") -> Column:
    p = F.col(pnl)
    return _by_decision(F.col(decision), F.when(p.isNull(), "unknown").when(p > 0, "yes").otherwise("no"), F.lit("unknown"))


def _by_decision(decision: Column, closed: Column, other: Column) -> Column:
    return F.when(decision == "closed", closed).when(decision == "filled", "open").when(decision == "risk_blocked", "blocked").when(decision == "not_filled", "not filled").otherwise(other)


def is_multiple(value: str, step: str) -> Column:
    """Exact in decimals; a missing or non-positive step allows everything."""
    v, s = (F.col(c).cast("decimal(38,18)") for c in (value, step))
    return F.when(s > 0, F.when(s > 0, v % F.nullif(s, F.lit(0).cast("decimal(38,18)"))) == 0).otherwise(F.lit(True))


def order_style(edge: str, taker_min: float, maker_min: float) -> Column:
    return F.when(F.col(edge) >= maker_min, "passive_limit").when(F.col(edge) >= taker_min, "aggressive_limit").otherwise("rejected")


def client_order_id(intent_id: str = "intent_id", prefix: str = "llb-") -> Column:
    return F.substring(F.concat(F.lit(prefix), F.regexp_replace(intent_id, r"[^\p{L}\p{N}]", "-")), 1, 64)


# fixed values: key names that hold secrets
SECRET_KEYS = "(?i)(api[_-]?key|secret|token|signature|authorization|password)"


def redact_map(column: str) -> Column:
    return F.transform_values(column, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit("***REDACTED***")).otherwise(v))


def pnl_values(side: str, entry: str, exit_: str | Column, qty: str, cost_bps: float) -> tuple[Column, Column, Column, Column]:
    """Gross, cost, net and gross in bps of a round trip."""
    exit_price = F.col(exit_) if isinstance(exit_, str) else exit_
    gross = F.when(F.col(side) == "buy", exit_price - F.col(entry)).otherwise(F.col(entry) - exit_price) * F.col(qty)
    opened = F.abs(F.col(entry) * F.col(qty))
    cost = (opened + F.abs(exit_price * F.col(qty))) * F.lit(max(cost_bps, 0.0)) / BPS
    return gross, cost, gross - cost, F.when(opened > 0, BPS * gross / opened).otherwise(F.lit(0.0))
