"""Streaming queries: views landed as files, processed with availableNow, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scratch import kept
from tickloom.plans import desk
from tickloom.plans.market import HOUR
from tickloom.plans.registry import ORACLES, Tables, query
from tickloom.plans.reporting import _HEALTH
from tickloom.sources.store import scratch
from tickloom.streaming import online


def _landed(t: Tables, df: DataFrame) -> DataFrame:
    """A stream over df, written whole."""
    path = scratch(t.spark, "landed")
    df.write.parquet(path)
    return online.stream_quotes(t.spark, path, df.schema)


def _fed(t: Tables, df: DataFrame, order: str, stretches: int, run: Callable[[DataFrame], object]) -> None:
    """Lands df in ascending stretches of order; after each, run takes up the stream from its checkpoint, so a stretch is a batch.

    The rows are computed once, and tasks write the files of a stretch side by side.
    """
    own, path = kept(df, "arriving"), scratch(t.spark, "landed")
    cuts = [None, *own.approxQuantile(order, [k / stretches for k in range(1, stretches)], 0.01), None]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = own if lo is None else own.where(F.col(order) >= lo)
        (part if hi is None else part.where(F.col(order) < hi)).write.mode("append").parquet(path)
        run(online.stream_quotes(t.spark, path, own.schema))


def _appended(t: Tables, df: DataFrame) -> DataFrame:
    target = scratch(t.spark, "appended")
    online.run_available(df, target, scratch(t.spark, "checkpoint"))
    return t.spark.read.schema(df.schema).parquet(target)


def _appended_fed(t: Tables, df: DataFrame, order: str, stretches: int, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that the stream of(landed rows) has appended when all of df has landed."""
    target, checkpoint = scratch(t.spark, "appended"), scratch(t.spark, "checkpoint")
    _fed(t, df, order, stretches, lambda landed: online.run_available(of(landed), target, checkpoint))
    return t.spark.read.schema(of(df).schema).parquet(target)


def _updated_fed(t: Tables, df: DataFrame, order: str, stretches: int, of: Callable[[DataFrame], DataFrame], keys: list[str], newest: str, many_keys: bool = False) -> DataFrame:
    """The last row of each key of the update-mode stream of(landed rows)."""
    target, checkpoint = scratch(t.spark, "updates"), scratch(t.spark, "checkpoint")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(online.batch_path(target, n))
    _fed(t, df, order, stretches, lambda landed: online.run_batches(of(landed), write, checkpoint, many_keys=many_keys))
    own = t.spark.read.schema(of(df).schema).parquet(target)
    return own.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in own.columns if c not in (*keys, "batch"))), newest).alias("s")).select(*keys, "s.*")


@query("stream_quotes", "SELECT row_no, symbol FROM quotes", "quotes")
def stream_quotes(t: Tables) -> DataFrame:
    return _appended(t, _landed(t, t.quotes).select("row_no", "symbol"))


@query("stream_latency_alerts", "SELECT row_no, symbol, venue FROM quotes WHERE local_ts_ms - exchange_ts_ms > 30", "quotes")
def stream_latency_alerts(t: Tables) -> DataFrame:
    return _appended(t, online.stream_latency_alerts(_landed(t, t.quotes), 30).select("row_no", "symbol", "venue"))


@query("stream_feed_health", f"WITH {_HEALTH} SELECT * FROM h", "quotes")
def stream_feed_health(t: Tables) -> DataFrame:
    return _updated_fed(t, t.quotes, "local_ts_ms", 3, lambda q: online.stream_feed_health(q, 3 * HOUR), ["venue", "symbol"], "event_count")


@query(
    "stream_stale_alerts",
    f"""WITH b AS (SELECT min(local_ts_ms) AS lo, max(local_ts_ms) AS hi FROM quotes), e AS (SELECT venue, symbol, local_ts_ms AS ts, true AS tick FROM quotes UNION ALL SELECT venue, symbol, lo, false FROM (SELECT DISTINCT venue, symbol FROM quotes UNION ALL SELECT 'binance', 'NEWUSDT'), b),
 g AS (SELECT *, lead(ts) OVER (PARTITION BY venue, symbol ORDER BY ts, tick) AS later FROM e) SELECT venue, symbol, CASE WHEN tick THEN 'feed_stale' ELSE 'feed_missing' END AS alert_type, 'critical' AS severity, CASE WHEN tick THEN 'required_feed_stale' ELSE 'required_feed_missing' END AS reason, ts AS last_ts_ms FROM g, b WHERE coalesce(later, hi) - ts > {3 * HOUR}""",
    "quotes",
)
def stream_stale_alerts(t: Tables) -> DataFrame:
    streams = t.quotes.select("venue", "symbol").distinct().unionByName(t.spark.createDataFrame([("binance", "NEWUSDT")], "venue string, symbol string"))
    required = streams.crossJoin(t.quotes.agg(F.min("local_ts_ms").alias("from_ts_ms")))
    required = _landed(t, required)
    return _appended_fed(t, t.quotes, "local_ts_ms", 4, lambda q: online.stream_stale_alerts(q, 3 * HOUR, required))


@query("stream_order_state", desk.MIXED_FINAL, "order_updates", "open_orders")
def stream_order_state(t: Tables) -> DataFrame:
    """Updates of all kinds, with venue ids, reasons and prices of 0, in two batches."""
    return _updated_fed(t, desk.mixed_updates(t), "row_no", 2, lambda u: online.stream_order_state(u, t.open_orders), ["client_order_id"], "updates", many_keys=True).drop("updates")


@query("stream_signals")
def stream_signals(t: Tables) -> DataFrame:
    """Both models over the same ticks."""
    quotes = t.quotes

    def of(found: DataFrame, model: str, strength: str, digits: int) -> DataFrame:
        return found.select(F.lit(model).alias("model"), "row_no", "symbol", "ts", "side", F.round("edge_bps", digits).alias("edge_bps"), F.round(strength, digits).alias("strength"))

    fed = lambda f: _appended_fed(t, quotes, "local_ts_ms", 3, f)
    residual = of(fed(lambda q: online.stream_signals(q, 1.5, 12 * HOUR, 2 * HOUR)), "residual_zscore", "z_score", 3)
    return residual.unionByName(of(fed(lambda q: online.stream_impulse_signals(q, strategy.WINDOWS, 20.0, 2 * HOUR)), "impulse_transfer", "impulse_bps", 4))


@query("stream_audit_sink", "SELECT row_no, symbol, decision_result FROM audit", "audit")
def stream_audit_sink(t: Tables) -> DataFrame:
    target = scratch(t.spark, "audit-sink")
    own = _landed(t, t.audit).select("row_no", "symbol", "decision_result")
    online.stream_audit_sink(own, target, scratch(t.spark, "checkpoint"))
    return t.spark.read.schema(own.schema).parquet(target)


@query("stream_run_summary", "SELECT count(*) FILTER (event_type = 'replay_signal_decision') AS intents, count(*) FILTER (event_type = 'replay_position_exit') AS closed_positions, round(sum(realized_pnl_usd), 2) AS realized_pnl_usd FROM audit", "audit")
def stream_run_summary(t: Tables) -> DataFrame:
    target, checkpoint = scratch(t.spark, "summaries"), scratch(t.spark, "checkpoint")
    audit = t.audit.select("timestamp_ms", "event_type", "risk_allowed", "fill_filled", "gross_pnl_usd", "cost_usd", "realized_pnl_usd")
    _fed(t, audit, "timestamp_ms", 3, lambda landed: online.stream_run_summary(landed, target, checkpoint))
    return t.spark.read.parquet(target).agg(F.sum("intents").alias("intents"), F.sum("closed_positions").alias("closed_positions"), F.round(F.sum("realized_pnl_usd"), 2).alias("realized_pnl_usd"))


@query(
    "stream_hourly_slippage",
    "WITH h AS (SELECT date_trunc('hour', make_timestamp(timestamp_ms * 1000)) AS hour, count(*) AS fills, sum(slippage_bps) AS s FROM audit WHERE fill_filled GROUP BY 1), m AS (SELECT make_timestamp(max(timestamp_ms) * 1000) - INTERVAL 1 HOUR AS mark FROM audit WHERE fill_filled) SELECT CAST(epoch_us(hour) // 1000 AS BIGINT) AS hour_ms, fills, round(s, 4) AS total_slippage_bps FROM h, m WHERE hour + INTERVAL 1 HOUR <= mark",
    "audit",
)
def stream_hourly_slippage(t: Tables) -> DataFrame:
    own = _appended_fed(t, t.audit.select("timestamp_ms", "fill_filled", "slippage_bps"), "timestamp_ms", 2, online.stream_hourly_slippage)
    return own.select(F.unix_millis("hour").alias("hour_ms"), "fills", F.round("total_slippage_bps", 4).alias("total_slippage_bps"))


# the online signals are held to the SQL of the batch ones
from tickloom.plans import strategy  # noqa: E402

ORACLES["stream_signals"] = (
    "SELECT 'residual_zscore' AS model, row_no, symbol, ts, side, edge_bps, z_score AS strength FROM (" + ORACLES["residual_signals"] + ") UNION ALL "
    "SELECT 'impulse_transfer', row_no, symbol, ts, side, edge_bps, impulse_bps FROM (" + ORACLES["impulse_signals"] + ")"
)
