"""Structured Streaming counterparts of the online operators.

Stateless ones are plain DataFrame functions. State of few keys with many rows each (stream health, signals) is held by
applyInPandasWithState, which spreads keys over executors and restores state from the checkpoint. State of many keys with few rows
each (orders) is a streaming aggregate: no Python call a key.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tickloom.operators.health import latency_alerts
from tickloom.operators.reports import run_summary


def stream_quotes(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """Quotes landed as Parquet files; in production the same plan reads a message log. Bounded runs use run_available."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(df: DataFrame, writer: DataStreamWriter, checkpoint: str, many_keys: bool = False) -> StreamingQuery:
    """Starts a bounded run and waits for it. A new query's state gets two partitions a core; a restarted one keeps its own.

    many_keys: state is kept on disk (RocksDB) and not on the heap.
    """
    spark = df.sparkSession
    own = {"spark.sql.shuffle.partitions": str(2 * spark.sparkContext.defaultParallelism), **({_PROVIDER: _ROCKSDB} if many_keys else {})}
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    query.awaitTermination()
    return query


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what has landed and stops; rows are appended to target as Parquet."""
    return _run(df, df.writeStream.outputMode(mode).format("parquet").option("path", target), checkpoint)


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", many_keys: bool = False) -> StreamingQuery:
    return _run(df, df.writeStream.outputMode(mode).foreachBatch(write), checkpoint, many_keys)


def stream_latency_alerts(quotes: DataFrame, max_ms: int) -> DataFrame:
    return latency_alerts(quotes, max_ms)


_HEALTH = "venue string, symbol string, event_count long, first_ts_ms long, last_ts_ms long, max_gap_ms long, stale_gap_count long"


def stream_feed_health(quotes: DataFrame, stale_ms: int) -> DataFrame:
    """State of each stream after each batch (update mode). Within a batch ticks are taken by time and arrival; a backward clock has gap 0."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(frames)).sort_values(["local_ts_ms", "exchange_ts_ms", "row_no"])["local_ts_ms"].to_numpy()
        count, first, last, widest, stale = state.get if state.exists else (0, int(ticks[0]), int(ticks[0]), 0, 0)
        for ts in ticks.tolist():
            gap = max(0, ts - last)
            widest, stale, last = max(widest, gap), stale + (gap > stale_ms), ts
        state.update((count + len(ticks), first, last, widest, stale))
        yield pd.DataFrame([(*key, count + len(ticks), first, last, widest, stale)], columns=[c.split()[0] for c in _HEALTH.split(", ")])

    own = quotes.select("venue", "symbol", "row_no", "local_ts_ms", "exchange_ts_ms")
    return own.groupBy("venue", "symbol").applyInPandasWithState(update, _HEALTH, "n long, first long, last long, gap long, stale long", "update", GroupStateTimeout.NoTimeout)


_ALERT = "venue string, symbol string, alert_type string, severity string, reason string, last_ts_ms long"


def stream_stale_alerts(quotes: DataFrame, stale_ms: int, required: DataFrame | None = None, watermark: str = "0 seconds") -> DataFrame:
    """An alert for each silence of a stream that lasts longer than stale_ms of event time, wherever batches are cut.

    required: a stream of venue, symbol and from_ts_ms. A required stream that has had no tick stale_ms after that
    raises feed_missing. last_ts_ms is when the silence began.
    """

    def alert(key: tuple, last: int, seen: bool) -> tuple:
        return (*key, "feed_stale" if seen else "feed_missing", "critical", "required_feed_stale" if seen else "required_feed_missing", last)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, told = state.get if state.exists else (None, False, False)
        out = []
        if state.hasTimedOut:
            out.append(alert(key, last, seen))
            told = True
        else:
            ticks = pd.concat(list(frames)).sort_values(["local_ts_ms", "tick"])
            for ts, tick in zip(ticks["local_ts_ms"].tolist(), ticks["tick"].tolist(), strict=True):
                if last is not None and ts - last > stale_ms and not told:
                    out.append(alert(key, last, seen))
                told = told and not tick
                if tick or last is None:
                    last, seen = (ts if last is None else max(ts, last)), seen or tick
        state.update((last, seen, told))
        if not told:
            state.setTimeoutTimestamp(max(last + stale_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ALERT.split(", ")])

    own = quotes.select("venue", "symbol", "local_ts_ms", F.lit(True).alias("tick"))
    if required is not None:
        own = own.unionByName(required.select("venue", "symbol", F.col("from_ts_ms").alias("local_ts_ms"), F.lit(False).alias("tick")))
    own = own.withColumn("at", F.timestamp_millis("local_ts_ms")).withWatermark("at", watermark)
    return own.groupBy("venue", "symbol").applyInPandasWithState(update, _ALERT, "last long, seen boolean, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stream_order_state(updates: DataFrame, known: DataFrame) -> DataFrame:
    """Order states folded from updates in arrival order, as order_state_timeline folds them; known orders (a static table) give
    quantity and first state. Kinds that are no order event change nothing.

    Arrival is the batch, by its time in the log of offsets, then row_no. The last event decides, so each value is that of
    the last row of its kind: one aggregate, whose state is a row an order. updates counts the rows so far.

    updates may lack avg_fill_price, venue_order_id and reason; known may lack venue_order_id and open.
    """
    own = updates
    for name, kind in (("avg_fill_price", "double"), ("venue_order_id", "string"), ("reason", "string")):
        own = own if name in own.columns else own.withColumn(name, F.lit(None).cast(kind))
    given = known.select(
        "client_order_id", "qty", "status", (F.col("venue_order_id") if "venue_order_id" in known.columns else F.lit(None).cast("string")).alias("venue_id"), (F.col("open") if "open" in known.columns else F.col("status").isin("accepted", "unknown")).alias("open")
    )
    own = own.select("client_order_id", "row_no", "event_type", "filled_qty", "avg_fill_price", "venue_order_id", "reason").join(given, "client_order_id")
    kind, at = F.col("event_type"), F.struct(F.current_timestamp().alias("batch"), "row_no")
    last = lambda value, which: F.max_by(value, F.when(which, F.col("_at")))
    filled, price = (F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("filled_qty", "avg_fill_price"))
    states = own.withColumn("_at", at).groupBy("client_order_id").agg(
        F.first(F.struct("qty", "status", "venue_id", "open")).alias("given"), last(kind, kind.isin("fill", "accepted", "cancelled", "rejected")).alias("kind"),
        F.greatest(F.lit(0.0), F.max(F.when(kind == "fill", filled))).alias("filled_qty"), last(price, (kind == "fill") & (price != 0)).alias("avg_fill_price"),
        last(F.col("venue_order_id"), kind.isin("fill", "accepted", "cancelled") & (F.col("venue_order_id") != "")).alias("venue_id"), last(F.col("reason"), kind == "rejected").alias("reject_reason"), F.count("*").alias("updates"),
    )
    status = F.when(F.col("kind") == "fill", F.when(F.col("filled_qty") >= F.col("given.qty"), "filled").otherwise("partially_filled")).otherwise(F.coalesce("kind", "given.status"))
    states = states.withColumn("status", status).withColumn("venue_order_id", F.coalesce("venue_id", "given.venue_id"))
    is_open = F.when(F.col("kind").isNull(), F.col("given.open")).otherwise(F.col("status").isin("accepted", "partially_filled"))
    return states.select("client_order_id", "status", "filled_qty", "avg_fill_price", "venue_order_id", "reject_reason", is_open.alias("open"), "updates")


_SIGNAL = "row_no long, symbol string, ts long, side string, edge_bps double, z_score double"
_SIGNAL_STATE = "leader_ts long, leader_mid double, leader_before double, lagger_ts long, lagger_mid double, mean double, var double, samples long, last_ts long, kept_ts long"


def stream_signals(quotes: DataFrame, z_entry: float, window_ms: int, cooldown_ms: int, min_samples: int = 10, cost_bps: float = 2.0, min_sigma: float = 0.5, leader: str = "binance", lagger: str = "mexc") -> DataFrame:
    """The residual model online, by symbol: the same signals as the batch operator on the same ticks.

    State is a handful of numbers a symbol: latest mids, the weighted moments and the last signal's time. Ticks must
    arrive in batches of ascending time; within a batch they are put in event order.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["local_ts_ms", "exchange_ts_ms", "venue", "row_no"])
        a_ts, a, before, b_ts, b, mean, var, n, last, kept = state.get if state.exists else (None, None, None, None, None, None, 0.0, 0, None, None)
        out = []
        for row_no, ts, venue, mid in zip(rows["row_no"], rows["local_ts_ms"], rows["venue"], (rows["bid"] + rows["ask"]) / 2, strict=True):
            if venue == leader:
                a_ts, a, before = int(ts), float(mid), a
            elif venue == lagger:
                b_ts, b = int(ts), float(mid)
            if a is None or b is None:
                continue
            now, basis = max(a_ts, b_ts), 10000 * (math.log(b) - math.log(a))
            if n >= min_samples and before is not None and (kept is None or now - kept >= cooldown_ms):
                sigma = max(math.sqrt(max(var, 0.0)), min_sigma)
                z, edge, move = (basis - mean) / sigma, abs(basis - mean) - cost_bps, a - before
                if edge > 0 and ((move > 0 and z <= -z_entry) or (move < 0 and z >= z_entry)):
                    kept = now
                    out.append((int(row_no), key[0], now, "buy" if move > 0 else "sell", edge, z))
            alpha = 1.0 if last is None else 1 - math.exp(-max(0, now - last) / window_ms)
            off = basis - (basis if mean is None else mean)
            mean = basis if mean is None else mean + alpha * off
            var, n, last = (1 - alpha) * (var + alpha * off * off), n + 1, now
        state.update((a_ts, a, before, b_ts, b, mean, var, n, last, kept))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SIGNAL.split(", ")])

    own = quotes.select("symbol", "row_no", "venue", "local_ts_ms", "exchange_ts_ms", "bid", "ask")
    return own.groupBy("symbol").applyInPandasWithState(update, _SIGNAL, _SIGNAL_STATE, "append", GroupStateTimeout.NoTimeout)


_IMPULSE = "row_no long, symbol string, ts long, side string, window_ms long, impulse_bps double, edge_bps double, price_cap double"
_IMPULSE_STATE = "leader binary, lagger binary, kept_ts long"


class _Stream:
    """Mids of one stream as far back as the longest window needs, and its latest tick with the mids one window back."""

    def __init__(self, raw: bytes | None, windows: tuple[int, ...]):
        n = len(windows)
        rows = np.frombuffer(raw, np.float64) if raw else np.zeros(0)
        self.windows, self.latest, rest = windows, rows[: 4 + n] if len(rows) else None, rows[4 + n :].reshape(-1, 3)
        self.ts, self.row_no, self.mid = rest[:, 0].tolist(), rest[:, 1].tolist(), rest[:, 2].tolist()

    def take(self, ts: int, row_no: int, bid: float, ask: float) -> None:
        mid = (bid + ask) / 2
        backs = [self.mid[k - 1] if (k := bisect.bisect_right(self.ts, ts - w)) else math.nan for w in self.windows]
        self.latest = np.array([ts, mid, bid, ask, *backs])
        if self.ts and self.ts[-1] == ts:  # of ticks at one time the last by arrival is looked back at
            if row_no > self.row_no[-1]:
                self.row_no[-1], self.mid[-1] = row_no, mid
        else:
            self.ts.append(ts)
            self.row_no.append(row_no)
            self.mid.append(mid)
        old = bisect.bisect_right(self.ts, ts - max(self.windows)) - 1
        if old > 0:
            del self.ts[:old], self.row_no[:old], self.mid[:old]

    def packed(self) -> bytes | None:
        if self.latest is None:
            return None
        return np.concatenate((self.latest, np.array([self.ts, self.row_no, self.mid], np.float64).T.ravel())).tobytes()


def stream_impulse_signals(
    quotes: DataFrame, windows_ms: tuple[int, ...], min_impulse_bps: float, cooldown_ms: int, beta: float = 1.0, cost_bps: float = 2.0, min_edge_bps: float = 0.0, leader: str = "binance", lagger: str = "mexc"
) -> DataFrame:
    """The impulse model online, by symbol: the same signals as the batch operator on the same ticks.

    State is the mids of the longest window in each stream. Ticks must arrive in batches of ascending time.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["local_ts_ms", "exchange_ts_ms", "venue", "row_no"])
        a, b, kept = state.get if state.exists else (None, None, None)
        streams = {leader: _Stream(a, windows_ms), lagger: _Stream(b, windows_ms)}
        out = []
        for row_no, ts, venue, bid, ask in zip(rows["row_no"].tolist(), rows["local_ts_ms"].tolist(), rows["venue"], rows["bid"].tolist(), rows["ask"].tolist(), strict=True):
            if venue not in streams:
                continue
            streams[venue].take(ts, row_no, bid, ask)
            x, y = streams[leader].latest, streams[lagger].latest
            if x is None or y is None:
                continue
            now = int(max(x[0], y[0]))
            if kept is not None and now - kept < cooldown_ms:
                continue
            impulse, moved = 10000 * (x[1] - x[4:]) / x[4:], 10000 * (y[1] - y[4:]) / y[4:]
            lag = beta * impulse - moved
            passes = np.flatnonzero((np.abs(impulse) >= min_impulse_bps) & (np.abs(lag) - cost_bps > min_edge_bps) & (impulse * lag > 0))
            if len(passes):
                k, kept = passes[0], now
                buy = impulse[k] > 0
                out.append((row_no, key[0], now, "buy" if buy else "sell", windows_ms[k], impulse[k], abs(lag[k]) - cost_bps, y[3] if buy else y[2]))
        state.update((streams[leader].packed(), streams[lagger].packed(), kept))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _IMPULSE.split(", ")])

    own = quotes.select("symbol", "row_no", "venue", "local_ts_ms", "exchange_ts_ms", "bid", "ask")
    return own.groupBy("symbol").applyInPandasWithState(update, _IMPULSE, _IMPULSE_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_hourly_slippage(audit: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Tumbling hours over filled rows; an hour is final once the watermark passes it, later rows are dropped."""
    own = audit.where("fill_filled").withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", watermark)
    hours = own.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("fills"), F.sum(F.coalesce("slippage_bps", F.lit(0.0))).alias("total_slippage_bps"))
    return hours.select(F.col("w.start").alias("hour"), "fills", "total_slippage_bps")


def stream_run_summary(audit: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """A progress row for each batch, of the batch's own audit rows; summing the rows gives the run so far."""
    return run_batches(audit, lambda batch, number: run_summary(batch).write.mode("overwrite").parquet(batch_path(target, number)), checkpoint, "append")


def batch_path(target: str, number: int) -> str:
    """Where a batch's rows go: a batch that is replayed after a failure replaces what it wrote before."""
    return f"{target}/batch={number}"


def stream_audit_sink(audit: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Audit rows appended as they come; the checkpoint makes each of them arrive once."""
    return run_available(audit, target, checkpoint)
