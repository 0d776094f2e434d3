"""Health of feeds, tables and risk state, and the alerts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import feed_gaps


def latency_alerts(quotes: DataFrame, max_ms: int) -> DataFrame:
    """Alert rows for quotes received later than max_ms after the exchange's time; a missing time raises none."""
    late = F.col("local_ts_ms") - F.col("exchange_ts_ms")
    meta = F.struct("exchange_ts_ms", "local_ts_ms", late.alias("latency_ms"), F.lit(max_ms).alias("max_latency_ms"))
    return quotes.where(late > max_ms).select("row_no", F.lit("feed_latency").alias("alert_type"), F.lit("warning").alias("severity"), F.lit("feed_latency_above_threshold").alias("reason"), "symbol", "venue", meta.alias("metadata"))


def feed_health(quotes: DataFrame, stale_ms: int | None = None) -> DataFrame:
    """venue, symbol, event_count, first_ts_ms, last_ts_ms, max_gap_ms and stale_gap_count of each stream."""
    return feed_gaps(quotes, stale_ms).groupBy("venue", "symbol").agg(
        F.count("*").alias("event_count"), F.min("local_ts_ms").alias("first_ts_ms"), F.max("local_ts_ms").alias("last_ts_ms"), F.max("gap_ms").alias("max_gap_ms"), F.count_if("stale").alias("stale_gap_count")
    )


def missing_streams(required: DataFrame, observed: DataFrame) -> DataFrame:
    return required.select("venue", "symbol").distinct().join(observed.select("venue", "symbol"), ["venue", "symbol"], "left_anti")


def feed_decision(streams: DataFrame, required: DataFrame, stale_ms: int, now_ms: int | None = None) -> DataFrame:
    """Each required stream with its state: missing, stale or ok, and the decision of the whole.

    If any stream is missing the reason is missing_stream and staleness is not looked at. now is the latest
    time seen unless given.
    """
    asked = required.select("venue", "symbol", F.lit(True).alias("_asked")).distinct()
    own = asked.join(streams.select("venue", "symbol", "last_ts_ms"), ["venue", "symbol"], "full")
    mine = F.col("_asked").isNotNull()
    now = F.lit(now_ms).cast("long") if now_ms is not None else F.max("last_ts_ms")
    whole = own.agg(now.alias("now"), F.coalesce(F.bool_or(mine & F.col("last_ts_ms").isNull()), F.lit(False)).alias("any_missing"), F.min(F.when(mine, F.col("last_ts_ms"))).alias("oldest"))  # one row
    own = own.where(mine).crossJoin(F.broadcast(whole))
    old = lambda c: ~F.col("any_missing") & (F.col("now") - F.col(c) > stale_ms)
    state = F.when(F.col("last_ts_ms").isNull(), "missing").when(old("last_ts_ms"), "stale").otherwise("ok")
    reason = F.when(F.col("any_missing"), "missing_stream").when(old("oldest"), "stale_stream").otherwise("ok")
    return own.select("venue", "symbol", "last_ts_ms", state.alias("state"), reason.alias("reason"), (reason == "ok").alias("healthy"))


def feed_alerts(decisions: DataFrame) -> DataFrame:
    """Critical alerts for the missing and stale streams of feed_decision."""
    bad = decisions.where("state <> 'ok'")
    return bad.select(F.concat(F.lit("feed_"), "state").alias("alert_type"), F.lit("critical").alias("severity"), F.concat(F.lit("required_feed_"), "state").alias("reason"), "symbol", "venue")


# fixed values: severity of component states, and risk flags in the order of their reasons
SEVERITY = {"ok": 0, "unknown": 1, "warn": 2, "critical": 3}
RISK_FLAGS = ["kill_switch", "binance_feed_stale", "mexc_feed_stale", "feed_latency_high", "reconnect_storm", "book_desync", "abnormal_cancel_ratio", "repeated_order_errors", "high_slippage", "position_mismatch", "balance_mismatch"]
FLAG_REASONS = {"kill_switch": "manual_kill_switch"}


def reason_of(flag: Column) -> Column:
    return F.when(flag == "kill_switch", "manual_kill_switch").otherwise(flag)


def component_health(runs: DataFrame) -> DataFrame:
    """A row per run and component from runs: run, feed_reason, table_counts (map or null), flags (map to boolean), exposure columns.

    feed is ok or critical; storage unknown without counts; risk critical while any flag is set, with the reasons in order.
    """
    active = F.filter(F.array(*(F.lit(f) for f in RISK_FLAGS)), lambda f: F.coalesce(F.try_element_at(F.col("flags"), f), F.lit(False)))
    reasons = F.transform(active, reason_of)
    none = F.array().cast("array<string>")
    feed = F.struct(F.lit("data_feeds").alias("component"), F.when(F.col("feed_reason") == "ok", "ok").otherwise("critical").alias("status"), F.col("feed_reason").alias("reason"), none.alias("active_blocks"))
    store = F.struct(F.lit("storage").alias("component"), F.when(F.col("table_counts").isNull(), "unknown").otherwise("ok").alias("status"), F.when(F.col("table_counts").isNull(), "storage_not_checked").otherwise("ok").alias("reason"), none.alias("active_blocks"))
    risk = F.struct(F.lit("risk").alias("component"), F.when(F.size(active) > 0, "critical").otherwise("ok").alias("status"), F.when(F.size(active) > 0, "risk_block_active").otherwise("ok").alias("reason"), reasons.alias("active_blocks"))
    return runs.select("run", F.explode(F.array(feed, store, risk)).alias("c")).select("run", "c.*")


def system_health(components: DataFrame) -> DataFrame:
    """Worst state of each run's components: critical, then warn, unknown, ok."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("status")], F.lit(0))
    worst = components.groupBy("run").agg(F.max(rank).alias("rank"), F.count("*").alias("components"))
    return worst.select("run", F.array(*(F.lit(s) for s in SEVERITY))[F.col("rank")].alias("status"), "components")


def component_alerts(components: DataFrame) -> DataFrame:
    """Critical components as alerts; an active risk block is an alert of its own."""
    bad = components.where("status = 'critical'")
    risk = bad.where("component = 'risk'").select("run", F.lit("risk_stop").alias("alert_type"), F.lit("critical").alias("severity"), F.explode("active_blocks").alias("reason"))
    other = bad.where("component <> 'risk'").select("run", F.concat("component", F.lit("_critical")).alias("alert_type"), F.lit("critical").alias("severity"), "reason")
    return risk.unionByName(other)


def alerts_to_risk_flags(alerts: DataFrame) -> DataFrame:
    """Blocking flags of each run from its alerts (run, alert_type, reason, venue, latency_ms); a risk stop sets the flag of its reason."""
    kind, venue = F.col("alert_type"), F.col("venue")
    feed = kind.isin("feed_missing", "feed_stale")
    late = kind == "feed_latency"
    stops = F.array_sort(F.collect_set(F.when(kind == "risk_stop", F.when(F.col("reason") == "manual_kill_switch", "kill_switch").otherwise(F.col("reason")))))
    return alerts.groupBy("run").agg(
        F.coalesce(F.bool_or(late), F.lit(False)).alias("feed_latency_high"),
        F.max_by("latency_ms", F.when(late, F.col("row_no"))).alias("feed_latency_ms"),
        F.coalesce(F.bool_or(feed & (venue == "binance")), F.lit(False)).alias("binance_feed_stale"),
        F.coalesce(F.bool_or(feed & (venue == "mexc")), F.lit(False)).alias("mexc_feed_stale"),
        (~F.coalesce(F.bool_or(kind == "bridge_disconnect"), F.lit(False))).alias("bridge_connected"),
        stops.alias("stops"),
    )


def latest_rows(rows: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """The newest n rows of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where(F.col("_rank") <= n).drop("_rank")
