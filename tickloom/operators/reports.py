"""Research reports: aggregates over audit rows, exits and quotes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import LAGGER, spread_bps, volatility_regime

EXIT, DECISION = "replay_position_exit", "replay_signal_decision"


def exits(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("event_type") == EXIT)


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def total(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def replay_counts(events: DataFrame, intents: DataFrame) -> DataFrame:
    """One row: events processed, quotes, others skipped, intents, and intents by model (a map; a missing model is unknown)."""
    counts = events.agg(F.count("*").alias("processed"), F.count_if(F.col("event_type") == "book_ticker").alias("quotes"), F.count_if(F.col("event_type") != "book_ticker").alias("skipped"))
    models = intents.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).count()
    return counts.crossJoin(models.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("intents"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "count")))).alias("intent_counts")))


def run_summary(audit: DataFrame) -> DataFrame:
    """One pass over a run's audit rows."""
    decided, closed = F.col("event_type") == DECISION, F.col("event_type") == EXIT
    count = lambda c: F.count_if(decided & c)
    return audit.agg(
        F.count_if(decided).alias("intents"), count(F.col("risk_allowed")).alias("risk_allowed"), count(~F.col("risk_allowed")).alias("risk_blocked"), count(F.col("fill_filled")).alias("fills"),
        count(F.col("risk_allowed") & ~F.col("fill_filled")).alias("not_filled"), F.count_if(closed).alias("closed_positions"), (count(F.col("fill_filled")) - F.count_if(closed)).alias("open_positions"),
        total(F.when(closed, F.col("gross_pnl_usd"))).alias("gross_realized_pnl_usd"), total(F.when(closed, F.col("cost_usd"))).alias("realized_cost_usd"), total(F.when(closed, F.col("realized_pnl_usd"))).alias("realized_pnl_usd"),
    )


def symbol_day_slices(audit: DataFrame) -> DataFrame:
    """Counts, sums and histograms (maps) by symbol and UTC day of each row's own time."""
    own = audit.withColumn("day", F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd"))
    decided, closed = F.col("event_type") == DECISION, F.col("event_type") == EXIT
    keys = ["symbol", "day"]
    sums = own.groupBy(*keys).agg(
        F.count("*").alias("records"), F.count_if(decided).alias("signals"), F.count_if(decided & F.coalesce("fill_filled", F.lit(False))).alias("entry_fills"), F.count_if(decided & ~F.col("risk_allowed")).alias("risk_blocked"), F.count_if(closed).alias("exits"),
        total(F.when(closed, F.col("gross_pnl_usd"))).alias("gross_realized_pnl_usd"), total(F.when(closed, F.col("cost_usd"))).alias("realized_cost_usd"), total(F.when(closed, F.col("realized_pnl_usd"))).alias("realized_pnl_usd"),
    )
    histogram = lambda df, c, name: df.groupBy(*keys, c).count().groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count")))).alias(name))
    reasons = histogram(own.where(closed).withColumn("reason", F.coalesce("exit_reason", F.lit("unknown"))), "reason", "exit_reasons")
    return sums.join(histogram(own, "model", "models"), keys, "left").join(reasons, keys, "left")


def catch_up_metrics(rows: DataFrame) -> DataFrame:
    """Holding times of winning take-profit and mean-reversion exits; percentiles by nearest rank, half to even."""
    good = rows.where("exit_reason IN ('take_profit', 'zscore_mean_reversion') AND realized_pnl_usd > 0 AND timestamp_ms >= entry_ts_ms").select((F.col("timestamp_ms") - F.col("entry_ts_ms")).alias("ms"))
    # times are counted in ranges that widen with their length, then singly in the ranges that hold a percentile
    width = F.pow(F.lit(2), F.greatest(F.lit(0), F.floor(F.log2(F.col("ms") + 1)) - 10)).cast("long")
    counts = good.groupBy("ms").agg(F.count("*").alias("n")).withColumn("range", F.col("ms") - F.col("ms") % width)
    sums = counts.groupBy("range").agg(F.sum("n").alias("n"))
    whole = F.broadcast(sums.agg(F.sum("n").alias("all")))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range"))  # 1,024 ranges for each doubling of the time
    rank = lambda p: F.bround((F.col("all") - 1) * F.lit(p))
    ends = sums.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n")).crossJoin(whole)
    held = ends.where(reduce(or_, ((F.col("below") <= rank(p)) & (F.col("upto") > rank(p)) for p in (0.5, 0.9))))
    inner = counts.join(F.broadcast(held.select("range", "below", "all")), "range").withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("range").orderBy("ms")))
    at = lambda p: F.min(F.when(F.col("upto") > rank(p), F.col("ms")))
    marks = inner.agg(at(0.5).alias("p50_ms"), at(0.9).alias("p90_ms"))
    total_ = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("catch_up_exits"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.floor(F.sum(F.col("ms") * F.col("n")) / F.sum("n")).alias("avg_ms"))
    return total_.crossJoin(marks)


def false_positive_rate(rows: DataFrame) -> DataFrame:
    bad = F.count_if(F.coalesce("realized_pnl_usd", F.lit(0.0)) <= 0)
    return rows.agg(F.count("*").alias("closed_trades"), bad.alias("false_positives"), ratio(bad, F.count("*")).alias("false_positive_rate"))


def slippage_by_hour(audit: DataFrame) -> DataFrame:
    own = audit.where("fill_filled").withColumn("hour_utc", F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:00:00'Z'"))
    slip = F.coalesce("slippage_bps", F.lit(0.0))
    return own.groupBy("hour_utc").agg(F.count("*").alias("fills"), F.sum(slip).alias("total_slippage_bps"), F.avg(slip).alias("avg_slippage_bps"), total("cost_usd").alias("total_cost_usd"))


def performance_by(rows: DataFrame, key: Column) -> DataFrame:
    wins = F.count_if(F.col("realized_pnl_usd") > 0)
    return rows.groupBy(key).agg(F.count("*").alias("closed_trades"), wins.alias("winning_trades"), total("realized_pnl_usd").alias("realized_pnl_usd"), ratio(total("realized_pnl_usd"), F.count("*")).alias("avg_realized_pnl_usd"), ratio(wins, F.count("*")).alias("win_rate"))


def performance_by_regime(rows: DataFrame) -> DataFrame:
    return performance_by(rows, volatility_regime().alias("regime"))


def cost_sensitivity(rows: DataFrame, bps: list[float]) -> DataFrame:
    """Net profit at each cost level, with the round-trip notional and the cost that would consume all profit."""
    sums = rows.agg(total("gross_pnl_usd").alias("gross"), total(2 * F.col("notional")).alias("round_trip_notional"))
    own = sums.withColumn("cost_bps", F.explode(F.array(*(F.lit(float(b)) for b in bps))))
    return own.select("cost_bps", "round_trip_notional", ratio(10000 * F.col("gross"), F.col("round_trip_notional")).alias("break_even_bps"), (F.col("gross") - F.col("round_trip_notional") * F.col("cost_bps") / 10000).alias("net_pnl_usd"))


def closed_trade_stats(audit: DataFrame, starting_balance: float) -> DataFrame:
    closed = audit.where("decision_result = 'closed'")
    wins = F.count_if(F.col("realized_pnl_usd") > 0)
    return closed.agg(F.count("*").alias("closed_trades"), wins.alias("winning_trades"), (100 * ratio(wins, F.count("*"))).alias("win_rate_pct"), (100 * total("realized_pnl_usd") / starting_balance).alias("pnl_pct"))


def liquidity_spread_avg(quotes: DataFrame, lagger: str = LAGGER) -> DataFrame:
    """Average spread and top-of-book dollars of the lagging venue; rows without both sizes have no dollars."""
    usd = F.when(F.col("bid_size").isNotNull() & F.col("ask_size").isNotNull(), F.least(F.col("bid") * F.col("bid_size"), F.col("ask") * F.col("ask_size")))
    return quotes.where(F.col("venue") == lagger).groupBy("symbol").agg(F.coalesce(F.avg(spread_bps()), F.lit(0.0)).alias("avg_spread_bps"), F.coalesce(F.avg(usd), F.lit(0.0)).alias("avg_liquidity_usd"))


def pair_venues(quotes: DataFrame, leader: str = "binance", lagger: str = LAGGER) -> DataFrame:
    is_lead, is_lag = F.col("venue") == leader, F.col("venue") == lagger
    return quotes.groupBy("symbol").agg(F.count_if(is_lead).alias("leader_quotes"), F.count_if(is_lag).alias("lagger_quotes"), F.min(F.when(is_lead, F.col("local_ts_ms"))).alias("leader_first"), F.min(F.when(is_lag, F.col("local_ts_ms"))).alias("lagger_first"))


def fills_compare(paper: DataFrame, demo: DataFrame) -> DataFrame:
    """Full outer comparison by client id; of repeated ids the last row (row_no) counts."""
    last = lambda df, x: df.groupBy("client_order_id").agg(F.max_by(F.struct("qty", "price"), "row_no").alias(x))
    own = last(paper, "p").join(last(demo, "d"), "client_order_id", "full_outer")
    status = F.when(F.col("d").isNull(), "unmatched_paper").when(F.col("p").isNull(), "unmatched_demo").otherwise("matched")
    return own.select("client_order_id", status.alias("status"), F.col("p.qty").alias("paper_qty"), F.col("d.qty").alias("demo_qty"), (F.col("d.qty") - F.col("p.qty")).alias("qty_diff"), (F.col("d.price") - F.col("p.price")).alias("price_diff"))


def fills_compare_summary(compared: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return compared.agg(is_("matched").alias("matched"), is_("unmatched_paper").alias("unmatched_paper"), is_("unmatched_demo").alias("unmatched_demo"), F.count_if(F.col("qty_diff") != 0).alias("qty_mismatches"), F.count_if(F.col("price_diff") != 0).alias("price_mismatches"))


def summary_diff(a: DataFrame, b: DataFrame, money: list[str], counts: list[str], tolerance: float, total_of: list[str] | None = None, intent_counts: str | None = None) -> DataFrame:
    """(run, metric, a, b, delta, mismatch, reason) of two summary tables by run; a missing value counts as 0.

    total_of: columns of money whose sum is one more metric, total_net_pnl_usd. intent_counts: a map column of counts by
    model, each a metric of its own. reason names what is off and is null where nothing is.
    """
    columns = [*money, *(["total_net_pnl_usd"] if total_of else []), *counts]

    def long(df: DataFrame, name: str) -> DataFrame:
        if total_of:
            df = df.withColumn("total_net_pnl_usd", sum((F.coalesce(F.col(c), F.lit(0)) for c in total_of[1:]), F.coalesce(F.col(total_of[0]), F.lit(0))))
        own = df.select("run", *(F.col(c).cast("double").alias(c) for c in columns)).unpivot("run", columns, "metric", name)
        if intent_counts:
            models = df.select("run", F.explode(intent_counts).alias("model", name))
            own = own.unionByName(models.select("run", F.concat(F.lit("intents:"), "model").alias("metric"), F.col(name).cast("double").alias(name)))
        return own

    own = long(a, "a").join(long(b, "b"), ["run", "metric"], "full_outer").select("run", "metric", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    delta = F.col("b") - F.col("a")
    off = F.when(F.col("metric").isin(columns[: len(columns) - len(counts)]), F.abs(delta) > tolerance).otherwise(delta != 0)
    by_model = F.col("metric").startswith("intents:")
    reason = F.when(by_model, F.concat(F.lit("intent_count_delta:"), F.substring("metric", 9, 1 << 30))).otherwise(F.concat("metric", F.lit("_delta")))
    return own.withColumn("delta", delta).withColumn("mismatch", off).withColumn("reason", F.when(F.col("mismatch"), reason))


def summary_verdict(diff: DataFrame) -> DataFrame:
    """One row a run of summary_diff: matched, mismatch_count and mismatch_reasons, sorted."""
    return diff.groupBy("run").agg((~F.bool_or("mismatch")).alias("matched"), F.count_if("mismatch").alias("mismatch_count"), F.array_sort(F.collect_list("reason")).alias("mismatch_reasons"))


def daily_summary(audit: DataFrame, alerts: DataFrame, compared: DataFrame, updates: DataFrame, health: DataFrame, marks: DataFrame) -> DataFrame:
    """One row a day: counts and sums of each input by its day column, joined; absent days count 0, their health is unknown.

    updates: audit records of reconciliation_audit. health: status of each probe, of which the worst counts. marks:
    unrealized_pnl_usd of what is open at the day's end.
    """
    decided, closed = F.col("event_type") == DECISION, F.col("event_type") == EXIT
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    fills = F.count_if(decided & F.col("fill_filled"))
    worst = F.max(F.struct(F.array_position(F.array(*(F.lit(x) for x in ("ok", "unknown", "critical"))), F.col("status")).alias("rank"), "status"))["status"]
    parts = [
        audit.groupBy("day").agg(
            F.count_if(decided).alias("intents"), fills.alias("fills"), F.count_if(closed).alias("closed_positions"), (fills - F.count_if(closed)).alias("open_positions"), total(F.when(closed, F.col("realized_pnl_usd"))).alias("realized_pnl_usd"),
            F.count_distinct("symbol").alias("symbol_days"),
        ),
        marks.groupBy("day").agg(total("unrealized_pnl_usd").alias("unrealized_pnl_usd")),
        alerts.groupBy("day").agg(F.count("*").alias("alerts"), is_("severity", "critical").alias("critical_alerts")),
        compared.groupBy("day").agg(is_("status", "matched").alias("matched_fills"), is_("status", "unmatched_paper").alias("unmatched_paper"), is_("status", "unmatched_demo").alias("unmatched_demo")),
        updates.groupBy("day").agg(
            F.count_distinct(F.when(F.col("decision_result") == "order_reconciled", F.col("client_order_id"))).alias("orders"), is_("decision_result", "position_snapshot").alias("positions"), is_("decision_result", "balance_snapshot").alias("balances"), F.count("*").alias("audit_records")
        ),
        health.groupBy("day").agg(worst.alias("health_status")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "day", "full_outer")
    return out.fillna(0).fillna("unknown", ["health_status"])
