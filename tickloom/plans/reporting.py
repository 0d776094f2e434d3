"""Queries on reports, comparisons and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import LAGGER, pnl_values
from tickloom.operators import health, leadlag, orders, outcomes, reports, universe
from tickloom.plans.desk import raw_updates
from tickloom.plans.fixtures import duck
from tickloom.plans.market import HOUR, ORDER
from tickloom.plans.registry import ORACLES, Tables, query
from tickloom.plans.strategy import _ALIGNED, LAGS

DAY = "strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d')"


def _money(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else c for c in df.columns))


@query("replay_counts", "SELECT count(*) AS processed, count(*) FILTER (raw_type IN ('click','view','signup')) AS quotes, count(*) FILTER (raw_type NOT IN ('click','view','signup')) AS skipped, (SELECT count(*) FROM intents) AS intents, (SELECT count(*) FROM intents WHERE model = 'impulse_transfer') AS impulse_intents, (SELECT count(*) FROM intents WHERE model = 'residual_zscore') AS residual_intents FROM ticks", "ticks", "intents")
def replay_counts(t: Tables) -> DataFrame:
    own = reports.replay_counts(t.ticks.withColumn("event_type", F.when(F.col("raw_type").isin("click", "view", "signup"), "book_ticker").otherwise("other")), t.intents)
    at = lambda m: F.coalesce(F.try_element_at("intent_counts", F.lit(m)), F.lit(0))
    return own.select("processed", "quotes", "skipped", "intents", at("impulse_transfer").alias("impulse_intents"), at("residual_zscore").alias("residual_intents"))


@query(
    "run_summary",
    """WITH d AS (SELECT *, event_type = 'replay_signal_decision' AS dec FROM audit) SELECT count(*) FILTER (dec) AS intents, count(*) FILTER (dec AND risk_allowed) AS risk_allowed, count(*) FILTER (dec AND NOT risk_allowed) AS risk_blocked, count(*) FILTER (dec AND fill_filled) AS fills,
 count(*) FILTER (dec AND risk_allowed AND NOT fill_filled) AS not_filled, count(*) FILTER (NOT dec) AS closed_positions, count(*) FILTER (dec AND fill_filled) - count(*) FILTER (NOT dec) AS open_positions, round(sum(gross_pnl_usd), 2) AS gross_realized_pnl_usd, round(sum(cost_usd), 2) AS realized_cost_usd, round(sum(realized_pnl_usd), 2) AS realized_pnl_usd FROM d""",
    "audit",
)
def run_summary(t: Tables) -> DataFrame:
    return _money(reports.run_summary(t.audit), "gross_realized_pnl_usd", "realized_cost_usd", "realized_pnl_usd", digits=2)


_HEALTH = f"""gp AS (SELECT venue, symbol, local_ts_ms, coalesce(greatest(0, local_ts_ms - lag(local_ts_ms) OVER (PARTITION BY venue, symbol ORDER BY {ORDER})), 0) AS gap FROM quotes),
 h AS (SELECT venue, symbol, count(*) AS event_count, min(local_ts_ms) AS first_ts_ms, max(local_ts_ms) AS last_ts_ms, max(gap) AS max_gap_ms, count(*) FILTER (gap > {3 * HOUR}) AS stale_gap_count FROM gp GROUP BY ALL)"""


@query("feed_health", f"WITH {_HEALTH} SELECT * FROM h", "quotes")
def feed_health(t: Tables) -> DataFrame:
    return health.feed_health(t.quotes, 3 * HOUR)


def _required(t: Tables, missing: bool) -> DataFrame:
    streams = t.quotes.select("venue", "symbol").distinct()
    extra = streams.limit(1).select(F.lit("mexc").alias("venue"), F.lit("S99USDT").alias("symbol"))
    return streams.unionByName(extra) if missing else streams


@query("missing_streams", "SELECT 'mexc' AS venue, 'S99USDT' AS symbol")
def missing_streams(t: Tables) -> DataFrame:
    return health.missing_streams(_required(t, True), t.quotes)


@query("feed_decision", f"WITH {_HEALTH}, n AS (SELECT max(last_ts_ms) AS now FROM h), s AS (SELECT venue, symbol, last_ts_ms, CASE WHEN now - last_ts_ms > {2 * HOUR} THEN 'stale' ELSE 'ok' END AS state FROM h, n) SELECT *, CASE WHEN bool_or(state = 'stale') OVER () THEN 'stale_stream' ELSE 'ok' END AS reason, NOT bool_or(state = 'stale') OVER () AS healthy FROM s", "quotes")
def feed_decision(t: Tables) -> DataFrame:
    return health.feed_decision(health.feed_health(t.quotes), _required(t, False), 2 * HOUR)


_SLICES = f"""a AS (SELECT *, {DAY} AS day, event_type = 'replay_signal_decision' AS dec FROM audit)"""


@query(
    "symbol_day_slices",
    f"""WITH {_SLICES} SELECT symbol, day, count(*) AS records, count(*) FILTER (dec) AS signals, count(*) FILTER (dec AND fill_filled) AS entry_fills, count(*) FILTER (dec AND NOT risk_allowed) AS risk_blocked, count(*) FILTER (NOT dec) AS exits,
 round(coalesce(sum(realized_pnl_usd), 0), 6) AS realized_pnl_usd, count(*) FILTER (exit_reason = 'take_profit') AS take_profits, count(*) FILTER (model = 'impulse_transfer') AS impulse FROM a GROUP BY ALL""",
    "audit",
)
def symbol_day_slices(t: Tables) -> DataFrame:
    own = reports.symbol_day_slices(t.audit)
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return own.select("symbol", "day", "records", "signals", "entry_fills", "risk_blocked", "exits", F.round("realized_pnl_usd", 6).alias("realized_pnl_usd"), at("exit_reasons", "take_profit").alias("take_profits"), at("models", "impulse_transfer").alias("impulse"))


@query("replay_days", f"SELECT DISTINCT {DAY} AS day FROM audit ORDER BY day", "audit")
def replay_days(t: Tables) -> DataFrame:
    return t.audit.select(F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd").alias("day")).distinct().orderBy("day")


@query("pnl_by_symbol", "SELECT symbol, round(sum(realized_pnl_usd), 2) AS realized_pnl_usd FROM audit WHERE event_type = 'replay_position_exit' GROUP BY 1", "audit")
def pnl_by_symbol(t: Tables) -> DataFrame:
    return reports.exits(t.audit).groupBy("symbol").agg(F.round(F.sum("realized_pnl_usd"), 2).alias("realized_pnl_usd"))


@query(
    "catch_up_metrics",
    """WITH g AS (SELECT timestamp_ms - entry_ts_ms AS ms, row_number() OVER (ORDER BY timestamp_ms - entry_ts_ms) - 1 AS k, count(*) OVER () AS n FROM audit WHERE exit_reason IN ('take_profit', 'zscore_mean_reversion') AND realized_pnl_usd > 0 AND timestamp_ms >= entry_ts_ms)
 SELECT count(*) AS catch_up_exits, min(ms) AS min_ms, max(ms) AS max_ms, CAST(floor(avg(ms)) AS BIGINT) AS avg_ms, max(ms) FILTER (k = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS p50_ms, max(ms) FILTER (k = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)) AS p90_ms FROM g""",
    "audit",
)
def catch_up_metrics(t: Tables) -> DataFrame:
    return reports.catch_up_metrics(t.audit)


@query("false_positive_rate", "SELECT count(*) AS closed_trades, count(*) FILTER (realized_pnl_usd <= 0) AS false_positives, round(count(*) FILTER (realized_pnl_usd <= 0) / count(*), 6) AS false_positive_rate FROM audit WHERE event_type = 'replay_position_exit'", "audit")
def false_positive_rate(t: Tables) -> DataFrame:
    return _money(reports.false_positive_rate(reports.exits(t.audit)), "false_positive_rate", digits=6)


@query("slippage_by_hour", "SELECT strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:00:00Z') AS hour_utc, count(*) AS fills, round(sum(slippage_bps), 4) AS total_slippage_bps, round(avg(slippage_bps), 4) AS avg_slippage_bps, round(coalesce(sum(cost_usd), 0), 6) AS total_cost_usd FROM audit WHERE fill_filled GROUP BY 1", "audit")
def slippage_by_hour(t: Tables) -> DataFrame:
    return _money(_money(reports.slippage_by_hour(t.audit), "total_slippage_bps", "avg_slippage_bps"), "total_cost_usd", digits=6)


_PERF = "count(*) AS closed_trades, count(*) FILTER (realized_pnl_usd > 0) AS winning_trades, round(sum(realized_pnl_usd), 2) AS realized_pnl_usd, round(sum(realized_pnl_usd) / count(*), 4) AS avg_realized_pnl_usd, round(count(*) FILTER (realized_pnl_usd > 0) / count(*), 6) AS win_rate"


def _performance(df: DataFrame) -> DataFrame:
    return _money(_money(_money(df, "realized_pnl_usd", digits=2), "avg_realized_pnl_usd"), "win_rate", digits=6)


@query("performance_by_regime", f"SELECT CASE WHEN nullif(impulse_bps, 0) IS NULL THEN 'unknown' WHEN abs(impulse_bps) < 5 THEN 'low' WHEN abs(impulse_bps) < 20 THEN 'medium' ELSE 'high' END AS regime, {_PERF} FROM audit WHERE event_type = 'replay_position_exit' GROUP BY 1", "audit")
def performance_by_regime(t: Tables) -> DataFrame:
    return _performance(reports.performance_by_regime(reports.exits(t.audit)))


@query("performance_by_model", f"SELECT model, {_PERF} FROM audit WHERE event_type = 'replay_position_exit' GROUP BY 1", "audit")
def performance_by_model(t: Tables) -> DataFrame:
    return _performance(reports.performance_by(reports.exits(t.audit), F.col("model")))


@query("cost_sensitivity", "WITH s AS (SELECT sum(gross_pnl_usd) AS g, sum(2 * notional) AS n FROM closed_trades) SELECT b AS cost_bps, round(n, 2) AS round_trip_notional, round(10000 * g / n, 6) AS break_even_bps, round(g - n * b / 10000, 2) AS net_pnl_usd FROM s, (VALUES (CAST(1 AS DOUBLE)), (2), (4), (8), (12)) AS v(b)", "closed_trades")
def cost_sensitivity(t: Tables) -> DataFrame:
    own = reports.cost_sensitivity(t.closed_trades, [1, 2, 4, 8, 12])
    return own.select("cost_bps", F.round("round_trip_notional", 2).alias("round_trip_notional"), F.round("break_even_bps", 6).alias("break_even_bps"), F.round("net_pnl_usd", 2).alias("net_pnl_usd"))


@query("closed_trade_stats", "SELECT count(*) AS closed_trades, count(*) FILTER (realized_pnl_usd > 0) AS winning_trades, round(100 * count(*) FILTER (realized_pnl_usd > 0) / count(*), 6) AS win_rate_pct, round(100 * sum(realized_pnl_usd) / 1000000, 4) AS pnl_pct FROM audit WHERE decision_result = 'closed'", "audit")
def closed_trade_stats(t: Tables) -> DataFrame:
    return _money(_money(reports.closed_trade_stats(t.audit, 1_000_000), "win_rate_pct", digits=6), "pnl_pct")


_LIQ = "lq AS (SELECT symbol, coalesce(avg(10000 * (ask - bid) / ((bid + ask) / 2)), 0) AS sp, coalesce(avg(CASE WHEN bid_size IS NOT NULL AND ask_size IS NOT NULL THEN least(bid * bid_size, ask * ask_size) END), 0) AS usd FROM quotes WHERE venue = 'mexc' GROUP BY 1)"


@query("liquidity_spread_avg", f"WITH {_LIQ} SELECT symbol, round(sp, 5) AS avg_spread_bps, round(usd, 4) AS avg_liquidity_usd FROM lq", "quotes")
def liquidity_spread_avg(t: Tables) -> DataFrame:
    own = reports.liquidity_spread_avg(t.quotes)
    return own.select("symbol", F.round("avg_spread_bps", 5).alias("avg_spread_bps"), F.round("avg_liquidity_usd", 4).alias("avg_liquidity_usd"))


@query("pair_venues", "SELECT symbol, count(*) FILTER (venue = 'binance') AS leader_quotes, count(*) FILTER (venue = 'mexc') AS lagger_quotes, min(local_ts_ms) FILTER (venue = 'binance') AS leader_first, min(local_ts_ms) FILTER (venue = 'mexc') AS lagger_first FROM quotes GROUP BY 1", "quotes")
def pair_venues(t: Tables) -> DataFrame:
    return reports.pair_venues(t.quotes)


_BEST = f"{_ALIGNED}, bs AS (SELECT symbol, max(score) AS sc FROM s2 GROUP BY 1)"


def _selected(t: Tables, top_n: int) -> DataFrame:
    pnl = reports.exits(t.audit).groupBy("symbol").agg((F.sum("realized_pnl_usd") / 1e6).alias("realized_pnl_usd"))
    return universe.symbol_selection(leadlag.leadership(t.quotes, LAGS, HOUR // 2, min_score=0.2), reports.liquidity_spread_avg(t.quotes), pnl, top_n)


_SELECTION = f"""{_BEST}, {_LIQ}, pn AS (SELECT symbol, sum(realized_pnl_usd) / 1000000 AS pnl FROM audit WHERE event_type = 'replay_position_exit' GROUP BY 1),
 sl AS (SELECT y.symbol, coalesce(sc, 0) >= 0.2 AS stable, 0.55 * CASE WHEN sc >= 0.2 THEN sc ELSE 0 END + 0.2 * least(coalesce(usd, 0) / 100000, 1) - 0.15 * least(coalesce(sp, 0) / 20, 1) + 0.1 * greatest(-1, least(coalesce(pnl, 0) / 10, 1)) AS score, coalesce(pnl, 0) AS pnl
 FROM (SELECT DISTINCT symbol FROM quotes) y LEFT JOIN bs USING (symbol) LEFT JOIN lq USING (symbol) LEFT JOIN pn USING (symbol))"""


@query("symbol_selection", f"WITH {_SELECTION} SELECT symbol, stable, round(score, 5) AS selection_score FROM sl ORDER BY stable DESC, score DESC, pnl DESC, symbol LIMIT 5", "quotes", "audit")
def symbol_selection(t: Tables) -> DataFrame:
    return _selected(t, 5).select("symbol", "stable", F.round("selection_score", 5).alias("selection_score"))


def research_report(t: Tables) -> DataFrame:
    """The sections of a report as rows of one table; the full tables are the queries of the same names."""

    def section(df: DataFrame, name: str, item: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"))

    def across(df: DataFrame, name: str, *columns: str) -> DataFrame:
        long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "item", "value")
        return section(long, name, F.col("item"), F.col("value"))

    closed, day = reports.exits(t.audit), F.concat_ws(":", "symbol", "day")
    variants = outcomes.fill_model_variants(outcomes.at_quote(t.intents, t.quotes.where(F.col("venue") == LAGGER)))
    parts = [
        across(run_summary(t), "summary", "intents", "risk_blocked", "fills", "not_filled", "closed_positions", "realized_pnl_usd"),
        section(health.feed_health(t.quotes), "feed_health", F.concat_ws(":", "venue", "symbol"), F.col("event_count")),
        section(symbol_day_slices(t), "by_symbol_day", day, F.col("records")),
        section(variants.groupBy("fill_model").agg(F.count_if("filled").alias("n")), "fill_model_variants", F.col("fill_model"), F.col("n")),
        section(outcomes.fill_model_diagnostics(variants).where("has_difference").groupBy("symbol").count(), "fill_model_diagnostics", F.col("symbol"), F.col("count")),
        across(reports.catch_up_metrics(t.audit), "catch_up", "catch_up_exits", "avg_ms", "p50_ms", "p90_ms"),
        section(false_positive_rate(t), "false_positives", F.lit("rate"), F.col("false_positive_rate")),
        section(slippage_by_hour(t), "slippage_by_hour", F.col("hour_utc"), F.col("total_slippage_bps")),
        section(performance_by_regime(t), "performance_by_regime", F.col("regime"), F.col("realized_pnl_usd")),
        section(reports.performance_by(closed, F.col("model")), "performance_by_model", F.col("model"), F.round("realized_pnl_usd", 2)),
        section(_selected(t, 1000), "symbol_selection", F.col("symbol"), F.round("selection_score", 5)),
        section(replay_days(t), "replay_days", F.col("day"), F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _report_sql() -> str:
    """The report's rows out of the SQL of the queries that it is made of."""
    wide = lambda key, name, *columns: [f"SELECT '{name}' AS section, '{c}' AS item, CAST({c} AS DOUBLE) AS value FROM ({ORACLES[key]})" for c in columns]
    long = lambda key, name, item, value: [f"SELECT '{name}' AS section, CAST({item} AS VARCHAR) AS item, CAST({value} AS DOUBLE) AS value FROM ({ORACLES[key]})"]
    selection = duck(f"WITH {_SELECTION} SELECT 'symbol_selection' AS section, symbol AS item, round(score, 5) AS value FROM sl", "quotes", "audit")
    parts = [
        *wide("run_summary", "summary", "intents", "risk_blocked", "fills", "not_filled", "closed_positions", "realized_pnl_usd"), *long("feed_health", "feed_health", "venue || ':' || symbol", "event_count"), *long("symbol_day_slices", "by_symbol_day", "symbol || ':' || day", "records"),
        *long("fill_model_variants", "fill_model_variants", "fill_model", "fills"), f"SELECT 'fill_model_diagnostics', symbol, CAST(count(*) AS DOUBLE) FROM ({ORACLES['fill_model_diagnostics']}) WHERE has_difference GROUP BY symbol",
        *wide("catch_up_metrics", "catch_up", "catch_up_exits", "avg_ms", "p50_ms", "p90_ms"), *long("false_positive_rate", "false_positives", "'rate'", "false_positive_rate"), *long("slippage_by_hour", "slippage_by_hour", "hour_utc", "total_slippage_bps"),
        *long("performance_by_regime", "performance_by_regime", "regime", "realized_pnl_usd"), *long("performance_by_model", "performance_by_model", "model", "realized_pnl_usd"), f"SELECT section, item, value FROM ({selection})", *long("replay_days", "replay_days", "day", "1"),
    ]
    return " UNION ALL ".join(parts)


query("research_report")(research_report)


_CMP = "c AS (SELECT coalesce(p.client_order_id, d.client_order_id) AS client_order_id, CASE WHEN d.client_order_id IS NULL THEN 'unmatched_paper' WHEN p.client_order_id IS NULL THEN 'unmatched_demo' ELSE 'matched' END AS status, d.qty - p.qty AS qty_diff, round(d.price - p.price, 6) AS price_diff FROM paper_fills p FULL JOIN demo_fills d ON p.client_order_id = d.client_order_id)"


def _compared(t: Tables) -> DataFrame:
    return reports.fills_compare(t.paper_fills.withColumn("row_no", F.lit(0)), t.demo_fills.withColumn("row_no", F.lit(0)))


@query("fills_compare", f"WITH {_CMP} SELECT * FROM c", "paper_fills", "demo_fills")
def fills_compare(t: Tables) -> DataFrame:
    return _compared(t).select("client_order_id", "status", "qty_diff", F.round("price_diff", 6).alias("price_diff"))


@query("fills_compare_summary", f"WITH {_CMP} SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'unmatched_paper') AS unmatched_paper, count(*) FILTER (status = 'unmatched_demo') AS unmatched_demo, count(*) FILTER (qty_diff <> 0) AS qty_mismatches, count(*) FILTER (price_diff <> 0) AS price_mismatches FROM c", "paper_fills", "demo_fills")
def fills_compare_summary(t: Tables) -> DataFrame:
    return reports.fills_compare_summary(_compared(t))


@query("unmatched_fill_ids", "(SELECT 'paper' AS side, client_order_id FROM paper_fills WHERE client_order_id NOT IN (SELECT client_order_id FROM demo_fills)) UNION ALL (SELECT 'demo', client_order_id FROM demo_fills WHERE client_order_id NOT IN (SELECT client_order_id FROM paper_fills))", "paper_fills", "demo_fills")
def unmatched_fill_ids(t: Tables) -> DataFrame:
    p, d = t.paper_fills.select("client_order_id"), t.demo_fills.select("client_order_id")
    return p.subtract(d).select(F.lit("paper").alias("side"), "client_order_id").unionByName(d.subtract(p).select(F.lit("demo").alias("side"), "client_order_id"))


@query(
    "summary_diff",
    """WITH t AS (SELECT symbol AS run, model = 'impulse_transfer' AS one, * FROM closed_trades), s AS (SELECT run, one, round(sum(gross_pnl_usd), 2) AS g, round(sum(impulse_bps), 2) AS u, count(*) AS n FROM t GROUP BY ALL),
 m AS (SELECT run, one, 'realized_pnl_usd' AS metric, g AS v FROM s UNION ALL SELECT run, one, 'unrealized_pnl_usd', u FROM s UNION ALL SELECT run, one, 'total_net_pnl_usd', coalesce(g, 0) + coalesce(u, 0) FROM s UNION ALL SELECT run, one, 'trades', n FROM s UNION ALL SELECT run, one, concat('intents:', exit_reason), count(*) FROM t GROUP BY run, one, exit_reason),
 d AS (SELECT run, metric, round(coalesce(sum(CASE WHEN NOT one THEN v END), 0) - coalesce(sum(CASE WHEN one THEN v END), 0), 2) AS delta FROM m GROUP BY run, metric), x AS (SELECT *, CASE WHEN metric LIKE '%usd' THEN abs(delta) > 10000 ELSE delta <> 0 END AS mismatch FROM d),
 y AS (SELECT *, CASE WHEN mismatch THEN CASE WHEN metric LIKE 'intents:%' THEN concat('intent_count_delta:', substr(metric, 9)) ELSE concat(metric, '_delta') END END AS reason FROM x), z AS (SELECT run, count(reason) AS mismatch_count, count(reason) = 0 AS matched, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS mismatch_reasons FROM y GROUP BY run)
 SELECT y.*, mismatch_count, matched, mismatch_reasons FROM y JOIN z USING (run)""",
    "closed_trades",
)
def summary_diff(t: Tables) -> DataFrame:
    own = t.closed_trades.withColumn("run", F.col("symbol"))
    sums = own.groupBy("model", "run").agg(F.round(F.sum("gross_pnl_usd"), 2).alias("realized_pnl_usd"), F.round(F.sum("impulse_bps"), 2).alias("unrealized_pnl_usd"), F.count("*").alias("trades"))
    models = own.groupBy("model", "run", "exit_reason").count().groupBy("model", "run").agg(F.map_from_entries(F.collect_list(F.struct("exit_reason", "count"))).alias("intent_counts"))
    sums, first = sums.join(models, ["model", "run"]), F.col("model") == "impulse_transfer"
    diff = reports.summary_diff(sums.where(first), sums.where(~first), ["realized_pnl_usd", "unrealized_pnl_usd"], ["trades"], 10_000, ["realized_pnl_usd", "unrealized_pnl_usd"], "intent_counts")
    verdict = reports.summary_verdict(diff).withColumn("mismatch_reasons", F.array_join("mismatch_reasons", ","))
    return diff.drop("a", "b").withColumn("delta", F.round("delta", 2)).join(verdict, "run")


def _runs(t: Tables) -> DataFrame:
    """A health probe a minute out of the ticks: feed reason, table counts and risk flags."""
    n = F.col("row_no")
    flags = F.create_map(F.lit("kill_switch"), n % 7 == 0, F.lit("high_slippage"), n % 5 == 0, F.lit("book_desync"), n % 11 == 0)
    return t.ticks.select(n.alias("run"), F.when(n % 3 == 0, "stale_stream").otherwise("ok").alias("feed_reason"), F.when(n % 4 != 0, F.create_map(F.lit("quotes"), n)).alias("table_counts"), flags.alias("flags"))


_PARTS = """SELECT row_no AS run, 'data_feeds' AS component, CASE WHEN row_no % 3 = 0 THEN 'critical' ELSE 'ok' END AS status, CASE WHEN row_no % 3 = 0 THEN 'stale_stream' ELSE 'ok' END AS reason FROM ticks UNION ALL SELECT row_no, 'storage', CASE WHEN row_no % 4 = 0 THEN 'unknown' ELSE 'ok' END, CASE WHEN row_no % 4 = 0 THEN 'storage_not_checked' ELSE 'ok' END FROM ticks
 UNION ALL SELECT row_no, 'risk', CASE WHEN row_no % 7 = 0 OR row_no % 5 = 0 OR row_no % 11 = 0 THEN 'critical' ELSE 'ok' END, CASE WHEN row_no % 7 = 0 OR row_no % 5 = 0 OR row_no % 11 = 0 THEN 'risk_block_active' ELSE 'ok' END FROM ticks"""


@query("component_health", _PARTS, "ticks")
def component_health(t: Tables) -> DataFrame:
    return health.component_health(_runs(t)).drop("active_blocks")


@query("system_health", f"SELECT run, CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'ok' END AS status, count(*) AS components FROM ({_PARTS}) GROUP BY 1", "ticks")
def system_health(t: Tables) -> DataFrame:
    return health.system_health(health.component_health(_runs(t)))


_ALERTS = "SELECT row_no AS run, 'data_feeds_critical' AS alert_type, 'stale_stream' AS reason FROM ticks WHERE row_no % 3 = 0 UNION ALL SELECT row_no, 'risk_stop', 'manual_kill_switch' FROM ticks WHERE row_no % 7 = 0 UNION ALL SELECT row_no, 'risk_stop', 'high_slippage' FROM ticks WHERE row_no % 5 = 0 UNION ALL SELECT row_no, 'risk_stop', 'book_desync' FROM ticks WHERE row_no % 11 = 0"


@query("health_alerts", f"SELECT *, 'critical' AS severity FROM ({_ALERTS}) UNION ALL SELECT -1, 'feed_missing', 'required_feed_missing', 'critical'", "ticks")
def health_alerts(t: Tables) -> DataFrame:
    parts = health.component_alerts(health.component_health(_runs(t))).select("run", "alert_type", "reason", "severity")
    feeds = health.feed_alerts(health.feed_decision(health.feed_health(t.quotes), _required(t, True), 2 * HOUR))
    return parts.unionByName(feeds.select(F.lit(-1).cast("long").alias("run"), "alert_type", "reason", "severity"))


# alerts of all kinds: those of components, feeds of either venue, latencies and lost bridges
_ALL_ALERTS = f"""SELECT run, alert_type, reason, NULL AS venue, NULL AS latency_ms, run AS row_no FROM ({_ALERTS}) UNION ALL SELECT row_no, CASE WHEN row_no % 2 = 0 THEN 'feed_stale' ELSE 'feed_missing' END, NULL, venue, NULL, row_no FROM ticks WHERE row_no % 5 = 1
 UNION ALL SELECT row_no - row_no % 3, 'feed_latency', NULL, venue, local_ts_ms - exchange_ts_ms, row_no FROM ticks WHERE row_no % 7 > 3 UNION ALL SELECT row_no, 'bridge_disconnect', NULL, NULL, NULL, row_no FROM ticks WHERE row_no % 13 = 0"""


@query(
    "alerts_to_risk_flags",
    f"""SELECT run, bool_or(alert_type = 'feed_latency') AS feed_latency_high, max_by(latency_ms, CASE WHEN alert_type = 'feed_latency' THEN row_no END) AS feed_latency_ms, bool_or(alert_type IN ('feed_stale', 'feed_missing') AND venue IS NOT DISTINCT FROM 'binance') AS binance_feed_stale,
 bool_or(alert_type IN ('feed_stale', 'feed_missing') AND venue IS NOT DISTINCT FROM 'mexc') AS mexc_feed_stale, NOT bool_or(alert_type = 'bridge_disconnect') AS bridge_connected,
 coalesce(string_agg(CASE WHEN alert_type = 'risk_stop' THEN CASE WHEN reason = 'manual_kill_switch' THEN 'kill_switch' ELSE reason END END, ',' ORDER BY CASE WHEN reason = 'manual_kill_switch' THEN 'kill_switch' ELSE reason END), '') AS stops FROM ({_ALL_ALERTS}) GROUP BY 1""",
    "ticks",
)
def alerts_to_risk_flags(t: Tables) -> DataFrame:
    none, n = F.lit(None).cast("string"), F.col("row_no")
    late = F.lit(None).cast("long")
    parts = health.component_alerts(health.component_health(_runs(t))).select("run", "alert_type", "reason", none.alias("venue"), late.alias("latency_ms"), F.col("run").alias("row_no"))
    feeds = t.ticks.where(n % 5 == 1).select(n.alias("run"), F.when(n % 2 == 0, "feed_stale").otherwise("feed_missing").alias("alert_type"), none.alias("reason"), "venue", late.alias("latency_ms"), "row_no")
    slow = t.ticks.where(n % 7 > 3).select((n - n % 3).alias("run"), F.lit("feed_latency").alias("alert_type"), none.alias("reason"), "venue", (F.col("local_ts_ms") - F.col("exchange_ts_ms")).alias("latency_ms"), "row_no")
    lost = t.ticks.where(n % 13 == 0).select(n.alias("run"), F.lit("bridge_disconnect").alias("alert_type"), none.alias("reason"), none.alias("venue"), late.alias("latency_ms"), "row_no")
    return health.alerts_to_risk_flags(parts.unionByName(feeds).unionByName(slow).unionByName(lost)).withColumn("stops", F.array_join("stops", ","))


@query(
    "daily_summary",
    f"""WITH {_SLICES}, x AS (SELECT day, count(*) FILTER (dec) AS intents, count(*) FILTER (dec AND fill_filled) AS fills, count(*) FILTER (NOT dec) AS closed_positions, count(*) FILTER (dec AND fill_filled) - count(*) FILTER (NOT dec) AS open_positions, round(coalesce(sum(realized_pnl_usd), 0), 6) AS realized_pnl_usd, count(DISTINCT symbol) AS symbol_days FROM a GROUP BY 1),
 ou AS (SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, row_no, CASE WHEN row_no % 10 NOT IN (1, 2, 3) THEN o.client_order_id END AS known FROM order_updates LEFT JOIN open_orders o USING (client_order_id)),
 u AS (SELECT day, count(DISTINCT known) AS orders, 2 * count(*) FILTER (row_no % 10 = 1) AS positions, count(*) FILTER (row_no % 10 = 2) AS balances, count(*) + count(*) FILTER (row_no % 10 = 1) AS audit_records FROM ou GROUP BY 1),
 qd AS (SELECT *, strftime(make_timestamp(local_ts_ms * 1000), '%Y-%m-%d') AS day FROM quotes), al AS (SELECT day, count(*) AS alerts FROM qd WHERE local_ts_ms - exchange_ts_ms > 30 GROUP BY 1),
 hs AS (SELECT strftime(make_timestamp(local_ts_ms * 1000), '%Y-%m-%d') AS day, max(CASE WHEN row_no % 3 = 0 OR row_no % 7 = 0 OR row_no % 5 = 0 OR row_no % 11 = 0 THEN 2 WHEN row_no % 4 = 0 THEN 1 ELSE 0 END) AS worst FROM ticks GROUP BY 1),
 lq AS (SELECT day, symbol, bid, ask FROM qd QUALIFY row_number() OVER (PARTITION BY day, symbol ORDER BY local_ts_ms DESC, row_no DESC) = 1), mk AS (SELECT i.day, round(sum(coalesce(CASE WHEN side = 'buy' THEN (bid - price_cap) * qty ELSE (price_cap - ask) * qty END, 0)), 6) AS unrealized_pnl_usd FROM (SELECT *, strftime(make_timestamp(created_ts_ms * 1000), '%Y-%m-%d') AS day FROM intents) i LEFT JOIN lq ON lq.day = i.day AND lq.symbol = i.symbol GROUP BY 1),
 f AS (SELECT strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') AS day, count(*) FILTER (o_orderkey % 10 > 1) AS matched_fills, count(*) FILTER (o_orderkey % 10 = 1) AS unmatched_paper, count(*) FILTER (o_orderkey % 10 = 0) AS unmatched_demo FROM orders GROUP BY 1)
 SELECT day, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("intents", "fills", "closed_positions", "open_positions", "realized_pnl_usd", "unrealized_pnl_usd", "symbol_days", "alerts", "matched_fills", "unmatched_paper", "unmatched_demo", "orders", "positions", "balances", "audit_records"))}, 0 AS critical_alerts,
 CASE worst WHEN 2 THEN 'critical' WHEN 0 THEN 'ok' ELSE 'unknown' END AS health_status FROM x FULL JOIN u USING (day) FULL JOIN al USING (day) FULL JOIN hs USING (day) FULL JOIN mk USING (day) FULL JOIN f USING (day)""",
    "audit", "order_updates", "open_orders", "quotes", "ticks", "intents",
)
def daily_summary(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")
    ids = t.orders.select(F.concat(F.lit("llb-"), F.col("o_orderkey").cast("string")).alias("client_order_id"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("day"))
    updates = orders.classify_private_updates(orders.expand_private_updates(raw_updates(t, day("ts_ms").alias("day"))))
    status = health.system_health(health.component_health(_runs(t))).join(t.ticks.select(F.col("row_no").alias("run"), day("local_ts_ms").alias("day")), "run")
    quotes = t.quotes.withColumn("day", day("local_ts_ms"))
    last = quotes.groupBy("day", "symbol").agg(F.max_by(F.struct("bid", "ask"), F.struct("local_ts_ms", "row_no")).alias("q"))
    marks = t.intents.withColumn("day", day("created_ts_ms")).join(last, ["day", "symbol"], "left").withColumn("mark", F.when(F.col("side") == "buy", F.col("q.bid")).otherwise(F.col("q.ask")))
    marks = marks.select("day", pnl_values("side", "price_cap", "mark", "qty", 0.0)[0].alias("unrealized_pnl_usd"))
    alerts = health.latency_alerts(quotes, 30).withColumn("day", day("metadata.local_ts_ms"))
    own = reports.daily_summary(t.audit.withColumn("day", day("timestamp_ms")), alerts, _compared(t).join(ids, "client_order_id"), orders.reconciliation_audit(t.open_orders, updates), status, marks)
    return _money(own, "realized_pnl_usd", "unrealized_pnl_usd", digits=6)


@query("submission_candidates", "SELECT row_no, intent_id FROM audit WHERE event_type = 'replay_signal_decision' AND decision_result = 'filled' AND fill_filled AND risk_allowed ORDER BY timestamp_ms, row_no LIMIT 25", "audit")
def submission_candidates(t: Tables) -> DataFrame:
    return t.audit.where("event_type = 'replay_signal_decision' AND decision_result = 'filled' AND fill_filled AND risk_allowed").orderBy("timestamp_ms", "row_no").limit(25).select("row_no", "intent_id")


@query("latest_audit_rows", "WITH k AS (SELECT symbol, row_no, row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ms DESC, row_no DESC) AS k FROM audit) SELECT symbol, row_no FROM k WHERE k <= 12 ORDER BY symbol, k DESC LIMIT 20", "audit")
def latest_audit_rows(t: Tables) -> DataFrame:
    """The last 12 rows of each source (here, symbol), then the first 20 overall."""
    own = health.latest_rows(t.audit, ["symbol"], F.struct("timestamp_ms", "row_no"), 12)
    return own.orderBy("symbol", "timestamp_ms", "row_no").limit(20).select("symbol", "row_no")


@query("keep_recent", "SELECT symbol, model, row_no FROM audit QUALIFY row_number() OVER (PARTITION BY symbol, model ORDER BY timestamp_ms DESC, row_no DESC) <= 5", "audit")
def keep_recent(t: Tables) -> DataFrame:
    return health.latest_rows(t.audit, ["symbol", "model"], F.struct("timestamp_ms", "row_no"), 5).select("symbol", "model", "row_no")


ORACLES["research_report"] = _report_sql()
