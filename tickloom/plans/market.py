"""Queries on quotes, trades and books: expressions, as-of joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import exprs as E
from tickloom.operators import asof, windows
from tickloom.plans.registry import Tables, query

HOUR = 3_600_000
ORDER = "local_ts_ms, exchange_ts_ms, venue, symbol, row_no"
#: Latest quotes of both venues at each tick, for SQL on the checking side.
PAIRS = f"""q AS (SELECT *, (bid + ask) / 2 AS mid FROM quotes),
p AS (SELECT *, last_value(CASE WHEN venue = 'binance' THEN {{{{'ts': local_ts_ms, 'mid': mid, 'bid': bid, 'ask': ask, 'row_no': row_no}}}} END IGNORE NULLS) OVER w AS a,
 last_value(CASE WHEN venue = 'mexc' THEN {{{{'ts': local_ts_ms, 'mid': mid, 'bid': bid, 'ask': ask, 'row_no': row_no}}}} END IGNORE NULLS) OVER w AS b
 FROM q WINDOW w AS (PARTITION BY symbol ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""".replace("{{", "{").replace("}}", "}")


def depth_snapshots(levels: DataFrame) -> DataFrame:
    """Snapshots with bids and asks as arrays, best level first."""
    sort = lambda price, qty: F.transform(F.array_sort(F.collect_list(F.struct("lvl", F.col(price).alias("price"), F.col(qty).alias("qty")))), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    return levels.groupBy("row_no", "local_ts_ms", "venue", "symbol").agg(sort("bid_price", "bid_qty").alias("bids"), sort("ask_price", "ask_qty").alias("asks"))


@query("event_order", "SELECT row_no, row_number() OVER (PARTITION BY symbol ORDER BY local_ts_ms, exchange_ts_ms, venue, row_no) - 1 AS position FROM quotes", "quotes")
def event_order(t: Tables) -> DataFrame:
    ranked = windows.with_position(t.quotes.withColumn("ts", E.event_ts()), ["symbol"], "ts", E.event_order())
    return ranked.select("row_no", F.col("position").cast("long").alias("position"))


@query("mid_spread", "SELECT row_no, round((bid + ask) / 2, 6) AS mid, round(10000 * (ask - bid) / ((bid + ask) / 2), 6) AS spread_bps FROM quotes", "quotes")
def mid_spread(t: Tables) -> DataFrame:
    return t.quotes.select("row_no", F.round(E.mid(), 6).alias("mid"), F.round(E.spread_bps(), 6).alias("spread_bps"))


@query("bps_move", "SELECT row_no, round(CASE WHEN bid <= 0 THEN 0 ELSE 10000 * (ask - bid) / bid END, 6) AS move_bps FROM quotes", "quotes")
def bps_move(t: Tables) -> DataFrame:
    return t.quotes.select("row_no", F.round(E.bps_move(F.col("ask"), F.col("bid")), 6).alias("move_bps"))


@query("log_basis_bps", f"WITH {PAIRS} SELECT row_no, round(10000 * (ln(b.mid) - 0.9 * ln(a.mid)), 4) AS basis_bps FROM p WHERE a IS NOT NULL AND b IS NOT NULL", "quotes")
def log_basis_bps(t: Tables) -> DataFrame:
    return windows.basis_samples(t.quotes, beta=0.9).select("row_no", F.round("basis", 4).alias("basis_bps"))


@query(
    "book_imbalance",
    "SELECT row_no, round((sum(bid_qty) - sum(ask_qty)) / (sum(bid_qty) + sum(ask_qty)), 6) AS imbalance FROM depth_levels WHERE lvl <= 5 GROUP BY row_no",
    "depth_levels",
)
def book_imbalance(t: Tables) -> DataFrame:
    return depth_snapshots(t.depth_levels).select("row_no", F.round(E.book_imbalance(5), 6).alias("imbalance"))


@query(
    "top_depth_usd",
    "SELECT row_no, round(least(sum(bid_price * bid_qty * 0.5), sum(ask_price * ask_qty * 0.5)), 6) AS depth_usd FROM depth_levels WHERE lvl <= 3 GROUP BY row_no",
    "depth_levels",
)
def top_depth_usd(t: Tables) -> DataFrame:
    return depth_snapshots(t.depth_levels).select("row_no", F.round(E.top_depth_usd(3, 0.5), 6).alias("depth_usd"))


@query(
    "canonical_symbol",
    """SELECT row_no, upper(replace(replace(replace(raw, '-', ''), '_', ''), '/', '')) AS canonical, replace(upper(replace(replace(replace(raw, '-', ''), '_', ''), '/', '')), 'USDT', '_USDT') AS contract
 FROM (SELECT row_no, CASE row_no % 3 WHEN 0 THEN lower(symbol) WHEN 1 THEN replace(symbol, 'USDT', '-USDT') ELSE replace(symbol, 'USDT', '_usdt') END AS raw FROM quotes)""",
    "quotes",
)
def canonical_symbol(t: Tables) -> DataFrame:
    raw = F.when(F.col("row_no") % 3 == 0, F.lower("symbol")).when(F.col("row_no") % 3 == 1, F.replace("symbol", F.lit("USDT"), F.lit("-USDT"))).otherwise(F.replace("symbol", F.lit("USDT"), F.lit("_usdt")))
    own = t.quotes.select("row_no", raw.alias("raw"))
    return own.select("row_no", E.canonical_symbol("raw").alias("canonical"), E.contract_symbol("raw").alias("contract"))


@query(
    "quote_latency_alerts",
    """SELECT row_no, 'feed_latency' AS alert_type, 'warning' AS severity, symbol, venue, local_ts_ms - exchange_ts_ms AS latency_ms FROM quotes
 WHERE local_ts_ms - exchange_ts_ms > 30""",
    "quotes",
)
def quote_latency_alerts(t: Tables) -> DataFrame:
    from tickloom.operators.health import latency_alerts

    return latency_alerts(t.quotes, 30).select("row_no", "alert_type", "severity", "symbol", "venue", "metadata.latency_ms")


@query("order_style_by_edge", "SELECT intent_id, CASE WHEN expected_edge_bps >= 5 THEN 'passive_limit' WHEN expected_edge_bps >= 2 THEN 'aggressive_limit' ELSE 'rejected' END AS order_style FROM intents", "intents")
def order_style_by_edge(t: Tables) -> DataFrame:
    return t.intents.select("intent_id", E.order_style("expected_edge_bps", 2, 5).alias("order_style"))


@query("client_order_id", "SELECT intent_id, substr('llb-' || regexp_replace(intent_id || '.x', '[^A-Za-z0-9]', '-', 'g'), 1, 64) AS client_order_id FROM intents", "intents")
def client_order_id(t: Tables) -> DataFrame:
    return t.intents.withColumn("own", F.concat("intent_id", F.lit(".x"))).select("intent_id", E.client_order_id("own").alias("client_order_id"))


@query("redact_map_keys", "SELECT row_no, '***REDACTED***' AS api_key, venue AS venue, symbol AS symbol, '***REDACTED***' AS access_token FROM quotes", "quotes")
def redact_map_keys(t: Tables) -> DataFrame:
    fields = F.create_map(F.lit("Api_Key"), F.col("symbol"), F.lit("venue"), F.col("venue"), F.lit("symbol"), F.col("symbol"), F.lit("accessToken"), F.col("venue"))
    own = t.quotes.select("row_no", fields.alias("m")).withColumn("m", E.redact_map("m"))
    return own.select("row_no", F.col("m")["Api_Key"].alias("api_key"), F.col("m")["venue"].alias("venue"), F.col("m")["symbol"].alias("symbol"), F.col("m")["accessToken"].alias("access_token"))


@query("volatility_regime", "SELECT trade_id, CASE WHEN abs(coalesce(nullif(impulse_bps, 0), slippage_bps)) < 5 THEN 'low' WHEN abs(coalesce(nullif(impulse_bps, 0), slippage_bps)) < 20 THEN 'medium' ELSE 'high' END AS regime FROM closed_trades", "closed_trades")
def volatility_regime(t: Tables) -> DataFrame:
    return t.closed_trades.select("trade_id", E.volatility_regime("impulse_bps", F.col("slippage_bps")).alias("regime"))


@query(
    "trade_result_class",
    """SELECT row_no, CASE decision_result WHEN 'closed' THEN CASE WHEN realized_pnl_usd > 0 THEN 'profit' WHEN realized_pnl_usd < 0 THEN 'loss' ELSE 'flat' END WHEN 'filled' THEN 'open' WHEN 'risk_blocked' THEN 'blocked' ELSE 'not filled' END AS result,
 CASE decision_result WHEN 'closed' THEN CASE WHEN realized_pnl_usd > 0 THEN 'yes' ELSE 'no' END WHEN 'filled' THEN 'open' WHEN 'risk_blocked' THEN 'blocked' ELSE 'not filled' END AS success FROM audit""",
    "audit",
)
def trade_result_class(t: Tables) -> DataFrame:
    return t.audit.select("row_no", E.trade_result().alias("result"), E.trade_success().alias("success"))


@query("filter_event_day", "SELECT row_no, symbol, venue FROM quotes WHERE local_ts_ms // 86400000 = (SELECT min(local_ts_ms) // 86400000 + 1 FROM quotes)", "quotes")
def filter_event_day(t: Tables) -> DataFrame:
    first = t.quotes.agg((F.floor(F.min("local_ts_ms") / asof.DAY_MS) + 1).alias("day"))
    return t.quotes.join(F.broadcast(first), F.floor(F.col("local_ts_ms") / asof.DAY_MS) == F.col("day")).select("row_no", "symbol", "venue")


@query("asof_latest", f"WITH {PAIRS} SELECT row_no, a.row_no AS leader_row, b.row_no AS lagger_row FROM p", "quotes")
def asof_latest(t: Tables) -> DataFrame:
    pairs = asof.latest_pair(t.quotes, E.LEADER, E.LAGGER, E.event_order(), ["row_no"])
    return pairs.select("row_no", F.col("leader.row_no").alias("leader_row"), F.col("lagger.row_no").alias("lagger_row"))


@query(
    "asof_lookback",
    f"""WITH s AS (SELECT symbol, venue, local_ts_ms AS ts, max(row_no) AS back_row FROM quotes GROUP BY ALL), q AS (SELECT *, local_ts_ms - {4 * HOUR} AS want FROM quotes)
 SELECT q.row_no, s.back_row FROM q ASOF LEFT JOIN s ON q.symbol = s.symbol AND q.venue = s.venue AND q.want >= s.ts""",
    "quotes",
)
def asof_lookback(t: Tables) -> DataFrame:
    return asof.asof_lookback(t.quotes, {"back_row": 4 * HOUR}, F.col("row_no")).select("row_no", "back_row")


@query(
    "asof_forward_tolerance",
    f"""WITH l AS (SELECT row_no, symbol, local_ts_ms AS ts FROM quotes WHERE venue = 'binance'), r AS (SELECT row_no, symbol, local_ts_ms AS ts FROM quotes WHERE venue = 'mexc'),
 j AS (SELECT l.row_no, l.ts, r.row_no AS right_row, r.ts AS right_ts, row_number() OVER (PARTITION BY l.row_no ORDER BY r.ts, r.row_no) AS k FROM l JOIN r ON l.symbol = r.symbol AND r.ts BETWEEN l.ts - {HOUR // 2} AND l.ts + {HOUR // 2})
 SELECT l.row_no, j.right_row FROM l LEFT JOIN j ON l.row_no = j.row_no AND j.k = 1""",
    "quotes",
)
def asof_forward_tolerance(t: Tables) -> DataFrame:
    q = t.quotes.withColumn("ts", F.col("local_ts_ms"))
    left, right = (q.where(F.col("venue") == v).select("row_no", "symbol", "ts") for v in (E.LEADER, E.LAGGER))
    return asof.asof_tolerance(left, right, ["symbol"], F.col("row_no"), "right_row", HOUR // 2).select("row_no", "right_row")


@query("previous_quote", f"SELECT row_no, round(lag((bid + ask) / 2) OVER (PARTITION BY symbol, venue ORDER BY {ORDER}), 6) AS previous_mid FROM quotes", "quotes")
def previous_quote(t: Tables) -> DataFrame:
    return windows.previous_quote(t.quotes).select("row_no", F.round("previous_mid", 6).alias("previous_mid"))


@query("midpoint_returns", "SELECT row_no, round(10000 * (mid - pm) / pm, 6) AS ret FROM (SELECT row_no, (bid + ask) / 2 AS mid, lag((bid + ask) / 2) OVER (PARTITION BY symbol, venue ORDER BY local_ts_ms, row_no) AS pm FROM quotes) WHERE pm > 0", "quotes")
def midpoint_returns(t: Tables) -> DataFrame:
    return windows.midpoint_returns(t.quotes).select("row_no", F.round("ret", 6).alias("ret"))


@query(
    "feed_gaps",
    f"""SELECT row_no, gap_ms, gap_ms > {3 * HOUR} AS stale FROM (SELECT row_no, coalesce(greatest(0, local_ts_ms - lag(local_ts_ms) OVER (PARTITION BY venue, symbol ORDER BY {ORDER})), 0) AS gap_ms FROM quotes)""",
    "quotes",
)
def feed_gaps(t: Tables) -> DataFrame:
    return windows.feed_gaps(t.quotes, 3 * HOUR).select("row_no", "gap_ms", "stale")


BASIS = f"""{PAIRS}, s AS (SELECT row_no, symbol, greatest(a.ts, b.ts) AS ts, 10000 * (ln(b.mid) - ln(a.mid)) AS basis, a, b,
 row_number() OVER (PARTITION BY symbol ORDER BY {ORDER}) AS k FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"""


def ewm_sql(window_ms: int) -> str:
    """The sequential definition of the moments, a row at a time."""
    return f"""WITH RECURSIVE {BASIS}, e AS (SELECT symbol, k, ts, basis AS mean, CAST(0 AS DOUBLE) AS var, CAST(NULL AS DOUBLE) AS prior_mean, CAST(NULL AS DOUBLE) AS prior_var FROM s WHERE k = 1
 UNION ALL SELECT s.symbol, s.k, s.ts, e.mean + (1 - exp(-(s.ts - e.ts) / CAST({window_ms} AS DOUBLE))) * (s.basis - e.mean),
 exp(-(s.ts - e.ts) / CAST({window_ms} AS DOUBLE)) * (e.var + (1 - exp(-(s.ts - e.ts) / CAST({window_ms} AS DOUBLE))) * (s.basis - e.mean) * (s.basis - e.mean)), e.mean, e.var
 FROM e JOIN s ON s.symbol = e.symbol AND s.k = e.k + 1)"""


@query("rolling_basis_mean", f"WITH {BASIS} SELECT row_no, round(avg(basis) OVER w, 4) AS rolling_mean, count(*) OVER w AS rolling_count FROM s WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)", "quotes")
def rolling_basis_mean(t: Tables) -> DataFrame:
    return windows.rolling_basis_mean(windows.basis_samples(t.quotes)).select("row_no", F.round("rolling_mean", 4).alias("rolling_mean"), "rolling_count")


@query("ewm_basis", ewm_sql(HOUR) + " SELECT s.row_no, round(e.mean, 4) AS ewm_mean, round(e.var, 3) AS ewm_var FROM e JOIN s ON s.symbol = e.symbol AND s.k = e.k", "quotes")
def ewm_basis(t: Tables) -> DataFrame:
    own = windows.ewm_basis(windows.basis_samples(t.quotes), HOUR)
    return own.select("row_no", F.round("ewm_mean", 4).alias("ewm_mean"), F.round("ewm_var", 3).alias("ewm_var"))


@query(
    "cooldown_thin",
    f"""WITH RECURSIVE c AS (SELECT intent_no, symbol, model, created_ts_ms AS ts, row_number() OVER (PARTITION BY symbol, model ORDER BY created_ts_ms, intent_no) AS k FROM intents),
 f AS (SELECT symbol, model, k, intent_no, ts AS last, true AS kept FROM c WHERE k = 1 UNION ALL SELECT c.symbol, c.model, c.k, c.intent_no, CASE WHEN c.ts - f.last >= {12 * HOUR} THEN c.ts ELSE f.last END, c.ts - f.last >= {12 * HOUR}
 FROM f JOIN c ON c.symbol = f.symbol AND c.model = f.model AND c.k = f.k + 1) SELECT intent_no, symbol, model FROM f WHERE kept""",
    "intents",
)
def cooldown_thin(t: Tables) -> DataFrame:
    own = t.intents.select("symbol", "model", F.col("created_ts_ms").alias("ts"), F.col("intent_no").alias("row_no"))
    return windows.cooldown_thin(own, 12 * HOUR).select(F.col("row_no").alias("intent_no"), "symbol", "model")


@query("rolling_feature_tail", "SELECT row_no, symbol FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY local_ts_ms DESC, row_no DESC) AS k FROM quotes) WHERE k <= 100", "quotes")
def rolling_feature_tail(t: Tables) -> DataFrame:
    return windows.rolling_tail(t.quotes.withColumn("ts", F.col("local_ts_ms")), 100).select("row_no", "symbol")
